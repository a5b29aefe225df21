"""Benchmark decontamination by spaced-seed hashing, all in DataFrame operations.

A seed hashes the tokens under the ones of a fixed mask and ignores those under its zeros, so a
substituted word breaks only the seeds that look at it. Seeds of documents and of benchmark items
are joined, and the aligned tokens around each hit are compared. Items with the same words are matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, screened, words
from lograft.operators.cleaning import computed_once

#: Fixed masks: 1 counts, 0 is ignored. Any 12 words of which two are replaced hold a hit of one of ``MASKS``.
MASKS = ("110111", "1011011", "11010011")
#: Blocks of seeds that one pass over the documents serves.
WAVE = 8
#: Masks for items with fewer words than a window, by number of words: with them every window with as
#: many replaced words as a share of 0.8 allows holds a hit.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "10111", "11101")} | {n: ("1111", "11011") for n in range(6, 12)}


def token_hashes(text: Column | str) -> Column:
    """A hash for each word, lower-cased and without signs; words of signs only are left out."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.transform(words(plain), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], at: str, masks: list[str], held: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """``seed``, its start ``at`` and the length ``span`` of its mask, for every mask at every place of ``hs``.

    With ``held`` rows whose number of words is a key have the masks given there, others ``MASKS``.
    """
    n = F.size("hs")
    rows = rows.filter(n >= min(map(len, masks))).select(*keep, "hs", F.explode(F.sequence(F.lit(0), n - min(map(len, masks)))).alias(at))

    def one(mask: str) -> Column:
        fits = F.col(at) + len(mask) <= n
        if held is not None:
            sizes = [k for k, own in held.items() if mask in own]
            long = n > max(held, default=0) if mask in MASKS else F.lit(False)
            fits = fits & (n.isin(*sizes) | long if sizes else long)
        got = F.xxhash64(F.lit(mask), *(F.get("hs", F.col(at) + k) for k, c in enumerate(mask) if c == "1"))
        return F.struct(F.when(fits, got).alias("seed"), F.lit(len(mask)).alias("span"))

    rows = rows.select(*keep, "hs", at, F.explode(F.array(*map(one, masks))).alias("s"))
    return rows.select(*keep, "hs", at, "s.seed", "s.span").filter("seed is not null")


def _narrow(seeds: DataFrame, window: int) -> DataFrame:
    """In place of ``hs`` only ``near``, the words that a window around the seed can hold, from word ``base`` on."""
    base = F.greatest(F.lit(0), F.col("at") + F.col("span") - window)
    rows = seeds.withColumn("base", base)
    return rows.withColumn("near", F.slice("hs", F.col("base") + 1, F.lit(2 * window) - F.col("span"))).drop("hs")


def _best(hits: DataFrame, own: DataFrame, window: int, share: float) -> DataFrame:
    """``id, k1, k2, best``: the best window, then the first, of each document and sequence of ``own`` that overlap."""
    hits = hits.join(F.broadcast(own.select("k1", "k2", F.col("hs").alias("item_hs"))), "k1")
    size = F.size("item_hs")
    wide = F.least(F.lit(window), size)
    # Starts of the windows of the item that hold the seed.
    first = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - wide)
    last = F.least(F.col("item_at"), size - wide)
    hits = hits.withColumn("wide", wide).withColumn("shift", F.col("at") - F.col("item_at"))
    hits = hits.withColumn("first", first).withColumn("last", last)
    windows = F.expr(
        "transform(sequence(first, last), s -> struct("
        "aggregate(sequence(0, wide - 1), 0, (a, k) -> a + if(get(near, shift - base + s + k) <=> get(item_hs, s + k), 1, 0)) as matched,"
        " -(shift + s) as doc_word, -s as item_word))"
    )
    best = computed_once(hits, best=F.array_max(windows)).select("id", "k1", "k2", "wide", "best")
    best = best.filter(F.col("best.matched") >= F.ceil(F.col("wide") * share))
    return best.groupBy("id", "k1", "k2").agg(F.max("best").alias("best"))


def _known(items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """``item, k1, k2, hs``, written: the words of items that have some, and two hashes that name their sequence."""
    known = items.select(F.col(item_col).alias("item"), F.col("text").alias("t")).distinct()
    known = known.select("item", token_hashes("t").alias("hs")).filter(F.size("hs") > 0)
    return cut(known.select("item", F.xxhash64("hs").alias("k1"), F.xxhash64(F.lit(1), "hs").alias("k2"), "hs").distinct(), "items")


def _matches(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, window: int, share: float, broadcast_seeds: int) -> DataFrame:
    """``id, k1, k2, best`` of every document and sequence of ``known`` that overlap.

    Sequences are dealt by hash into as many blocks as keep the seeds of one at about ``broadcast_seeds``
    (counted first). A block's seeds and words are broadcast, so documents are never shuffled and no seed,
    however frequent, is a key that meets in one task. With more than one block the documents are read once
    for each ``WAVE`` of them: a bitmap of fixed size, broadcast, passes hardly more than the places that hold
    a seed of the wave. These are written with the words around them, and each block is a query of its own
    on them, so memory holds one block at a time, however many there are.
    """
    seqs = cut(known.select("k1", "k2", "hs").distinct(), "sequences")
    counts = seqs.groupBy(F.least(F.size("hs"), F.lit(window))).agg(F.sum(F.size("hs")), F.count("*")).collect()
    sizes = {r[0]: r[1] for r in counts}
    held = {k: SHORT[k] for k in sizes if k < window and k in SHORT}
    masks = sorted({m for own in held.values() for m in own} | set(MASKS if any(k not in held for k in sizes) else ()))
    if not masks:
        masks = list(MASKS)
    blocks = min(max(1, sum(r[2] for r in counts)), -(-sum(sizes.values()) * len(masks) // max(1, broadcast_seeds)) or 1)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    # Hashed once: filters that the optimizer makes for the rows below don't repeat it.
    hashed = computed_once(text, hs=token_hashes("t")).select("id", "hs")
    seeds = _seeds(hashed, ["id"], "at", masks)
    index = lambda own: _seeds(own, ["k1"], "item_at", masks, held).select("seed", "k1", "item_at")
    if blocks == 1:
        return _best(_narrow(seeds.join(F.broadcast(index(seqs)), "seed"), window), seqs, window, share)
    block = F.pmod(F.xxhash64("k1", F.lit(9)), F.lit(blocks))
    waves, out = -(-blocks // WAVE), None
    for w in range(waves):
        some = index(seqs.filter(block % waves == w)).select("seed")
        seen = screened(seeds, some, F.col("seed"), bits=27, marks=4).filter("maybe").drop("maybe")
        near = cut(_narrow(seen, window), "near")
        for b in range(w, blocks, waves):
            own = seqs.filter(block == b)
            found = cut(_best(near.join(F.broadcast(index(own)), "seed"), own, window, share), "found")
            out = found if out is None else out.unionByName(found)
    return out


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", window: int = 12, share: float = 0.8, broadcast_seeds: int = 1_000_000,
) -> DataFrame:
    """``id_col, item_col, matched, doc_word, item_word``: a row for each document and item that overlap.

    They overlap where some ``window`` consecutive words of the item (all of it, if it has fewer)
    stand in the document with at least ``share`` of them equal and in place. With the given window
    and share the seeds find every overlap, also of items of one word; with others, those that hold a
    seed. ``matched`` is the most equal words of such a window, ``doc_word`` and ``item_word`` where
    the first such window starts. Whole texts; null or empty texts and texts of signs only overlap
    nothing, a null id is an id like any other. Rows that repeat give one row; other columns are
    ignored, an empty table on either side gives an empty one.

    Documents are matched with distinct sequences of words (see ``_matches``), whatever the number of items
    that share one. The items of each are met at the end, in broadcasts of at most about ``broadcast_seeds`` rows.
    """
    known = _known(items, item_col)
    found = _matches(docs, known, id_col, text_col, window, share, broadcast_seeds)
    named, parts = known.select("item", "k1", "k2"), -(-known.count() // max(1000, broadcast_seeds))
    if parts > 1:
        found = cut(found, "found")
    out = None
    for k in range(max(1, parts)):
        some = named.filter(F.pmod(F.xxhash64("item", F.lit(9)), F.lit(max(1, parts))) == k)
        met = found.join(F.broadcast(some), ["k1", "k2"])
        out = met if out is None else out.unionByName(met)
    out = out.groupBy("id", "item").agg(F.max("best").alias("best"))
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.matched").alias("matched"),
        (-F.col("best.doc_word")).alias("doc_word"), (-F.col("best.item_word")).alias("item_word"),
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", window: int = 12, share: float = 0.8, broadcast_seeds: int = 1_000_000,
) -> DataFrame:
    """The distinct ``id_col`` of ``overlaps``: no row is made for each item that a document overlaps."""
    found = _matches(docs, _known(items, item_col), id_col, text_col, window, share, broadcast_seeds)
    return found.select(F.col("id").alias(id_col)).distinct()
