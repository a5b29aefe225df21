"""Exact substring deduplication: word windows that occur more than once, found with an FM-index per shard.

1. Texts are cut into runs of windows that share their least n-gram (``segments``). Only runs whose
   n-gram occurs again, in another run or in their own words, can hold a repeated window.
2. Equal runs are counted and kept once, and their words are fetched from one document that holds them.
   A least n-gram with very many unlike runs is dealt on as single windows, counted in turn.
3. Runs with the same least n-gram meet in one shard, a few hundred thousand words each, where backward
   search over the shard's FM-index finds the windows that occur at least twice.
4. Found intervals go back to every document that holds the run, and are merged there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, in_batches
from lograft.llm.fmindex import STEP, FMIndex
from lograft.llm.segments import runs, split

_PIECE = "k1 long, k2 long"


def _packed(text: str) -> Column:
    """The words of each text, joined by one space and compressed for the shuffle."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=1)
        return pd.Series([z.compress(b" ".join(split(t))) for t in texts], dtype=object)

    return pack(text)


def _unpack(z: zstandard.ZstdDecompressor, data: bytes) -> list[bytes]:
    return z.decompress(data).split() if data else []


def _sketch(rows: DataFrame, window: int) -> DataFrame:
    """Runs of every row (d, g): ``mh`` (least n-gram) and ``ch`` (words of the run), two hashes, first window and windows."""

    @F.pandas_udf("array<struct<mh:long,ch:long,place:int,size:int,twice:boolean>>")
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append(split(t))
                size += len(held[-1])
                if size > 200_000 or len(held) >= 512:
                    out += told(held)
                    held, size = [], 0
            yield pd.Series(out + told(held), dtype=object)

    def told(docs: list[list[bytes]]) -> list[list[tuple]]:
        out = []
        for words, (key, place, size, twice) in zip(docs, runs(docs, window) if docs else []):
            end = place + size + window - 1
            ch = [xxhash.xxh64_intdigest(b" ".join(words[a:b])) for a, b in zip(place.tolist(), end.tolist())]
            out.append(list(zip(key.tolist(), np.array(ch, np.uint64).view(np.int64).tolist(), place.tolist(), size.tolist(), twice.tolist())))
        return out

    return rows.select("d", "g", cut_up("text").alias("runs"))


def _pieces(chosen: DataFrame, packed: DataFrame, window: int, deal: bool) -> DataFrame:
    """The words of chosen runs (d, g, list of (mh, ch, n, place, size)), taken from one row each.

    With ``deal`` every window is a piece of its own, told by two hashes ``k1, k2`` and its run.
    """
    both = chosen.join(packed, ["d", "g"]).dropDuplicates(["d", "g"]).select("list", "z")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for todo, data in zip(pdf["list"], pdf["z"]):
                words = _unpack(z, data)
                for r in todo:
                    mh, ch, n, a, size = r["mh"], r["ch"], r["n"], r["place"], r["size"]
                    if not deal:
                        out.append((mh, ch, n, 0, mh, ch, b" ".join(words[a : a + size + window - 1])))
                        continue
                    for k in range(size):
                        w = b" ".join(words[a + k : a + k + window])
                        k1, k2 = (np.uint64(xxhash.xxh64_intdigest(w, s)).astype(np.int64) for s in (1, 2))
                        out.append((mh, ch, n, k, int(k1), int(k2), w))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["mh", "ch", "n", "off", "k1", "k2", "words"])
                    out = []
            yield pd.DataFrame(out, columns=["mh", "ch", "n", "off", "k1", "k2", "words"])

    return both.mapInPandas(take, f"mh long, ch long, n long, off int, {_PIECE}, words binary")


def _found(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """``k1, k2, spans``: the words of each piece (start, end) that repeated windows cover."""
    depth = window // STEP

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [w.split() for w in pdf["words"]]
        f = FMIndex(words, pdf["n"].to_numpy(np.int64), depth)
        hit = f.repeated()
        rows, begin = [], 0
        for k1, k2, end in zip(pdf["k1"], pdf["k2"], f.ends.tolist()):
            at = np.nonzero(hit[begin:end])[0]
            if len(at):
                far = np.nonzero(np.diff(at) > window)[0]
                spans = zip(at[np.append(0, far + 1)].tolist(), (at[np.append(far, len(at) - 1)] + window).tolist())
                rows.append((k1, k2, list(spans)))
            begin = end
        return pd.DataFrame(rows, columns=["k1", "k2", "spans"])

    return pieces.groupBy("shard").applyInPandas(index, f"{_PIECE}, spans array<struct<a:int,b:int>>")


def repeated_spans(
    rows: DataFrame, window: int = 35, shard_words: int = 400_000, crowd: int = 2_000
) -> tuple[DataFrame, DataFrame]:
    """``(spans, packed)``: for rows of ``d, g, id, text`` the word intervals to remove (only rows that have
    some: d, g, list of (a, b)), and all rows with their packed words (d, g, id, z).

    ``d`` and ``g`` are hashes of the id and of the text; rows that share both are one text.
    """
    if window % STEP:
        raise ValueError(f"the window must be a multiple of {STEP} words")
    sketch = cut(_sketch(rows, window), "runs")
    each = sketch.select("d", "g", F.explode("runs").alias("r")).select("d", "g", "r.*")
    again = each.groupBy("mh").agg(F.count("*").alias("seen"), F.max("twice").alias("twice"))
    again = again.filter("seen > 1 or twice").select("mh")
    each = cut(each.drop("twice").join(again, "mh"), "again")
    # One document of those that hold a run gives its words.
    one = each.groupBy("mh", "ch").agg(
        F.count("*").alias("n"), F.min(F.struct("d", "g", "place", "size")).alias("at")
    )
    crowds = one.groupBy("mh").agg(F.count("*").alias("unlike")).filter(F.col("unlike") > crowd).select("mh", F.lit(True).alias("crowd"))
    one = cut(one.join(crowds, "mh", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))), "unlike")
    total = one.groupBy("crowd").agg(F.sum(F.col("at.size") + window - 1).alias("words"), F.sum("at.size").alias("windows"))
    size = {r["crowd"]: r for r in total.collect()}
    packed = rows.select("d", "g", "id", _packed("text").alias("z"))

    def by_doc(part: DataFrame) -> DataFrame:
        entry = F.struct("mh", "ch", "n", "at.place", "at.size")
        return part.groupBy(F.col("at.d").alias("d"), F.col("at.g").alias("g")).agg(F.collect_list(entry).alias("list"))

    plain = _pieces(by_doc(one.filter("not crowd")), packed, window, deal=False)
    shards = max(1, -(-int(size[False]["words"]) // shard_words)) if False in size else 1
    shard = F.pmod(F.xxhash64("mh"), F.lit(shards)).alias("shard")
    spans = _found(plain.select("k1", "k2", "n", "words", shard), shards, window).select(
        F.col("k1").alias("mh"), F.col("k2").alias("ch"), "spans"
    )
    if True in size:
        dealt = cut(_pieces(by_doc(one.filter("crowd")), packed, window, deal=True), "windows")
        once = dealt.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("words").alias("words"))
        parts = max(1, -(-int(size[True]["windows"]) * window // shard_words))
        hit = _found(once.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), F.lit(parts))), parts, window)
        wide = F.array(F.struct(F.col("off").alias("a"), (F.col("off") + window).alias("b"))).alias("spans")
        spans = spans.unionByName(dealt.join(hit.select("k1", "k2"), ["k1", "k2"]).select("mh", "ch", wide))
    back = each.join(spans, ["mh", "ch"]).select("d", "g", F.expr("transform(spans, s -> struct(s.a + place as a, s.b + place as b))").alias("s"))
    return back.groupBy("d", "g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("list")), packed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **bounds: int) -> DataFrame:
    """``id_col, n_words, n_removed, kept`` for every row of ``docs``.

    Words are split at ASCII blanks and kept unchanged. Every word is removed that lies in a window of
    ``window`` words (a multiple of 7) whose words also start at any other place, of any row or of its
    own; windows are judged on the input. ``kept`` joins the words that stay by one space. Null and
    empty texts have no words; rows that repeat are each judged and lose all their windows; a null id
    is an id like any other. Other columns are ignored, an empty table gives an empty one.
    ``bounds`` are the sizes that ``repeated_spans`` takes.
    """
    name, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = in_batches(docs).select(F.xxhash64(name).alias("d"), F.xxhash64(text).alias("g"), name.alias("id"), text.alias("text"))
    spans, packed = repeated_spans(rows, window, **bounds)
    both = packed.join(spans, ["d", "g"], "left").select("id", "z", "list")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def drop(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for data, lists in batches:
            out = []
            for d, spans in zip(data, lists):
                words, kept, at = _unpack(z, d), [], 0
                for s in spans if spans is not None else ():
                    kept += words[at : s["a"]] if s["a"] > at else []
                    at = max(at, s["b"])
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return both.select(F.col("id").alias(id_col), drop("z", "list").alias("r")).select(id_col, "r.*")
