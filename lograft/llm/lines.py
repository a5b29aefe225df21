"""Line deduplication with a log-template tree, all in DataFrame operations.

A line goes down a tree of fixed depth: its token count, then its leading tokens, where tokens that
hold a digit are one and the same variable; a second tree takes the last tokens in their place, for lines that
vary at their start. In the leaf its tokens are read as ``CHUNKS`` fields of adjacent tokens. Templates are
made in two ways. A leaf learns which fields are fixed: those whose content stands there in enough documents; all
others of a line are variable. And whatever ``VARIABLE`` fields of a line may vary, which joins
lines that differ in a field of few values. A template needs enough fixed words (``_enough``). Templates whose
instances stand in enough documents are dropped, with all their instances.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, join_hot, screened
from lograft.operators.cleaning import computed_once

CHUNKS, LEADING, VARIABLE = 8, 4, 2
#: Fixed words that a template with variable fields has at least; they are also at least half of its words.
FIXED_WORDS = 8
#: A token with a digit, from its start. Nothing is given back, so a search is linear in the text.
_DIGITS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _begins() -> list[Column]:
    """Where each field begins, and the last one ends."""
    return [F.floor(k * F.col("n") / CHUNKS).cast("int") for k in range(CHUNKS + 1)]


def _sizes() -> list[Column]:
    begin = _begins()
    return [b - a for a, b in zip(begin, begin[1:])]


def _enough(fixed: Column) -> Column:
    """Whether so many fixed words make a template of a line: all of it, or ``FIXED_WORDS`` and half of it."""
    return (fixed == F.col("n")) | (fixed >= FIXED_WORDS) & (2 * fixed >= F.col("n"))


def parse(rows: DataFrame) -> DataFrame:
    """``d, g, i, n, leaf, tail, fields, line`` of every line with tokens, from rows of ``d, g, text``.

    ``i`` numbers lines from 0, ``n`` counts tokens; ``leaf``, ``tail`` (the leaf of the other tree, null where it
    would hold the same tokens), the ``fields`` and the whole ``line`` are hashes.
    """
    plain = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), _DIGITS, "<*>"), "\n")
    lines = rows.select("d", "g", F.posexplode(plain).alias("i", "l"))
    lines = computed_once(lines.select("d", "g", "i", "l"), t=F.array_remove(F.split("l", r"[\x20\x09-\x0D]+"), ""))
    lines = lines.select("d", "g", "i", "t", F.size("t").alias("n")).filter("n > 0")
    leaf = F.xxhash64("n", F.slice("t", 1, LEADING))
    tail = F.when(F.col("n") > LEADING, F.xxhash64("n", F.lit("tail"), F.slice("t", -LEADING, LEADING)))
    begin = _begins()
    fields = [F.xxhash64(F.slice("t", a + 1, b - a)) for a, b in zip(begin, begin[1:])]
    out = lines.select("d", "g", "i", "n", leaf.alias("leaf"), tail.alias("tail"), F.array(*fields).alias("fields"))
    return out.select("*", F.xxhash64("leaf", "fields").alias("line"))


def _across(rows: DataFrame, key: str, least: int) -> DataFrame:
    """``key, n``: keys that stand in at least ``least`` documents, and the number of their rows."""
    each = rows.groupBy(key, "d", "g").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.count("*").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= least).select(key, "n")


def _told(rows: DataFrame, keyed: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """``rows`` with ``found``, whether ``key`` is one of ``keyed`` (with ``n``, its rows); hot keys by broadcast, as in ``join_hot``."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(1.0, share * total)
    mark = lambda df, name: df.select(key, F.lit(True).alias(name))
    first = rows.join(F.broadcast(mark(keyed.filter(hot), "hot")), key, "left")
    rest = first.filter("hot is null").drop("hot").join(mark(keyed.filter(~hot), "cold").hint("merge"), key, "left")
    cold = rest.withColumn("found", F.coalesce("cold", F.lit(False))).drop("cold")
    return first.filter("hot").withColumn("found", F.lit(True)).drop("hot").unionByName(cold)


def _free_templates(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``template`` for every template that a line of ``leaf, n, fields`` is an instance of when any ``VARIABLE`` fields vary.

    Fields that the leaf settles (leading tokens, empty ones) can't vary; of the others every choice of
    ``VARIABLE`` may, or all where there are fewer.
    """
    begin, sizes = _begins(), _sizes()
    free = [(b > LEADING) & (b > a) for a, b in zip(begin, begin[1:])]
    count = sum((f.cast("int") for f in free), F.lit(0))
    all_free = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(free)), F.lit(0))
    masks = F.array(*(F.lit(sum(1 << k for k in c)) for c in combinations(range(CHUNKS), VARIABLE)))
    rows = computed_once(rows, free=all_free, count=count)
    some = F.filter(masks, lambda m: m.bitwiseAND(F.col("free")) == m)
    rows = rows.select("leaf", "fields", "n", *keep, F.explode(F.when(F.col("count") > VARIABLE, some).otherwise(F.array("free"))).alias("mask"))
    loose = sum((F.when(F.col("mask").bitwiseAND(1 << k) != 0, x).otherwise(0) for k, x in enumerate(sizes)), F.lit(0))
    rows = rows.filter(_enough(F.col("n") - loose))
    fixed = [F.when(F.col("mask").bitwiseAND(1 << k) == 0, F.get("fields", F.lit(k))).otherwise(F.lit(0)) for k in range(CHUNKS)]
    return rows.select(*keep, F.xxhash64("leaf", "mask", *fixed).alias("template"))


def _contents(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``k, content`` for every field of a line that holds tokens: its place, and a hash of leaf, place and content."""
    held = F.filter(
        F.array(*(F.struct(F.lit(k).alias("k"), F.when(x > 0, F.xxhash64("leaf", F.lit(k), F.get("fields", F.lit(k)))).alias("content")) for k, x in enumerate(_sizes()))),
        lambda c: c["content"].isNotNull(),
    )
    return rows.select(*keep, F.inline(held))


def _learned_templates(sure: DataFrame, other: DataFrame, least: int) -> DataFrame:
    """``d, g, i, template`` for every line of ``other`` in either tree, with the fields variable whose content is rare in the leaf.

    What a recurring line (``sure``) holds is common. Only rows whose content may be common meet the contents that are.
    """
    row = ["d", "g", "i", "leaf"]
    own = _contents(sure.dropDuplicates(["leaf", "line"]), []).select("content").distinct().withColumn("n", F.lit(least).cast("long"))
    seen = cut(_across(_contents(other, ["d", "g"]), "content", least), "contents")
    common = cut(seen.unionByName(own).groupBy("content").agg(F.max("n").alias("n")), "common")
    each = _contents(other, row)
    maybe = cut(screened(each, common.select("content"), F.col("content")).filter("maybe").drop("maybe"), "maybe")
    marks = join_hot(maybe, common, "content").groupBy(*row).agg(F.expr("bit_or(shiftleft(1, k))").alias("common"))
    lines = other.join(marks, row, "left").withColumn("common", F.coalesce("common", F.lit(0)))
    is_fixed = [F.col("common").bitwiseAND(1 << k) != 0 for k in range(CHUNKS)]
    fixed = sum((F.when(f, x).otherwise(0) for f, x in zip(is_fixed, _sizes())), F.lit(0))
    held = [F.when(f, F.get("fields", F.lit(k))).otherwise(F.lit(0)) for k, f in enumerate(is_fixed)]
    return lines.filter(_enough(fixed)).select("d", "g", "i", F.xxhash64("leaf", F.lit("learned"), "common", *held).alias("template"))


def recurring(rows: DataFrame, min_docs: int = 10) -> DataFrame:
    """``d, g, gone``: for documents that lose lines, their numbers. See ``drop_lines``."""
    parsed = cut(parse(rows), "lines")
    trees = F.array_compact(F.array("leaf", "tail"))
    both = parsed.select("d", "g", "i", "n", "fields", "line", F.posexplode(trees).alias("tree", "leaf"))
    # All instances of a template lie in one leaf, so only leaves that recur matter; most lines are told where they lie.
    leaves = cut(_across(both, "leaf", min_docs), "leaves")
    likely = cut(screened(both, leaves.select("leaf"), F.col("leaf")).filter("maybe").drop("maybe"), "likely")
    often = cut(join_hot(likely, leaves, "leaf"), "often")
    # A line that recurs as it is makes each of its templates recur; it counts once, not once a document.
    same = cut(_across(often.filter("tree = 0"), "line", min_docs), "same")
    told = cut(_told(often, same, "line"), "told")
    sure, other = told.filter("found"), told.filter("not found")
    known = _free_templates(sure.filter("tree = 0").dropDuplicates(["line"]), []).distinct().withColumn("n", F.lit(min_docs).cast("long"))
    mine = ["d", "g", "i"]
    made = _free_templates(other.filter("tree = 0"), mine).unionByName(_learned_templates(sure, other, min_docs))
    made = cut(made, "templates")
    seen = made.groupBy("template", "d", "g").agg(F.count("*").alias("rows"))
    seen = seen.groupBy("template").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    all_ = seen.unionByName(known.withColumn("rows", F.lit(0).cast("long"))).groupBy("template").agg(F.sum("n").alias("docs"), F.sum("rows").alias("n"))
    drop = cut(all_.filter((F.col("docs") >= min_docs) & (F.col("n") > 0)).select("template", "n"), "recurring")
    found = join_hot(made, drop, "template").select(*mine)
    return sure.filter("tree = 0").select(*mine).unionByName(found).groupBy("d", "g").agg(F.collect_set("i").alias("gone"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """``id_col, n_lines, n_dropped, kept`` for every row of ``docs``.

    Lines end at ``\\n``. A line goes if one of its templates has instances in at least ``min_docs``
    documents. A template's fixed fields are those whose content at least that many documents have at that
    place in the leaf, or all but ``VARIABLE``; they hold all words of the line, or ``FIXED_WORDS`` and half of
    them. Blank lines stay. A document counts once per template, and rows with the same id and text are one
    document; each of them loses its lines. A null text has no lines and stays null, an empty one has one line.
    Other columns are ignored, an empty table gives an empty one.

    The work is linear in lines, also for a document of very many. Leaves, lines and templates that
    hold a large share of all lines are broadcast instead of shuffled (``join_hot``).
    """
    name, text = F.col(id_col), F.col(text_col)
    rows = docs.select(F.xxhash64(name).alias("d"), F.xxhash64(text).alias("g"), name.alias("id"), text.alias("text"))
    gone = cut(recurring(rows.select("d", "g", "text"), min_docs), "gone")
    both = rows.join(gone, ["d", "g"], "left")
    both = computed_once(both, lines=F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return both.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
