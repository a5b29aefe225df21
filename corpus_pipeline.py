"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Rows are told apart by doc_id and a hash of the text, so null and repeated ids, and rows that repeat,
have a defined outcome in every stage. Stages read and write Parquet only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.llm import copies, decontaminate, language, mixing, sharding
from lograft.llm.common import cut, scratch, screened, table
from lograft.sources.scratch import new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Target shares of expected tokens, of as many tokens as the corpus can give at rates of at most 1:
#: clean documents reach rate 1, low ones are thinned, toxic ones fall to 0.
MIX = {"high": 0.95, "low": 0.05, "toxic": 0.0}

#: Bits in which fingerprints of candidates for near duplicates differ at most, as in ``op2_simhash``.
RADIUS = 3


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _hashed(docs: DataFrame) -> DataFrame:
    """Add ``d`` and ``h``, hashes of id and text: never null, and equal for rows with the same key."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _keys(rows: DataFrame, key: str) -> DataFrame:
    """The distinct keys in a column as ``d, h``, written."""
    return cut(rows.select(F.xxhash64(f"{key}.id").alias("d"), F.col(f"{key}.h").alias("h")).distinct(), "keys")


def _split(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed rows of ``docs`` that stand in none of ``keys``, and those that may.

    The first never move: a bitmap of fixed size tells them apart where they lie. The second are little
    more than the rows that do stand there, so only these are shuffled, text and all, to be joined exactly.
    """
    both = F.xxhash64("d", "h")
    seen = screened(_hashed(docs), keys.select(both.alias("k")), both)
    return seen.filter("not maybe").drop("maybe"), seen.filter("maybe").drop("maybe")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``keys``."""
    clear, maybe = _split(docs, keys)
    return clear.unionByName(maybe.join(keys.hint("merge"), ["d", "h"], "left_anti")).select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null texts and texts without a letter.

    The languages are learned from the rows of ``docs`` that name one; where none does, all stay. Every
    text with a letter is nearest to one of them and stays: the score tells how near, and no threshold
    on it was found that parts other languages from short texts. Repeated rows and null ids stay as
    they are, columns beyond those of documents are left out, an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(docs)
    if not model.names:
        return docs
    said = docs.withColumn("said", language.predict(model, "text"))
    return said.filter(F.col("said.lang_pred") != language.UNKNOWN).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the least doc_id (nulls first), then text hash.

    Candidates have fingerprints (those of ``op2_simhash``) that differ in at most ``RADIUS`` bits; min-hashes
    add those whose fingerprints lie further apart. Near are candidates whose sets of 5-word shingles have a
    likeness of 0.8 or more, compared exactly. Null and empty texts are alike; rows that repeat with their id
    keep one. Columns beyond those of documents are left out, an empty table gives an empty one.
    """
    keyed = docs.select(_key().alias("key"), "text")
    groups = cut(copies.near_copies(keyed, "key", radius=RADIUS), "groups")
    known = groups.groupBy("key").agg(F.count("*").alias("n"), F.first("component_id").alias("least"))
    known = known.select("key", (F.col("key") != F.col("least")).alias("goes"), "n").filter("goes or n > 1")
    marks = known.select(F.xxhash64("key.id").alias("d"), F.col("key.h").alias("h"), "goes")
    marks = cut(marks.groupBy("d", "h").agg(F.max("goes").alias("goes")), "keys")
    clear, maybe = _split(docs, marks)
    met = maybe.join(marks.hint("merge"), ["d", "h"], "left")
    often = met.filter("not goes").dropDuplicates(["d", "h"])
    return clear.unionByName(met.filter("goes is null").drop("goes")).unionByName(often.drop("goes")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, all rows that repeat them too.

    Null and empty texts overlap nothing and stay, null ids are told apart by their texts. Columns
    beyond those of documents are left out, empty tables give what they hold.
    """
    keyed = docs.select(_key().alias("key"), "text")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), "key")
    return _without(docs, _keys(found, "key"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays if its rate exceeds its draw, a number from 0 to 1 made from its id and text.

    Rows that repeat with id and text have one draw. Texts without words have rate 1 and stay; without
    labels all documents have the same chances and rates. Columns beyond those of documents are left
    out, an empty table gives an empty one.
    """
    keyed = docs.select(_key().alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    known = docs.select("doc_id", _key().alias("key")).join(labels, "doc_id").select(F.col("key").alias("doc_id"), "quality", "toxic")
    rated = mixing.mix(keyed, known, MIX, max_rate=1.0)
    draw = F.pmod(F.xxhash64("doc_id.id", "doc_id.h", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    return _without(docs, _keys(rated.filter(F.col("rate") <= draw), "doc_id"))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, also of null ids and rows that repeat; see ``sharding.shard``."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_near_dedup", keep_one_of_near),
    ("decontamination", drop_contaminated),
    ("mixing", draw_mixture),
    ("sharding", deal_shards),
]
#: SQL can't express language profiles, fingerprints or the fit; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage wrote on its way is deleted when it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = new_path(spark, name)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
