"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import in_batches

#: Components of a vector, letters of an n-gram, letter codes (0: between words).
DIMS, GRAM, CODES = 512, 3, 128
UNKNOWN = "und"
_SEED = 20
#: Counts that are held at once, 12 bytes each.
_CELLS = 1 << 22
_RATIO = 2654435761


def _codes() -> np.ndarray:
    """The code of each character below 0x10000: a-z have their own, other letters share the rest by rule, all else is 0."""
    points = np.arange(0x10000)
    letter = np.array([chr(p).isalpha() for p in points])
    code = np.where((points >= 97) & (points <= 122), points - 96, 27 + np.where(points < 0x180, points - 0xC0, points * _RATIO >> 16) % (CODES - 27))
    return np.where(letter, code, 0).astype(np.int64)


class Letters:
    """Random letter vectors; n-gram vectors are products of them, each rotated by its place."""

    def __init__(self) -> None:
        self.codes = _codes()
        base = np.random.default_rng(_SEED).choice(np.array([-1, 1], np.int8), (CODES, DIMS))
        self.placed = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]

    def grams(self, text: str | None) -> np.ndarray:
        """The n-gram numbers of a whole text, words set apart by one blank; none without a letter."""
        if not text:
            return np.empty(0, np.int64)
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        c = self.codes[np.minimum(points, 0xFFFF)]
        far = np.nonzero(points > 0xFFFF)[0]
        for i in far:
            c[i] = 27 + (int(points[i]) * _RATIO >> 16) % (CODES - 27) if chr(points[i]).isalpha() else 0
        c = np.concatenate([[0], c, [0]])
        c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]
        if not c.any():
            return np.empty(0, np.int64)
        c = np.concatenate([c, np.zeros(max(0, GRAM - len(c)), np.int64)])
        out = c[: len(c) - GRAM + 1].copy()
        for k in range(1, GRAM):
            out = out * CODES + c[k : len(c) - GRAM + 1 + k]
        return out

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A vector of length 1 for each text: the sum of its n-gram vectors (zeros without a letter)."""
        out = self._sums([self.grams(t) for t in texts])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _sums(self, grams: list[np.ndarray]) -> np.ndarray:
        """Sums of n-gram vectors. The table of texts by n-grams holds at most ``_CELLS`` counts, or one text."""
        out, flat = np.zeros((len(grams), DIMS), np.float32), np.concatenate([*grams, np.empty(0, np.int64)])
        if not len(flat):
            return out
        seen = np.bincount(flat, minlength=CODES**GRAM) > 0
        used = np.nonzero(seen)[0]
        if len(grams) > 1 and len(grams) * len(used) > _CELLS:
            half = len(grams) // 2
            return np.concatenate([self._sums(grams[:half]), self._sums(grams[half:])])
        place = np.cumsum(seen, dtype=np.int32) - 1
        rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        counts = np.bincount(rows * len(used) + place[flat], minlength=len(grams) * len(used))
        counts = counts.reshape(len(grams), len(used)).astype(np.float32)
        for at in range(0, len(used), 8192):
            some, vectors = used[at : at + 8192], 1
            for k in range(GRAM):
                vectors = vectors * self.placed[k][some // CODES ** (GRAM - 1 - k) % CODES]
            out += counts[:, at : at + 8192] @ vectors.astype(np.float32)
        return out


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Short runs of texts: at most 256 and about two million characters, or one text."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) >= 256 or size + len(t or "") > 2_000_000):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


class Model:
    """Language prototypes: the mean vector of each language's texts, set apart from what all have in common."""

    def __init__(self, names: list[str], sums: np.ndarray) -> None:
        told = np.linalg.norm(sums, axis=1) > 0  # a language none of whose texts has a letter is no language to learn
        self.names, sums = [n for n, t in zip(names, told) if t], sums[told]
        means = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.center = means.mean(axis=0) if len(self.names) > 1 else np.zeros(DIMS)
        far = means - self.center
        self.prototypes = (far / np.maximum(np.linalg.norm(far, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.center = self.center.astype(np.float32)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        far = vectors - self.center
        return (far / np.maximum(np.linalg.norm(far, axis=1, keepdims=True), 1e-9)) @ self.prototypes.T


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 4000) -> Model:
    """Learn prototypes from rows with a language and a text.

    The fit takes about ``per_language`` rows of each language, chosen by a hash of the text, all of
    them where there are fewer. Vectors are added up where the rows lie; one sum per language and
    task is shuffled, and one row per language comes to the driver.
    """
    known = in_batches(docs).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return Model([], np.zeros((0, DIMS)))
    share = F.create_map(*(F.lit(x) for n, c in totals.items() for x in (n, min(1.0, per_language / c))))
    draw = F.pmod(F.xxhash64("text", F.lit(_SEED)), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(draw < share[F.col("lang")])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = Letters(), {}
        for pdf in batches:
            for name, own in pdf.groupby("lang")["text"]:
                for some in _slices(own.tolist()):
                    sums[name] = sums.get(name, 0) + letters.bundle(some).sum(axis=0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    # Kept as whole numbers, so that the order of addition can't change a sum.
    each = chosen.mapInPandas(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    each = each.groupBy("lang", "k").agg(F.sum(F.round(F.col("x") * 2**30).cast("decimal(38,0)")).alias("x"))
    got = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", F.col("x").cast("double").alias("x")))).alias("v"))
    rows = sorted(got.collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in rows], np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(-1, DIMS))


def predict(model: Model, text: Column | str) -> Column:
    """``struct(lang_pred, score)`` of each whole text.

    ``und`` with score 0 for null, for texts without a letter, and for all texts if no language was
    learned. The score is the cosine with the nearest prototype, 0 where that is negative; ties go to
    the name that sorts first.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for texts in batches:
            names, scores = [], []
            for some in _slices(texts.tolist()):
                vectors = letters.bundle(some)
                blank = ~vectors.any(axis=1)
                if not model.names:
                    names += [UNKNOWN] * len(some)
                    scores += [0.0] * len(some)
                    continue
                c = model.cosines(vectors)
                best = c.argmax(axis=1)
                names += [UNKNOWN if e else model.names[k] for k, e in zip(best, blank)]
                scores += np.where(blank, 0, np.clip(c.max(axis=1), 0, 1)).tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row of ``docs``.

    Held out are the rows whose crc32 of the id as text leaves 2 when divided by 4 (a null id: not
    held out); the others with a language are learned from. Repeated rows keep one row each, other
    columns are ignored, an empty table gives an empty one.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held), text_col, lang_col)
    return docs.select(F.col(id_col), held.alias("held_out"), predict(model, text_col).alias("p")).select(
        id_col, "held_out", "p.lang_pred", "p.score"
    )
