"""Hierarchical language identification.

A text's family is predicted first, then the language within that family. Both
levels use one-versus-one linear support vector machines over hashed byte
trigrams of the whole lower-cased text (square roots of shares). The machines
are trained on the driver from a sample of labelled rows of every language;
every text is then scored where it is read.

Defined results: ``und`` with score 0 for a null text or one without a letter
(numerals such as ½ or ② are none); a null doc_id is carried and never learned
from; if no row can be learned from, every text is ``und``; rows that repeat, and
texts that repeat under other labels, are learned from and answered each for
itself; an empty table gives an empty one; other columns are carried, but
lang_pred and score are replaced. A text of any length becomes one vector of
``BUCKETS`` counts, in memory a few times its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, named, read_table, slices

BUCKETS = 4096
UNKNOWN = "und"

#: Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tt".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi bn ur pa gu mr ne si".split(),
    "sinitic": "zh yue wuu".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_maybe_letter = re.compile(r"[^\W\d_]")


def lettered(text: str) -> bool:
    """Whether a text has a letter of any script."""
    return any(m.group().isalpha() for m in _maybe_letter.finditer(text))


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket of hashed byte trigrams occurs in the whole lower-cased text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        raw = np.resize(raw, 3)
    hashed = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    return np.bincount(hashed.astype(np.int64), minlength=BUCKETS)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the buckets; a unit vector."""
    count = trigram_counts(text)
    return np.sqrt(count / count.sum())


def train_machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Weights and bias of a linear support vector machine over some rows of x (y is +1 or -1), by dual coordinate descent."""
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    upper = cost * balance
    norm = np.array([float(x[k] @ x[k]) + 1 for k in rows])
    alpha, w = np.zeros(len(rows)), np.zeros(x.shape[1] + 1)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            row = x[rows[i]].astype(np.float64)
            step = min(max(alpha[i] - (y[i] * (row @ w[:-1] + w[-1]) - 1) / norm[i], 0.0), upper[i])
            if step != alpha[i]:
                move = (step - alpha[i]) * y[i]
                w[:-1] += move * row
                w[-1] += move
                alpha[i] = step
    return w


@dataclass
class Level:
    """One-versus-one machines over the names; one name alone needs none."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Level:
        """From the given rows of x, which have these labels."""
        names = sorted(set(labels.tolist()))
        pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
        machines = []
        for a, b in pairs:
            mine = (labels == names[a]) | (labels == names[b])
            machines.append(train_machine(x, rows[mine], np.where(labels[mine] == names[a], 1.0, -1.0)))
        return cls(names, pairs, np.array(machines) if machines else None)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most votes (then the largest sum of margins), and how sure its closest duel was."""
        if self.weights is None:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = int(np.lexsort((-np.arange(len(votes)), total, votes))[-1])
        own = [m if a == best else -m for (a, b), m in zip(self.pairs, margins, strict=True) if best in (a, b)]
        return self.names[best], float(1 / (1 + np.exp(-2 * min(own))))


@dataclass
class LanguageModel:
    families: Level
    within: dict[str, Level]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel | None:
        if not langs:
            return None
        names = np.array(langs, object)
        family = np.array([FAMILY_OF.get(code, code) for code in langs], object)
        rows = np.arange(len(langs))
        return cls(Level.fit(x, rows, family), {f: Level.fit(x, rows[family == f], names[family == f]) for f in sorted(set(family.tolist()))})

    def predict(self, text: str) -> tuple[str, float]:
        x = features(text)
        family, sure = self.families.predict(x)
        lang, surer = self.within[family].predict(x)
        return lang, sure * surer


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def has_letter(text: Column) -> Column:
    """Whether a text has a letter, as ``lettered`` says; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


#: So many rows of each language are learned from, however many languages there are.
LEAST_ROWS = 20


def fit(docs: DataFrame, rows_per_language: int = 500, most_rows: int = 20_000) -> LanguageModel | None:
    """A model of every language, from at most ``rows_per_language`` rows of each.

    With more languages than ``most_rows`` has room for, each gets an equal share
    of them, but ``LEAST_ROWS`` at least. The rows are those with the smallest
    hash of their doc_id, among the ones not held out; languages are counted
    first, so that only about as many rows as asked for are read into features.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    rows_per_language = min(rows_per_language, max(LEAST_ROWS, most_rows // len(counts)))
    mix = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, (1.5 * rows_per_language + 20) / n) * (1 << 30)))])
    sample = rows.withColumn("mix", mix).where(F.col("mix") < F.element_at(limit, F.col("lang")))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [(lang, mix, _packed(trigram_counts(text))) for lang, mix, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if lettered(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.string()), pa.array([r[1] for r in own], pa.int64()), pa.array([r[2] for r in own], pa.binary())], names=["lang", "mix", "x"])

    # in each language for itself: a rare one's rows may all come after the others'
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mix", "x"))
    found = sample.select("lang", "mix", F.col("text").cast("string")).mapInArrow(featurise, "lang string, mix long, x binary").withColumn("place", place).where(F.col("place") <= rows_per_language).orderBy("lang", "place").collect()
    chosen: dict[str, list[bytes]] = {}
    for row in found:
        chosen.setdefault(row["lang"], []).append(row["x"])
    del found
    langs = [lang for lang, own in sorted(chosen.items()) for _ in own]
    x = np.zeros((len(langs), BUCKETS), np.float32)
    for row, packed in zip(x, (v for _, own in sorted(chosen.items()) for v in own), strict=True):
        pairs = np.frombuffer(packed, "<u4").reshape(2, -1)
        row[pairs[0]] = np.sqrt(pairs[1] / pairs[1].sum())
    return LanguageModel.fit(x, langs)


def _packed(count: np.ndarray) -> bytes:
    """The buckets that occur, then their counts."""
    at = np.flatnonzero(count)
    return np.concatenate([at, count[at]]).astype("<u4").tobytes()


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents with lang_pred and score; their own columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in own]).add("lang_pred", "string").add("score", "double")
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(t) if model and t and lettered(t) else (UNKNOWN, 0.0) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_batches(docs.select(*map(named, own)), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
