"""Quality by weak supervision.

Each rule looks at a document's measures and votes good (1), bad (-1) or abstains
(0). Expectation-maximisation over the counts of vote patterns estimates how
often each rule votes what in good and in bad documents, with no labels. The
posterior probability of being good, given a document's votes, replaces a filter
that all rules must pass. Base rules come before it: what they fail is not kept,
and nothing is learned from it.

Defined results: a null or empty text has no words, so it fails the base rules;
a null doc_id is carried; repeated rows are judged each for itself; other columns
are ignored; an empty table gives an empty result. A text of any length is held
whole, with eight bytes for each word. Letters (with marks) and capitals are
counted in characters of any script, as word_chars is. The rule of common words
calls nothing bad whose letters are mostly of a script it has no words of.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, read_table, saved, slices, window_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
#: Frequent words of the languages that the rules know.
COMMON = {
    "en": "the of and to in is that for with as on it was",
    "de": "der die das und ist von mit zu den nicht",
    "fr": "le la les des et un une est que dans pour",
    "es": "el los las una por con del se",
    "pt": "o os uma não em para com",
    "it": "il di che è non della per sono",
    "nl": "de het een van dat niet op",
    "sv, da, no": "och att det som är og jeg av på en",
    "pl": "i w na się nie jest że",
    "cs": "a se v je že",
    "ro": "și în nu este cu la",
    "tr": "ve bir bu için ile da",
    "fi": "ja on ei se että",
    "hu": "az és hogy nem egy",
    "id": "yang dan di itu dengan untuk",
    "vi": "và của là có không được",
    "ru": "и в не на что с как это по",
    "uk": "і у що на не та з",
    "el": "και το να του η την με για",
}
_common = frozenset(w.encode() for words in COMMON.values() for w in words.split())

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_common", "n_distinct", "n_other")
_beyond = re.compile(r"[^\x00-\x7f]+")


class _Letters(dict):
    """For a character beyond ASCII one number that sums: letters and marks, capitals (from bit 21), letters of scripts without words in ``COMMON`` (from bit 42)."""

    def __missing__(self, c: str) -> int:
        letter = unicodedata.category(c)[0] in "LM"
        other = letter and not (c < "\u0530" or "\u1e00" <= c < "\u2000")
        self[c] = value = letter | c.isupper() << 21 | other << 42
        return value


_letters = _Letters()


def letters_beyond_ascii(text: str) -> tuple[int, int, int]:
    """Letters and marks, capitals, and letters of unknown scripts, in characters."""
    found = [0, 0, 0]
    if not text.isascii():
        some = "".join(_beyond.findall(text))
        for at in range(0, len(some), 1 << 20):
            total = sum(map(_letters.__getitem__, some[at : at + (1 << 20)]))
            for k in range(3):
                found[k] += total >> 21 * k & (1 << 21) - 1
    return tuple(found)


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose words occur twice or more in the text."""
    grams = window_hashes(hashes, window)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _count(raw: bytes, kind: bytes) -> int:
    return len(raw) - len(raw.translate(None, kind))


def measure(text: str | None, words: WordHashes) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    parts = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    hashes = words.of(parts)
    letters, capitals, other = letters_beyond_ascii(text)
    return (
        len(parts),
        len(text) - _count(raw, SPACES),
        _count(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(hashes),
        len(lines),
        _count(raw, LETTERS) + letters,
        _count(raw, CAPITALS) + capitals,
        sum(map(_common.__contains__, (raw.lower() if text.isascii() else text.lower().encode()).split())),
        len(np.unique(hashes)),
        other,
    )


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else good where ``good`` holds, else no vote."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


RULES = (
    Rule("length", "n_words < 25", "n_words >= 60"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 7 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("letters", "10 * n_letters < 8 * word_chars", "10 * n_letters >= 9 * word_chars"),
    Rule("capitals", "n_letters > 0 and 10 * n_upper > 4 * n_letters", "n_letters > 0 and 10 * n_upper <= n_letters"),
    Rule("common_words", "n_words >= 40 and 50 * n_common < n_words and 2 * n_other < n_letters", "20 * n_common >= n_words"),
    Rule("variety", "n_words >= 40 and 10 * n_distinct < 2 * n_words", "10 * n_distinct >= 4 * n_words or n_words >= 2000"),
)

BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


@dataclass
class VoteModel:
    """Chance of good, and each rule's chances of voting -1, 0, 1 in bad (row 0) and good (row 1) documents."""

    prior: float
    chances: np.ndarray

    def weight(self, rule: int, vote: int) -> float:
        return float(np.log(self.chances[rule, 1, vote + 1] / self.chances[rule, 0, vote + 1]))

    def accuracy(self, rule: int) -> float:
        """How often the rule's votes are right."""
        bad, good = self.chances[rule]
        right = self.prior * good[2] + (1 - self.prior) * bad[0]
        wrong = self.prior * good[0] + (1 - self.prior) * bad[2]
        return float(right / (right + wrong)) if right + wrong else 0.5

    def posterior(self, votes: list[Column]) -> Column:
        total: Column = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for k, vote in enumerate(votes):
            # an abstention says nothing of quality
            total = total + F.when(vote == 1, self.weight(k, 1)).when(vote == -1, self.weight(k, -1)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.8, accuracy: float = 0.8, trust: float = 0.01) -> VoteModel:
    """EM over distinct vote patterns (a row each) and their counts.

    Rules start out right with the given accuracy, which also stays in the
    estimate as imagined votes, ``trust`` times as many as a class has documents
    and one at least, so that good stays good when rules always agree.
    """
    n, rules = counts.sum(), patterns.shape[1]
    start = np.array([[accuracy, 0.0, 1 - accuracy], [1 - accuracy, 0.0, accuracy]])
    chances = np.repeat(start[None], rules, axis=0)
    voted = np.stack([patterns == v for v in (-1, 0, 1)], axis=-1).astype(float)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            score = np.log(np.array([1 - prior, prior]))[None] + np.einsum("prv,rcv->pc", voted[..., [0, 2]], np.log(chances[..., [0, 2]]))
        score -= score.max(axis=1, keepdims=True)
        good = np.exp(score)
        good /= good.sum(axis=1, keepdims=True)
        mass = good * counts[:, None]
        each = np.einsum("pc,prv->rcv", mass, voted)
        each[..., 1] = 0
        each += np.maximum(1.0, trust * mass.sum(axis=0))[None, :, None] * start
        after = each / each.sum(axis=2, keepdims=True)
        was, prior = prior, float(np.clip(mass[:, 1].sum() / n, 0.01, 0.99))
        done = abs(prior - was) < 1e-9 and np.abs(after - chances).max() < 1e-9
        chances = after
        if done:
            break
    return VoteModel(prior, chances)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches):
            found = np.array([measure(t, words) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, measures, each rule's vote, base_failed, quality (the posterior) and kept.

    Texts are read once; their measures are written to the shared folder. What
    the driver gets is one row for each vote pattern, at most 3 to the number of
    rules.
    """
    table = saved(measured(docs), "measures").withColumns({f"vote_{r.name}": r.vote() for r in rules})
    votes = [f"vote_{r.name}" for r in rules]
    # what the base rules fail is decided, and would pass for the bad class if it were learned from
    counted = table.where(~F.expr(BASE_FAILED)).groupBy(*votes).agg(F.count("*").alias("n")).collect()
    if not counted:
        return table.withColumns({"base_failed": F.expr(BASE_FAILED), "quality": F.lit(0.0), "kept": F.lit(False)})
    model = estimate(np.array([row[:-1] for row in counted]), np.array([row["n"] for row in counted], float))
    failed = F.expr(BASE_FAILED)
    quality = model.posterior([F.col(v) for v in votes])
    return table.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= least)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
