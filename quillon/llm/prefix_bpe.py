"""Byte-level BPE by dynamic programming over prefixes.

A string's BPE encoding has this property: for every prefix there is exactly
one token that can be its last, and the encoding of the whole follows from
those tokens by back-pointers. An automaton over the vocabulary reports every
token that ends at a place; the longest to the shortest are tried, and the one
that is compatible with the last token of the prefix before it is stored. Two
tokens are compatible if merging their joined bytes gives back the two.

Defined results: a null text is empty (no ids, empty text); a null doc_id is
carried; other columns are ignored; repeated rows are coded each for itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .token_ids import tokenizer_path

#: Fixed value: how byte-level BPE cuts a text into pieces that are encoded one by one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class PrefixCoder(dict):
    """Encoder and decoder for one vocabulary file; as a dict, the ids of the pieces seen lately."""

    LIMIT, LONGEST, PAIRS = 400_000, 48, 1_000_000

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.to_alphabet = {b: c for b, c in enumerate(alphabet)}
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(byte_of[c] for c in token) if token not in self.special else token.encode()
        for token, k in self.special.items():
            self.token_bytes[k] = token.encode()
        self.decimal = [str(k) for k in range(size)]
        #: For each token: the two it is merged from, and the rank of that merge; bytes have none.
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.merged[vocab[left], vocab[right]] = rank
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (vocab[left], vocab[right]), rank
        self.automaton = ahocorasick.Automaton()
        for token, k in vocab.items():
            if token not in self.special and (k in self.halves or len(token) == 1):
                self.automaton.add_word(token, (len(token), k))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pair_ok: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as those two.

        ``left``'s last parts and ``right``'s first parts, from single bytes up
        to the tokens, meet at the boundary one pair after the other. A pair
        merges across it if its rank comes before the merges that take either
        part away; at one rank the merge further to the left comes first.
        """
        lefts, rights = [left], [right]
        while lefts[-1] in self.halves:
            lefts.append(self.halves[lefts[-1]][1])
        while rights[-1] in self.halves:
            rights.append(self.halves[rights[-1]][0])
        never = len(self.merged) + 1
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            left_goes = self.rank[lefts[i - 1]] if i else never
            right_goes = self.rank[rights[j - 1]] if j else never
            rank = self.merged.get((lefts[i], rights[j]))
            if rank is not None and rank < left_goes and rank <= right_goes:
                return False
            if not i and not j:
                return True
            if left_goes <= right_goes:
                i -= 1
            else:
                j -= 1

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        text = data.decode("latin-1").translate(self.to_alphabet)
        last = [-1] * (len(text) + 1)
        ok = self.pair_ok
        for at, (length, token) in self.automaton.iter(text):
            at += 1
            if last[at] >= 0:
                continue
            before = at - length
            if before:
                prev = last[before]
                if prev < 0:
                    continue
                key = prev << 32 | token
                fits = ok.get(key)
                if fits is None:
                    if len(ok) >= self.PAIRS:
                        ok.clear()
                    fits = ok[key] = self.compatible(prev, token)
                if not fits:
                    continue
            last[at] = token
        ids = []
        at = len(text)
        while at:
            token = last[at]
            ids.append(token)
            at -= len(self.token_bytes[token])
        ids.reverse()
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode_piece(piece)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        parts = [text]
        if self.between and any(s in text for s in self.special):
            parts = self.between.split(text)
        coded = b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else b"".join(map(self.__getitem__, self.pieces.findall(p))) for p in parts)
        return np.frombuffer(coded, "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' bytes as UTF-8; what isn't valid becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict[str, PrefixCoder] = {}


def coder(path: str) -> PrefixCoder:
    """One coder for each file and Python worker."""
    if path not in _coders:
        _coders[path] = PrefixCoder(path)
    return _coders[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in slices(batches):
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in slices(batches):
            texts = [c.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
