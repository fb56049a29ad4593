"""Token ids of texts with a public tokenizer file, exact and with a bounded memory.

The normalizer and pre-tokenizer of the word-level BPE file never join text
across ASCII white space, so a text's ids are the ids of its chunks between
white space, one after the other. Chunks are remembered up to a bound. A new
chunk of plain Latin letters, digits and ASCII signs is cut into its words here
and the words go to the library's model; any other chunk goes through the whole
library.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks that no normalizer step but lower-casing changes, without the apostrophes that have a rule of their
#: own and the sign that special tokens start with.
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
#: One word of small letters.
SMALL = re.compile("[a-zß-öø-ÿ]+")
#: The words of such a chunk: runs of letters, single digits, runs of signs.
WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: Bytes of ASCII and of U+00C0 to U+00FF; those but two are letters.
LATIN = bytes([*range(0xC0), 0xC3])
#: What kind each byte is: "a" letters and digits, " " white space, "." signs.
SHAPE = bytes(ord("a") if b >= 0x80 or chr(b).isalnum() else ord(" ") if b in b" \t\n\x0b\x0c\r" else ord(".") for b in range(256))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """What ``make`` gives for a key; the keys used lately stay, at most twice ``limit`` of them."""

    def __init__(self, make, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ChunkEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids with the tokenizers library."""

    def __init__(self, path: str, limit: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from .prefix_bpe import byte_alphabet

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if any(PLAIN.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens must have a sign that plain chunks don't have")
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.tokenize = self.tokenizer.model.tokenize
        self.raw_ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.chunks = Remembered(self.chunk_ids, limit, 48)

    def word_ids(self, word: str) -> bytes:
        coded = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        raw = self.raw_ids
        return b"".join([raw[t.id] for t in self.tokenize(coded)])

    def chunk_ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if SMALL.fullmatch(text):
            return self.word_ids(text)
        if PLAIN.fullmatch(text):
            return b"".join(map(self.word_ids, WORDS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        get = self.chunks.__getitem__
        return [b"".join(map(get, self.settled(t or b"").split())) for t in texts]

    @staticmethod
    def settled(text: bytes) -> bytes:
        """The text in a form with the same ids and fewer kinds of chunks.

        Where all characters are ASCII or small and capital Latin letters, and
        no special token can occur, A-Z are put in lower case, as the normalizer
        would; and a blank goes before each comma or full stop that ends a chunk,
        if no sign stands before any of them, so that it is a word of its own.
        """
        if b"<" in text or text.translate(None, LATIN) or b"\xc3\x97" in text or b"\xc3\xb7" in text:
            return text
        text = text.lower()
        if b".. " in text.translate(SHAPE):
            return text
        return text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
