"""CRC32C (Castagnoli) of bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the reflected polynomial.
POLYNOMIAL = 0x82F63B78
FULL = 0xFFFFFFFF


def table() -> list[int]:
    """What each byte does to the register."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


_table = table()


def crc32c_bytes(data: bytes, final: bool = True) -> int:
    register = FULL
    for byte in data:
        register = register >> 8 ^ _table[(register ^ byte) & 0xFF]
    return register ^ FULL if final else register


_steps = np.array(_table, np.uint32)


def crc32c_rows(rows: list[bytes | None], final: bool = True) -> list[int | None]:
    """The checksums of many texts, a byte of all of them at a time."""
    order = sorted((k for k, d in enumerate(rows) if d is not None), key=lambda k: -len(rows[k]))
    lengths = np.array([len(rows[k]) for k in order], np.int64)
    data = np.frombuffer(b"".join(rows[k] for k in order), np.uint8)
    starts = np.cumsum(lengths) - lengths
    register = np.full(len(order), FULL, np.uint32)
    for place in range(int(lengths.max(initial=0))):
        # the longest come first, so those that have a byte here are the first ones
        some = int(np.searchsorted(-lengths, -place, "left"))
        register[:some] = register[:some] >> np.uint32(8) ^ _steps[(register[:some] ^ data[starts[:some] + place]) & np.uint32(0xFF)]
    out: list[int | None] = [None] * len(rows)
    for k, value in zip(order, (register ^ np.uint32(FULL) if final else register).tolist(), strict=True):
        out[k] = value
    return out


def _batch(final: bool):  # noqa: ANN202
    def run(data: pd.Series) -> pd.Series:
        return pd.Series(crc32c_rows([None if d is None else bytes(d) for d in data], final), dtype="Int64")

    return F.pandas_udf(run, T.LongType())


def crc32c(data: Column, final: bool = True) -> Column:
    """The checksum of a binary column; without ``final``, the register before its last inversion. Null stays null."""
    return _batch(final)(data.cast("binary"))
