"""What several corpus operators share: session helpers and the small numpy kernels that turn text into 64-bit codes inside a task."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


# ---- session ------------------------------------------------------------------------------


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); a temporary one only where that is unset, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(sc, "_visitlens_shared", None) or tempfile.mkdtemp(prefix="spark-shared-")
        sc._visitlens_shared = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in the shared folder: for loops, where a checkpoint would keep the estimated size of its plan, which grows from join to join."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ---- bytes and words as 64-bit codes --------------------------------------------------------

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]  # A-Z as a-z
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
KEPT_POWERS = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i in [0, n); a worker keeps KEPT_POWERS of them at most."""
    if _powers and n <= len(_powers[0]):
        return _powers[0][:n], _powers[1][:n]
    size = n if n > KEPT_POWERS else KEPT_POWERS
    up, down = np.full(size, BASE, np.uint64), np.full(size, UNBASE, np.uint64)
    up[0] = down[0] = 1
    found = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size == KEPT_POWERS:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Runs:
    """Codes of all runs of a sequence, from prefix sums: equal runs have equal codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def of(self, n: int) -> np.ndarray:
        """Code of the run of n that starts at each place (as many as fit)."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one space after each, and where each text starts."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_codes(texts: list[bytes], table: np.ndarray = BYTE_CODES) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in turn, and the first word of each text."""
    data, starts = joined(texts)
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    first, last = edge[0::2], edge[1::2]
    codes = Runs(table[data]).between(first, last) if len(first) else np.zeros(0, np.uint64)
    return codes, np.searchsorted(first, starts)


def places_left(starts: np.ndarray) -> np.ndarray:
    """For each item of a sequence cut at ``starts``: how many items its part has from there on."""
    ends = np.repeat(starts[1:], np.diff(starts))
    return ends - np.arange(len(ends))


def slices(texts: list[bytes], limit: int = 2 << 20):
    """Index ranges of consecutive texts with about ``limit`` bytes each; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a run of ``width`` that starts at one of ``starts``."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, size), -1)
    return np.cumsum(change[:-1]) > 0
