"""What the corpus operators share: column picking, Arrow text buffers and word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that end a word: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, found by position: other columns may clash in case or repeat a name."""
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's digits, mod 5, is 0. A null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i, mod 2**64, for i < n at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(1, U64)
            while len(out) < size:
                out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def _word_bytes() -> np.ndarray:
    t = np.ones(256, bool)
    t[list(SPACES)] = False
    return t


def _alnum_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


#: By byte, whether it belongs to a word: all but white space; ASCII letters, digits and all beyond ASCII.
NON_SPACE, ALNUM = _word_bytes(), _alnum_bytes()
#: By byte, with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Words up to this many bytes are summed in one go, longer texts in steps of it.
_STEP = 1 << 19


def words(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: each word's start, end, 64-bit hash of its lower-cased bytes, and each text's n + 1 word offsets."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    np.take(member, raw, out=inside[1:-1])
    first = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
    starts_at = inside[1:-1] & ~inside[:-2]
    starts_at[first] = inside[1:-1][first]
    ends_at = inside[1:-1] & ~inside[2:]
    last = first[1:] - 1
    ends_at[last] = inside[1:-1][last]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    word_offsets = np.searchsorted(starts, offsets)
    up, down = _powers(min(n, _STEP) + 1)
    sums = np.zeros(len(starts), U64)
    for at in range(0, n, _STEP):  # a long text is summed piece by piece; a word across pieces adds up
        part = LOWER[raw[at : at + _STEP]].astype(U64) + U64(1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part))
        s = np.maximum(starts[lo:hi] - at, 0)
        e = np.minimum(ends[lo:hi] - at, len(part))
        here = (total[e] - total[s]) * down[s]
        if n > _STEP:
            skipped = np.maximum(at - starts[lo:hi], 0)
            far = np.flatnonzero(skipped)
            here[far] *= np.array([pow(_BASE, int(k), 1 << 64) for k in skipped[far]], U64)
        sums[lo:hi] += here
    hashes = mix(sums ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return starts, ends, hashes, word_offsets


#: Rows and bytes that go to a Python worker in one piece, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session have at most BATCH_ROWS rows and BATCH_BYTES bytes: both sides hold some of them outside the heap."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def keep_where(df: DataFrame, text_col: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of `df`, all columns, whose text `judge` tells to keep. Only the texts go to Python and only a flag comes back."""

    def flags(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            yield pa.array(judge(x), pa.bool_())

    small_batches(df.sparkSession)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.where(F.arrow_udf(flags, "boolean")(F.col(f"c{df.columns.index(text_col)}").cast("string"))).toDF(*df.columns)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL of plain types."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
