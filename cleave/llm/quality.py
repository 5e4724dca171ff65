"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.llm.common import NON_SPACE, U64, arrow_schema, blocks, held_out, keep_where, pick, text_buffer, words

#: Buckets of hashed words, bins of each statistic, factors.
BUCKETS, BINS, FACTORS = 1 << 14, 16, 8
#: Labelled documents that are learnt from, at most: those with the least hash of their id.
SAMPLE = 8000
THRESHOLD = 0.3
SEED = 11
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.05, 2e-4
RESULT = "doc_id bigint, held_out boolean, score double, predicted int"
#: Statistics of a text with their range for binning: fixed values of this model.
STATS = [
    ("log_bytes", 0.0, 14.0),
    ("word_bytes", 0.0, 16.0),
    ("upper", 0.0, 1.0),
    ("digit", 0.0, 0.2),
    ("symbol", 0.0, 0.4),
    ("stop_mark", 0.0, 0.1),
    ("exclaim", 0.0, 0.2),
    ("bar", 0.0, 0.2),
    ("beyond_ascii", 0.0, 0.4),
    ("line_words", 0.0, 80.0),
    ("distinct_words", 0.0, 1.0),
    ("top_word", 0.0, 0.4),
    ("same_as_last", 0.0, 0.3),
    ("distinct_pairs", 0.0, 1.0),
    ("marked_words", 0.0, 1.0),
    ("short_words", 0.0, 1.0),
    ("one_byte_words", 0.0, 0.5),
    ("distinct_lines", 0.0, 1.0),
]
SIZE = BUCKETS + len(STATS) * BINS


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(members)] = 1
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_SYMBOL, _STOP, _EXCLAIM, _BAR, _LINE = _table(b"#$%&*~^@=<>{}[]\\/_+"), _table(b".,;:"), _table(b"!?"), _table(b"|"), _table(b"\n")
_LETTER = _UPPER + _table(bytes(range(97, 123))) + _table(bytes(range(128, 256)))


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: feature numbers, values, and n + 1 offsets into them.

    Words: log(1 + count) by bucket, scaled to length 1. Statistics and the length: one bin each, value 1.
    """
    n = len(offsets) - 1
    starts, ends, hashes, at = words(raw, offsets, NON_SPACE)
    sizes = np.diff(offsets)
    n_words = np.diff(at)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(sizes, 1)

    def by_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(n_words, 1)

    lengths = ends - starts
    last_byte = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[at[:-1][n_words > 0]] = False
    letters, ups = share(_LETTER), share(_UPPER)
    lines = share(_LINE) * sizes + 1
    value = {
        "log_bytes": np.log1p(sizes),
        "word_bytes": by_word(lengths),
        "upper": ups / np.maximum(letters, 1e-9),
        "digit": share(_DIGIT),
        "symbol": share(_SYMBOL),
        "stop_mark": share(_STOP),
        "exclaim": share(_EXCLAIM),
        "bar": share(_BAR),
        "beyond_ascii": ((c := np.concatenate([[0], np.cumsum(raw >= 128)]))[offsets[1:]] - c[offsets[:-1]]) / np.maximum(sizes, 1),
        "line_words": n_words / lines,
        "same_as_last": by_word(again),
        "marked_words": by_word(_SYMBOL[last_byte] + _EXCLAIM[last_byte] > 0),
        "short_words": by_word(lengths <= 3),
        "one_byte_words": by_word(lengths == 1),
    }
    for name in ("distinct_words", "top_word", "distinct_pairs", "distinct_lines"):
        value[name] = np.zeros(n)
    pairs = hashes[:-1] * U64(0x9E3779B97F4A7C15) ^ hashes[1:] if len(hashes) else hashes
    total = np.concatenate([np.zeros(1, U64), np.cumsum(hashes)])
    breaks = np.flatnonzero(raw == 10)
    line_at = np.searchsorted(starts, breaks)
    numbers, values, counts = [], [], np.zeros(n + 1, np.int64)
    for d in range(n):
        a, b = at[d], at[d + 1]
        if b > a:
            distinct, times = np.unique(hashes[a:b], return_counts=True)
            value["distinct_words"][d] = len(distinct) / (b - a)
            value["top_word"][d] = times.max() / (b - a)
            if b - a > 1:
                value["distinct_pairs"][d] = len(np.unique(pairs[a : b - 1])) / (b - a - 1)
            lo, hi = np.searchsorted(breaks, offsets[d]), np.searchsorted(breaks, offsets[d + 1])
            cuts = np.concatenate([[a], line_at[lo:hi], [b]])
            kept = cuts[1:] > cuts[:-1]
            value["distinct_lines"][d] = len(np.unique((total[cuts[1:]] - total[cuts[:-1]])[kept])) / max(1, kept.sum())
            x = np.log1p(times).astype(np.float32)
            numbers.append((distinct & U64(BUCKETS - 1)).astype(np.int32))
            values.append(x / np.sqrt((x * x).sum()))
            counts[d + 1] = len(distinct)
        numbers.append(np.zeros(len(STATS), np.int32))
        values.append(np.ones(len(STATS), np.float32))
        counts[d + 1] += len(STATS)
    out = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    ends_at = np.cumsum(counts)
    for k, (name, lo, hi) in enumerate(STATS):
        binned = np.clip(((value[name] - lo) / (hi - lo) * BINS).astype(np.int32), 0, BINS - 1)
        out[ends_at[1:] - len(STATS) + k] = BUCKETS + k * BINS + binned
    return out, np.concatenate(values) if values else np.zeros(0, np.float32), ends_at


class Machine(NamedTuple):
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, numbers: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """bias + sum w x + half of sum over factors of (sum v x)**2 - sum (v x)**2, so linear in the features."""
        if len(offsets) < 2:
            return np.zeros(0)
        vx = self.factor[numbers] * values[:, None]
        begins = offsets[:-1]
        sums, squares = np.add.reduceat(vx, begins), np.add.reduceat(vx * vx, begins)
        return self.bias + np.add.reduceat(self.weight[numbers] * values, begins) + 0.5 * (sums * sums - squares).sum(axis=1)


def train(numbers: np.ndarray, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Machine:
    """Log loss by Adagrad over shuffled batches."""
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)
    bias, seen_b, seen_w, seen_f = 0.0, 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
    n = len(labels)
    for _ in range(EPOCHS if n else 0):
        for at in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            size = offsets[at + 1] - offsets[at]
            ends = np.cumsum(size)
            begins = ends - size
            take = np.arange(ends[-1]) + np.repeat(offsets[at] - begins, size)
            i, x = numbers[take], values[take]
            f = factor[i]
            vx = f * x[:, None]
            sums = np.add.reduceat(vx, begins)
            z = bias + np.add.reduceat(weight[i] * x, begins) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, begins)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) / len(at)
            gx = np.repeat(g, size) * x
            gw = np.bincount(i, gx, SIZE).astype(np.float32) + DECAY * weight / 10
            gf = gx[:, None] * (np.repeat(sums, size, axis=0) - vx)
            gf = np.stack([np.bincount(i, gf[:, k], SIZE) for k in range(FACTORS)], 1).astype(np.float32) + DECAY * factor
            seen_b += g.sum() ** 2
            seen_w += gw * gw
            seen_f += gf * gf
            bias -= RATE * g.sum() / np.sqrt(seen_b)
            weight -= RATE * gw / np.sqrt(seen_w)
            factor -= RATE * gf / np.sqrt(seen_f)
    return Machine(float(bias), weight, factor)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """The machine of a bounded sample: SAMPLE labelled documents outside the held-out fold. Labels only tell which rows to learn."""
    tagged = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    tagged = tagged.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "quality").limit(SAMPLE).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    rows = pick(df, id_col, text_col).toDF("doc_id", "text")
    chosen = rows.join(F.broadcast(tagged), F.col("doc_id") == F.col("id")).select("doc_id", "quality", "text")  # SAMPLE rows at most
    kind = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("numbers", pa.binary()), ("vals", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for i, j in blocks(offsets):
                k, x, at = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = lambda a, at=at: pa.array([a[p:q].tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), cut(k), cut(x)], schema=kind)

    found = chosen.mapInArrow(run, "doc_id bigint, quality int, numbers binary, vals binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["numbers"])))
    numbers = [np.frombuffer(r["numbers"], np.int32) for r in found]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    values = [np.frombuffer(r["vals"], np.float32) for r in found]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return train(join(numbers, np.int32), join(values, np.float32), offsets, np.array([r["quality"] > 0 for r in found], np.float64))


def _scores(machine: Machine, column: pa.Array) -> np.ndarray:
    raw, offsets = text_buffer(column)
    out = np.zeros(len(offsets) - 1)
    for i, j in blocks(offsets):
        z = machine.logits(*features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null texts score as empty ones; these have a score too. Texts of any length count whole. Equal texts score alike. Without labelled rows the
    score is 0.5 and all are predicted 1. Repeated rows and null ids stay rows of their own; a null id is held out. An empty table gives an
    empty result. Columns beyond id and text are not read.
    """
    rows = pick(df, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    shared, schema = df.sparkSession.sparkContext.broadcast(tuple(machine)), arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Machine(*shared.value)
        for b in batches:
            s = _scores(held, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return rows.mapInArrow(run, RESULT)


def keep_good(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df`, all columns, that score at least `threshold`. Same rules as `score`."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(machine))
    return keep_where(df, text_col, lambda texts: _scores(Machine(*shared.value), texts) >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
