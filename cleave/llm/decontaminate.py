"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.llm.common import ALNUM, LOWER, arrow_schema, blocks, keep_where, pick, text_buffer, words
from cleave.session import cut, remove, shared_folder

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark takes several passes.
MOST_BYTES = 1 << 20

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"


class Matcher:
    """The automaton of a list of (item id, text): windows as sequences of word numbers."""

    def __init__(self, items: list[tuple[str, str]]):
        seqs, all_words = [], {}
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, hashes, _ = words(raw, np.array([0, len(raw)]), ALNUM)
            lowered = LOWER[raw].tobytes()
            seq = [lowered[a:b] for a, b in zip(starts, ends, strict=True)]
            all_words.update(zip(seq, hashes.tolist(), strict=True))
            seqs.append((item, seq))
        order = sorted(all_words, key=lambda w: (all_words[w], w))
        self.hashes = np.array([all_words[w] for w in order], np.uint64)
        number = {w: int(np.searchsorted(self.hashes, np.uint64(all_words[w]))) + 1 for w in order}
        self.windows: list[tuple[int, bytes, list[str]]] = []
        found: dict[tuple[bytes, ...], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        of_key: dict[tuple[int, ...], list[int]] = {}
        for item, seq in seqs:
            if not seq:
                continue
            for i in range(max(1, len(seq) - WINDOW + 1)):
                w = tuple(seq[i : i + WINDOW])
                if w not in found:
                    found[w] = len(self.windows)
                    self.windows.append((len(w), b" ".join(w), []))
                    of_key.setdefault(tuple(number[x] for x in w), []).append(found[w])
                if item not in self.windows[found[w]][2]:
                    self.windows[found[w]][2].append(item)
        for key, at in of_key.items():
            self.automaton.add_word(key, at)
        self.shortest = min((n for n, _, _ in self.windows), default=0)
        if self.windows:
            self.automaton.make_automaton()
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            known = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.hashes, hashes[known])
            at[at == len(self.hashes)] = 0
            same = self.hashes[at] == hashes[known]
            out[known[same]] = at[same] + 1
        return out

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
        """Of each text: its number, words, hit word ranges (start, end), items, and hit places in code points.

        The automaton reads every run of known words that is long enough for a window; a match's words are compared as bytes.
        """
        starts, ends, hashes, at = words(raw, offsets, ALNUM)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        ids = self.numbers(hashes)
        hits: dict[int, tuple[list, set]] = {}
        if self.windows and len(ids):
            known = ids > 0
            edge = np.ones(len(ids), bool)
            edge[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
            run = np.flatnonzero(edge)
            stop = np.append(run[1:], len(ids))
            long = known[run] & (stop - run >= self.shortest)
            for a, b in zip(run[long].tolist(), stop[long].tolist(), strict=True):
                for end, matched in self.automaton.iter(tuple(ids[a:b].tolist())):
                    for w in matched:
                        n, text, items = self.windows[w]
                        first = a + end - n + 1
                        here = b" ".join(LOWER[raw[starts[i] : ends[i]]].tobytes() for i in range(first, first + n))
                        if here == text:
                            ranges, of = hits.setdefault(int(owner[a]), ([], set()))
                            ranges.append((first, first + n))
                            of.update(items)
        for d in range(len(offsets) - 1):
            ranges, of = hits.get(d, ([], set()))
            merged = merge(ranges)
            base = int(offsets[d])
            places = []
            if merged:
                begins = np.cumsum((raw[base : offsets[d + 1]] & 0xC0) != 0x80)  # code points up to and with each byte
                places = [(int(begins[starts[s] - base]) - 1, int(begins[ends[e - 1] - 1 - base])) for s, e in merged]
            yield d, int(at[d + 1] - at[d]), [(int(s - at[d]), int(e - at[d])) for s, e in merged], of, places


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union as ranges that don't touch the next."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _blocks_of(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of about MOST_BYTES of text, one at a time: of several, each is read from its own part of a table."""
    spark = items.sparkSession
    slim = items.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ceil(total / MOST_BYTES)
    rows = lambda df: sorted((r["item_id"], r["text"]) for r in df.select("item_id", "text").collect())
    if n <= 1:
        yield rows(slim)
        return
    path = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    slim.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition("part").write.partitionBy("part").parquet(path)
    whole = spark.read.schema("item_id string, text string, part bigint").parquet(path)
    for k in range(n):
        yield rows(whole.where(F.col("part") == k))
    remove(spark, path)


_LAST: list = []


def _matcher(items: list[tuple[str, str]]) -> Matcher:
    """The automaton of a broadcast list; a Python worker keeps the last one that it has built."""
    if not _LAST or _LAST[0] is not items:
        _LAST[:] = [items, Matcher(items)]
    return _LAST[1]


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: words of each document inside benchmark windows.

    One automaton of all windows scans each text once. A benchmark of more than MOST_BYTES is scanned for in passes, one automaton each; what a
    pass has found is written with the texts before the next, so a task holds one automaton at any time. spans has the merged hits as
    start:end in code points of the original text, comma-joined.

    Null texts and texts without words have 0 words and no hit; texts of any length are scanned whole. Items without words are never found; a
    null item id counts as the empty string. Items of equal text are all found. Repeated rows and null ids stay rows of their own. An empty
    benchmark hits nothing; an empty table gives an empty result. Columns beyond those named are not read.
    """
    spark = df.sparkSession
    docs = pick(df, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    passes = _blocks_of(pick(benchmark, "item_id", "text"))
    items, follows = next(passes), False
    while (then := next(passes, None)) is not None:
        docs = cut(docs.mapInArrow(_scanner(spark.sparkContext.broadcast(items), follows, False), "doc_id bigint, text string, found string"))
        items, follows = then, True
    return docs.mapInArrow(_scanner(spark.sparkContext.broadcast(items), follows, True), RESULT)


def _scanner(shared, follows: bool, last: bool):
    schema = arrow_schema(RESULT if last else "doc_id bigint, text string, found string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value)
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            before = b.column(2) if follows else None
            for i, j in blocks(offsets):
                out = []
                for d, n, ranges, items, places in matcher.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    if follows:
                        old = json.loads(before[i + d].as_py())
                        ranges, items, places = merge([*map(tuple, old[0]), *ranges]), items | set(old[1]), merge([*map(tuple, old[2]), *places])
                    if last:
                        named = sorted(items)
                        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
                        out.append((n, sum(e - s for s, e in ranges), len(named), digest, bool(ranges), ",".join(f"{s}:{e}" for s, e in places)))
                    else:
                        out.append((json.dumps([ranges, sorted(items), places]),))
                kept = [b.column(0).slice(i, j - i)] + ([] if last else [b.column(1).slice(i, j - i).cast(pa.string())])
                made = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, f.type) for c, f in zip(made, list(schema)[len(kept) :], strict=True)], schema=schema)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has no word inside a benchmark window. Same rules as `find_contamination`."""
    out, passes = docs, _blocks_of(pick(benchmark, "item_id", "text"))
    items = next(passes)
    while items is not None:
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = keep_where(out, text_col, lambda texts, shared=shared: _clean(_matcher(shared.value), texts))
        items = next(passes, None)
        if items is not None:
            names = out.columns
            out = cut(out.toDF(*[f"c{i}" for i in range(len(names))])).toDF(*names)
    return out


def _clean(matcher: Matcher, texts: pa.Array) -> np.ndarray:
    raw, offsets = text_buffer(texts)
    clean = np.ones(len(offsets) - 1, bool)
    for i, j in blocks(offsets):
        for d, _, ranges, _, _ in matcher.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            clean[i + d] = not ranges
    return clean


def query(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS g FROM bw),
sizes AS (SELECT DISTINCT least(len(ws), 10) AS k FROM bw WHERE len(ws) > 0),
ds AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM dw, sizes WHERE len(ws) >= k),
m AS (SELECT doc_id, i, k, item_id FROM ds JOIN bs ON array_to_string(ws[i:i + k - 1], ' ') = g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
