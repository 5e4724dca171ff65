"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleave.llm.common import arrow_schema, blocks, held_out, mix, pick, text_buffer

#: Learnt sample: documents of each language, code points of each, symbols of each language in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS = 48, 3000, 20_000
#: Longer documents are sampled in this many pieces, evenly over the whole text; of these, pieces of about so many symbols are learnt.
PIECES, PIECE = 6, 200
#: Bytes of the dense tables of all languages together; more languages get less text each.
TABLE_BYTES = 96 << 20
#: Symbols whose transitions lie in a dense table: the most frequent letters. Those of all other letters lie in a hash table.
DENSE = 64
#: Symbols of a text that are parsed in one go (a lane), and bytes of a text that are read in one go. Neither changes what is found.
LANE, READ = 512, 1 << 20
UNDETERMINED = "und"
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


class SuffixAutomaton:
    """Of a sequence of small integers: every path from state 0 spells a factor of it."""

    def __init__(self, seq: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in seq:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Model(NamedTuple):
    """The suffix automata of all languages, with one numbering of states; a state is named by its place in the dense table.

    A step's value is twice the next state, plus 1 where a phrase begins: no factor goes on with the symbol, so the next state is that of the symbol alone, or
    `dead`, from which every symbol begins a phrase, if the language doesn't have it.
    """

    languages: list[str]
    symbols: np.ndarray  # by code point: 0 no letter, 1 a letter that no sample has, then letters by falling frequency
    table: np.ndarray  # by state + symbol below DENSE: the step's value
    keys: np.ndarray  # of the hash table of other transitions: state << 21 | symbol, or -1
    values: np.ndarray  # the state that the transition leads to
    roots: np.ndarray
    dead: np.ndarray
    cost: np.ndarray  # bits of a phrase, by language

    def step(self, states: np.ndarray, symbols: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The values of steps from `states` over `symbols` (broadcast against each other, as is `language`)."""
        rare = symbols >= DENSE
        if not rare.any():
            return self.table[states + symbols]
        out = self.table[states + np.where(rare, 1, symbols)]
        where = np.nonzero(np.broadcast_to(rare, out.shape))
        s, c, k = (np.broadcast_to(x, out.shape)[where] for x in (states, symbols, language))
        to, alone = self._found(s, c), self._found(self.roots[k], c)
        out[where] = np.where(to >= 0, 2 * to, 2 * np.where(alone >= 0, alone, self.dead[k]) + 1)
        return out

    def _found(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states that transitions of the hash table lead to, -1 where there is none."""
        want = states.astype(np.int64) << 21 | symbols
        out, left, at = np.full(len(want), -1, np.int32), np.arange(len(want)), _slot(want, len(self.keys))
        while len(left):
            here = self.keys[at]
            hit = here == want[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (here >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table, at most half full, of distinct keys."""
    size = 1 << max(1, (2 * len(keys)).bit_length())
    table, held = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    left, at = np.arange(len(keys)), _slot(keys, size)
    while len(left):
        free = table[at] < 0
        _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        put = first[free[first]]
        table[at[put]], held[at[put]] = keys[left[put]], values[left[put]]
        go = np.ones(len(left), bool)
        go[put] = False
        left, at = left[go], (at[go] + ~free[go]) & (size - 1)
        taken = table[at] >= 0
        at = np.where(taken, (at + 1) & (size - 1), at)
    return table, held


def _normalised(text: str) -> str:
    """Lower-case letters, everything else as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def _shares(lengths: list[int], budget: int) -> list[int]:
    """How much of each text is learnt: all alike, and what short texts leave goes to the longer ones."""
    out, left = [0] * len(lengths), budget
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    for k, i in enumerate(order):
        out[i] = min(lengths[i], left // (len(order) - k))
        left -= out[i]
    return out


def _pieces(seq: list[int], share: int) -> list[list[int]]:
    """`share` symbols of a text, in pieces that lie evenly over it."""
    if share >= len(seq):
        return [seq] if seq else []
    n = max(1, round(share / PIECE))
    size = share // n
    starts = [(len(seq) - size) * k // max(1, n - 1) for k in range(n)]
    return [seq[a : a + size] for a in starts] if size else []


def train(samples: dict[str, list[str]]) -> Model:
    """A model of some texts of each language."""
    languages = sorted(samples)
    texts = {k: [_normalised(t) for t in samples[k]] for k in languages}
    seen: dict[str, int] = {}
    for k in languages:
        for t in texts[k]:
            for c in t:
                seen[c] = seen.get(c, 0) + 1
    seen.pop(" ", None)
    number = {c: i + 2 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))} | {" ": 0}
    most = min(SAMPLE_SYMBOLS, TABLE_BYTES // (4 * 2 * DENSE * max(1, len(languages))) - 1)
    tables, keys, values, roots, dead, sizes, base = [], [], [], [], [], [], 0
    for k in languages:
        seq: list[int] = []
        for text, share in zip(texts[k], _shares([len(x) for x in texts[k]], most), strict=True):
            for piece in _pieces([number[c] for c in text], share):
                seq += [*piece, -1]  # a break that no text has
        automaton = SuffixAutomaton(seq)
        n = len(automaton.next)
        to = np.full((n + 1, DENSE), -1, np.int64)
        for state, edges in enumerate(automaton.next):
            for c, q in edges.items():
                if c >= DENSE:
                    keys.append(base + state * DENSE << 21 | c)
                    values.append(base + q * DENSE)
                elif c >= 0:
                    to[state, c] = base + q * DENSE
        alone = np.where(to[0] >= 0, to[0], base + n * DENSE)
        tables.append(np.where(to >= 0, 2 * to, 2 * alone + 1).astype(np.int32).ravel())
        roots.append(base)
        dead.append(base + n * DENSE)
        sizes.append(len(seq))
        base += (n + 1) * DENSE
    letters = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            letters[cp] = number.get(low if len(low) == 1 else c, 1)
    table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
    hashed = _hash_table(np.array(keys, np.int64), np.array(values, np.int32))
    return Model(languages, letters, table, *hashed, np.array(roots, np.int32), np.array(dead, np.int32), np.array([log2(n + 2) for n in sizes]))


def _symbols(model: Model, raw: np.ndarray, offsets: np.ndarray, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: symbols, their count, and whether there is a letter. Of a run of others the first stays, but none at a text's begin."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    symbols = model.symbols[np.minimum(points, 0x10FFFF)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    space = symbols == 0
    keep = ~space
    keep[1:] |= ~space[:-1] & (owner[1:] == owner[:-1])
    if after_letter and len(keep):
        keep[0] = True
    lengths = np.bincount(owner[keep], minlength=len(offsets) - 1)
    letter = np.bincount(owner, weights=~space, minlength=len(offsets) - 1) > 0
    return symbols[keep], lengths, letter


def _parse(model: Model, symbols: np.ndarray, lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each text, by language, and the states at its end; `start` has the states before it.

    Whole lanes of a text are parsed side by side, all but the first from a guessed state. Then each lane that another state enters is parsed again
    from that one, until it comes to a state that it had there before: from there on all is as it was. This ends when every lane was entered as the
    one before left. What is left of the texts is parsed last.
    """
    n_langs, n_texts = len(model.languages), len(lengths)
    language, begins = np.arange(n_langs)[:, None], np.cumsum(lengths) - lengths
    lanes = lengths // LANE
    owner = np.repeat(np.arange(n_texts), lanes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = begins[owner] + within * LANE
    entered = np.where(within > 0, model.dead[:, None], start[:, owner]).astype(np.int32)
    ends, found = entered.copy(), np.zeros((n_langs, len(owner)), np.int64)
    later = np.flatnonzero(within > 0)
    trace = np.zeros((LANE if len(later) else 0, n_langs, len(owner)), np.int32)
    for j in range(LANE if len(owner) else 0):
        value = model.step(ends, symbols[begin + j], language)
        found += value & 1
        ends = value >> 1
        if len(later):
            trace[j] = value
    while len(later):
        lang, i = np.nonzero(entered[:, later] != ends[:, later - 1])
        if not len(lang):
            break
        lane = later[i]
        now = entered[lang, lane] = ends[lang, lane - 1]
        for j in range(LANE):
            value, spot = model.step(now, symbols[begin[lane] + j], lang), (j, lang, lane)
            found[lang, lane] += (value & 1) - (trace[spot] & 1)
            apart = value >> 1 != trace[spot] >> 1
            trace[spot] = value
            lang, lane, now = lang[apart], lane[apart], value[apart] >> 1
            if not len(lane):
                break
        ends[lang, lane] = now
    counts = np.zeros((n_langs, n_texts), np.int64)
    for k in range(n_langs):
        counts[k] = np.bincount(owner, weights=found[k], minlength=n_texts)
    state = start.astype(np.int32)
    state[:, lanes > 0] = ends[:, np.cumsum(lanes)[lanes > 0] - 1]

    rest = lengths % LANE
    order = np.argsort(-rest, kind="stable")
    begin, left, more = (begins + lanes * LANE)[order], state[:, order], np.zeros((n_langs, n_texts), np.int64)
    active = np.searchsorted(-rest[order], -np.arange(LANE), "left")
    for j in range(int(rest.max(initial=0))):
        k = active[j]
        value = model.step(left[:, :k], symbols[begin[:k] + j], language)
        more[:, :k] += value & 1
        left[:, :k] = value >> 1
    counts[:, order] += more
    state[:, order] = left
    return counts, state


def phrases(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: phrases by language, symbols, and whether there is a letter. A letter that a language doesn't have is a phrase."""
    if len(offsets) == 2 and len(raw) > READ:
        return _long_phrases(model, raw)
    symbols, lengths, letter = _symbols(model, raw, offsets)
    start = np.repeat(model.dead[:, None], len(lengths), axis=1)
    return _parse(model, symbols, lengths, start)[0], lengths, letter


def _long_phrases(model: Model, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`phrases` of one long text, read piece by piece; states go from each to the next."""
    state, at, after_letter = model.dead[:, None], 0, False
    counts, lengths, letter = np.zeros((len(model.languages), 1), np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
    while at < len(raw):
        end = min(at + READ, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        piece = raw[at:end]
        symbols, n, some = _symbols(model, piece, np.array([0, len(piece)]), after_letter)
        more, state = _parse(model, symbols, n, state)
        counts, lengths, letter, at = counts + more, lengths + n, letter | some, end
        after_letter = bool(len(symbols)) and bool(symbols[-1]) if len(symbols) else after_letter
    return counts, lengths, letter


def predict(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ties go to the language that is first by code point."""
    counts, lengths, letter = phrases(model, raw, offsets)
    if not model.languages:
        return [UNDETERMINED] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
    bits = counts * model.cost[:, None]
    best = bits.argmin(axis=0)
    low = np.sort(bits, axis=0)
    score = low[1] / np.maximum(low[0] + low[1], 1e-9) if len(bits) > 1 else np.ones(len(best))
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, score, 0.0)


def _sampled(text: str) -> Column:
    """At most SAMPLE_CHARS code points of a text, in pieces from its begin to its end."""
    size = SAMPLE_CHARS // PIECES
    parts = [F.substring(text, F.expr(f"1 + (length({text}) - {size}) * {k} div {PIECES - 1}"), F.lit(size)) for k in range(PIECES)]
    return F.when(F.length(text) > SAMPLE_CHARS, F.concat_ws(" ", *parts)).otherwise(F.col(text))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample: of each language the SAMPLE_DOCS learnable documents with the least hash of their id.

    Of a text longer than SAMPLE_CHARS code points, PIECES pieces that make as many are taken evenly from all of it. Of these, SAMPLE_SYMBOLS
    symbols a language are learnt (fewer if the dense tables of all languages would go beyond TABLE_BYTES), shared alike by its
    documents: 416 each of 48 long ones.
    """
    rows = pick(df, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    least = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("k", F.row_number().over(least)).where(F.col("k") <= SAMPLE_DOCS)
    wanted = sorted({r["doc_id"] for r in chosen.select("doc_id").collect()})
    samples: dict[str, list[tuple[int, str]]] = {}
    if wanted:
        for r in usable.where(F.col("doc_id").isin(wanted)).select("doc_id", "lang", _sampled("text").alias("text")).distinct().collect():
            samples.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    return train({k: [t for _, t in sorted(v)] for k, v in samples.items()})


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language whose sample parses each whole text into the fewest normalised phrases.

    A phrase is the longest match of what follows in the language's suffix automaton; phrases count as log2 of the sample's
    size in bits. Letters count in lower case, everything else as single spaces (none at the start). score: the second language's bits over those
    of the best two, so 0.5 where they tie.

    Null texts and texts without a letter: `und` with score 0; so is every text if the model has no language. Repeated rows and null ids
    stay rows of their own; a null id is held out. Texts of any length are parsed whole. An empty table gives an empty result. Columns beyond id and
    text are not read.
    """
    rows = pick(df, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    shared, schema = df.sparkSession.sparkContext.broadcast(tuple(model)), arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for i, j in blocks(offsets, max(1 << 14, (1 << 21) // max(1, len(held.languages)))):
                lang, score = predict(held, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return rows.mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
