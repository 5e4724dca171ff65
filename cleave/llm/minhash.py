"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleave.llm.common import NON_SPACE, U64, blocks, mix, pick, small_batches, text_buffer, words
from cleave.operators.components import star_edges
from cleave.operators.skew import deal, skew_join, spread
from cleave.session import release, settle

#: Words of a shingle; links need 100 * intersection >= SIMILAR * union.
WORDS, SIMILAR = 5, 85
#: Coordinates of a sketch, in BANDS bands of ROWS. A link shares no band with (1 - 0.85**5)**32 < 1e-8, fewer than two with 2e-7.
COORDINATES, BANDS, ROWS = 160, 32, 5
#: Share of equal coordinates below which a candidate isn't verified: 0.185 under the limit, a chance below 1e-7 at 160.
LIKELY = 0.665
#: Members of a bucket, and shingles of them, that are compared in one block.
BLOCK, BLOCK_SHINGLES = 1000, 1_500_000
#: Rounds in which members of crowded buckets meet the members of one block each, as long as that joins components.
ROUNDS = 4
#: Packed texts that a task remembers, so that rows which repeat are sent once.
RECENT = 1 << 14
_C = mix(np.arange(1, WORDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, and n + 1 offsets. Fewer words than a shingle: all as one."""
    _, _, h, at = words(raw, offsets, NON_SPACE)
    n = len(h)
    whole = np.zeros(max(n - WORDS + 1, 0), U64)
    for k in range(WORDS):
        if len(whole):
            whole += h[k : n - WORDS + 1 + k] * _C[k]
    whole = mix(whole)
    parts, counts = [], np.zeros(len(offsets), np.int64)
    for d in range(len(offsets) - 1):
        a, b = at[d], at[d + 1]
        if b - a >= WORDS:
            one = np.unique(whole[a : b - WORDS + 1])
        elif b > a:
            one = mix((h[a:b] * _C[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a))
        else:
            continue
        parts.append(one)
        counts[d + 1] = len(one)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.cumsum(counts)


def sketch(x: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches (t 16-bit coordinates) of sets of hashes, none of them empty.

    In rounds 1 to t each element is thrown into a random bin, and a bin that was empty keeps the least value thrown into it;
    in rounds t + 1 to 2t all elements go to one bin after the other, so that every bin fills. A set is done as soon as its
    bins are full, after about t log t / n rounds.
    """
    n = len(offsets) - 1
    full = ~U64(0)
    best = np.full(n * t, full, U64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for r in range(2 * t):
        v = mix(x ^ mix(np.array([r + 1], U64) * U64(0xD1342543DE82EF95))[0])
        if r < t:
            cells = owner * t + (v % U64(t)).astype(np.int64)
        else:
            cells = owner * t + (r - t)
        v >>= U64(1)  # never the value of an empty bin
        if r:
            open_ = best[cells] == full
            cells, v = cells[open_], v[open_]
            round_ = np.full(n * t, full, U64) if len(cells) > n * t // 8 else None
        else:
            round_ = None
        if r == 0:
            np.minimum.at(best, cells, v)
        elif round_ is not None:
            np.minimum.at(round_, cells, v)
            np.minimum(best, round_, out=best)
        else:
            order = np.lexsort((v, cells))
            cells, v = cells[order], v[order]
            first = np.ones(len(cells), bool)
            first[1:] = cells[1:] != cells[:-1]
            best[cells[first]] = v[first]
        left = (best.reshape(n, t) == full).any(axis=1)
        if not left.any():
            break
        keep = left[owner]
        x, owner = x[keep], owner[keep]
    return (mix(best) & U64(0xFFFF)).astype(np.uint16).reshape(n, t)


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary column with `rows` where `valid`, else null."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.concatenate([[0], np.cumsum(valid * width)]).astype(np.int32)
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(valid), [bits, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


SKETCHED = "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, sketch binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = text_buffer(b.column(2))
        for i, j in blocks(offsets):
            sets, at = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.diff(at)
            some = n > 0
            starts = at[:-1][some]
            if len(starts):
                digest = np.stack([np.add.reduceat(mix(sets + U64(s)), starts) for s in (0x1234567, 0x89ABCDEF01)], 1) + n[some][:, None].astype(U64)
                drawn = sketch(sets, np.concatenate([starts, at[-1:]]))
            else:
                digest, drawn = np.zeros((0, 2), U64), np.zeros((0, COORDINATES), np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), _binary(digest, some), _binary(drawn, some)], names=["doc_id", "text_key", "n_shingles", "digest", "sketch"])


PACKED = "doc_id bigint, text_key bigint, packed binary"


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through shuffles; repeated rows of a task mostly once."""
    pack, recent = zstandard.ZstdCompressor(level=1).compress, {}
    for b in batches:
        raw, offsets = text_buffer(b.column(2))
        ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j in blocks(offsets, 8 << 20):
            at = []
            for k in range(i, j):
                name = ids[k], keys[k]
                if name not in recent:
                    recent[name] = None
                    at.append(k)
            while len(recent) > RECENT:
                del recent[next(iter(recent))]
            packed = [pack(raw[offsets[k] : offsets[k + 1]].tobytes()) for k in at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "packed"])


def _unpacked(packed: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each packed text; equal neighbours are unpacked once."""
    unpack, last, found = zstandard.ZstdDecompressor().decompress, None, None
    for x in packed:
        x = x.as_py()
        if x != last:
            raw = np.frombuffer(unpack(x), np.uint8)
            last, found = x, shingles(raw, np.array([0, len(raw)]))[0]
        yield found


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both) > 0


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts, those that are similar. Rows come sorted by the second one."""
    for b in batches:
        keep = pa.array([_similar(x, y) for x, y in zip(_unpacked(b.column(2)), _unpacked(b.column(3)), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])


class Block(NamedTuple):
    """Members that are compared: ids, set sizes, components, sketches. The first `split` meet the others, or, if that is all, each other."""

    nid: np.ndarray
    n: np.ndarray
    comp: np.ndarray
    sketch: np.ndarray
    split: int


def _likely(block: Block, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): for a member x the likely partners of other components, if the first band that they share is this one."""
    n = len(block.nid)
    whole = block.split == n
    far = slice(0 if whole else block.split, n)
    sketch, size, comp = block.sketch[far], block.n[far], block.comp[far]
    bands = block.sketch.reshape(n, BANDS, ROWS)
    for x in range(block.split):
        ok = comp != block.comp[x]
        ok &= 100 * np.minimum(block.n[x], size) >= SIMILAR * np.maximum(block.n[x], size)
        if whole:
            ok[x:] = False
        ys = np.flatnonzero(ok)
        ys = ys[(sketch[ys] == block.sketch[x]).sum(axis=1) >= LIKELY * COORDINATES]
        if band and len(ys):
            ys = ys[~(bands[far][ys, :band] == bands[x, :band]).all(axis=2).any(axis=1)]
        if len(ys):
            yield x, ys + far.start


class Sets:
    """The shingle sets of a block as numbers in one array, so that one set meets all others by marks."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.numbers, self.marks = numbers.astype(np.int32), np.zeros(len(names), np.int32)

    def similar(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Which of the sets `ys` are similar to the set `x`."""
        mine = self.numbers[self.at[x] : self.at[x + 1]]
        self.marks[mine] = 1
        if len(ys) * 8 < len(self.sizes):
            both = np.array([self.marks[self.numbers[self.at[y] : self.at[y + 1]]].sum() for y in ys.tolist()])
        else:
            both = np.add.reduceat(self.marks[self.numbers], self.at[:-1])[ys]  # no set is empty
        self.marks[mine] = 0
        return 100 * both >= SIMILAR * (self.sizes[x] + self.sizes[ys] - both)


def _links(block: Block, band: int, sets: Sets) -> Iterator[tuple[int, int]]:
    """Links that join all components of the block that a confirmed likely pair joins; pairs that are joined by then aren't compared."""
    comp = block.comp.copy()
    for x, ys in _likely(block, band):
        ys = ys[comp[ys] != comp[x]]
        if len(ys):
            for y in ys[sets.similar(x, ys)].tolist():
                if comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    yield int(block.nid[x]), int(block.nid[y])


BLOCKED = ["key", "lo", "hi", "side", "band", "nid", "n", "comp", "sketch"]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks out of rows sorted by block; one block is held at most, beside a batch."""
    held: list[pa.RecordBatch] = []
    for b in _with_end(batches):
        if b is not None and not b.num_rows:
            continue
        if b is None:
            if held:
                yield pa.Table.from_batches(held)
            return
        name = [np.concatenate([held[-1].column(k).to_numpy()[-1:] if held else [], b.column(k).to_numpy()]) for k in range(3)]
        new = np.zeros(len(name[0]), bool)
        for c in name:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new) - (1 if held else 0)  # where blocks begin within the batch
        if not len(at):
            held.append(b)
            continue
        done = held + ([b.slice(0, at[-1])] if at[-1] else [])
        if done:
            yield pa.Table.from_batches(done)
        held = [b.slice(at[-1])]


def _over_blocks(exact: bool):
    """Over rows sorted by (key, lo, hi, side): members (key, nid) of likely pairs; or, of rows with texts, links (u, v) that join all similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(batches):
            c = {k: t.column(k).to_numpy() for k in BLOCKED[:-1]}
            new = np.flatnonzero((np.diff(c["key"]) != 0) | (np.diff(c["lo"]) != 0) | (np.diff(c["hi"]) != 0)) + 1
            edges, first, second = [0, *new.tolist(), t.num_rows], [], []
            for i, j in zip(edges, edges[1:], strict=False):
                crossed = c["lo"][i] != c["hi"][i]
                split = int(np.searchsorted(c["side"][i:j], 1)) if crossed else j - i
                if j - i < 2 or crossed and split in (0, j - i):
                    continue
                at = slice(i, j)
                sketch = np.frombuffer(b"".join(t.column("sketch").slice(i, j - i).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                block, band = Block(c["nid"][at], c["n"][at], c["comp"][at], sketch, split), int(c["band"][i])
                if exact:
                    for u, v in _links(block, band, Sets(list(_unpacked(t.column("packed").slice(i, j - i))))):
                        first.append(u)
                        second.append(v)
                else:
                    some = np.zeros(j - i, bool)
                    for x, ys in _likely(block, band):
                        some[x] = some[ys] = True
                    first += [int(c["key"][i])] * int(some.sum())
                    second += block.nid[some].tolist()
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["u", "v"] if exact else ["key", "nid"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose word-shingle sets are at least 0.85 similar.

    1. One pass over the texts gives each row's set size, a digest of its set and its sketch. Rows of one digest are one
       node, so copies are never paired.
    2. Bands of sketches make buckets. Each node is paired with one node only: the least of a bucket, from the buckets that
       agree most. Pairs are verified on full sets; links make components.
    3. Buckets that still hold several components are compared inside tasks, in blocks of bounded size, on sketches: this leaves the
       members that have a likely partner in another component. These come again with their texts, and every likely pair that
       crosses components is verified on full sets inside its block, which returns only links that join something.
       In a large bucket, only members outside its largest component meet all others, so rows grow as members; see `_blocks_of`.
    So a large group of copies costs links in proportion to its size, and no likely pair that would join two components
    stays unverified. Hot keys of joins are dealt in parts.

    Null or wordless texts have an empty set and are linked with nothing. Texts of any length count whole. Repeated rows and ids: rows are
    nodes by text, and a component takes the least id among its rows; null ids are passed over (a component of null ids only has a
    null one, and its rows are kept). An empty table gives an empty result. Columns beyond id and text are not read.

    with_keys: also text_key, the xxhash64 of the text, and root, a number that components share with no other (null: no words).
    """
    small_batches(df.sparkSession)
    docs = pick(df, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = settle(docs.select("doc_id", "text_key", "text").mapInArrow(_sketch_batches, SKETCHED))
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    nodes = settle(nodes.select(F.monotonically_increasing_id().alias("nid"), "digest", "least", "rep", "n", "sketch"))

    bands = nodes.select("nid", "n", F.posexplode(F.array(*[_band(k) for k in range(BANDS)])).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min(F.struct("nid", "n")).alias("first"), F.count("*").alias("__n")).where("__n > 1")
    met = skew_join(bands, shared.drop("__n"), "key", place=F.struct("nid", "band"), sizes=shared)
    members = settle(met.select("key", "band", "nid", "n", F.col("first.nid").alias("first"), F.col("first.n").alias("first_n")), 200_000)

    size_fits = 100 * F.least("n", "first_n") >= SIMILAR * F.greatest("n", "first_n")
    agree = members.where(F.col("nid") != F.col("first")).where(size_fits).groupBy("nid", "first").agg(F.count("*").alias("bands"))
    star = agree.groupBy("nid").agg(F.max(F.struct("bands", (-F.col("first")).alias("back"))).alias("b")).select(F.col("nid").alias("u"), (-F.col("b.back")).alias("v"))
    release(df.sparkSession)
    stars = star_edges(settle(_verified(docs, nodes, settle(star))))
    release(df.sparkSession)
    stars = _joined(docs, nodes, members.select("key", "band", "nid", "n"), stars)
    release(df.sparkSession)

    by_node = nodes.select("nid", "least").join(stars.select(F.col("u").alias("nid"), F.col("v").alias("root")), "nid", "left").select("nid", "least", F.coalesce("root", "nid").alias("root"))
    least = by_node.groupBy("root").agg(F.min("least").alias("component"))
    of_node = skew_join(by_node, least, "root", place=F.col("nid")).select("nid", "component", "root")
    of_digest = nodes.select("nid", "digest").join(of_node, "nid").select("digest", "component", "root")
    out = skew_join(rows.select("doc_id", "n_shingles", "digest", "text_key"), of_digest, "digest", how="left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"), *(["text_key", "root"] if with_keys else []))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, a table, that stand for their near-duplicate group: one of each, all columns.

    It is that with the least id, nulls last, and of rows of one id that with the least hash of its text; of rows equal in both, that with the least
    hash of all columns. Wordless texts are linked with nothing: one row stays of each id and text, and all rows of null ids.
    """
    found = settle(near_duplicates(df, id_col, text_col, with_keys=True), 200_000)
    name = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key"]
    worded = found.where("root IS NOT NULL").select("root", *name).groupBy("root").agg(F.min(F.struct("no_id", "id", "text_key")).alias("r")).select("r.*")
    wordless = found.where("root IS NULL").select(*name).distinct()
    chosen = worded.withColumn("all", F.lit(False)).unionByName(wordless.withColumn("all", F.col("no_id")))
    keys = ["id", "no_id", "text_key"]
    times = found.select(*name).groupBy(*keys).agg(F.count("*").alias("__n"))
    chosen = settle(chosen.join(times, keys), 200_000)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    names, at = flat.columns, {c: F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col)}
    doc_id = at[id_col].cast("bigint")
    rows = flat.select("*", F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.xxhash64(at[text_col]).alias("text_key"))
    plain, several = F.col("all") | (F.col("__n") == 1), chosen.where("NOT all AND __n > 1")
    out = skew_join(rows, chosen.where(plain).select(*keys), *keys, sizes=chosen.where(plain)).select(*names)
    if not several.isEmpty():
        repeated = skew_join(rows, several.select(*keys), *keys, sizes=several)
        one = repeated.groupBy(*keys).agg(F.min(F.struct(F.xxhash64(*names).alias("hash"), F.to_json(F.struct(*names)).alias("json"), F.struct(*names).alias("row"))).alias("r"))
        out = out.unionByName(one.select("r.row.*"))
    return out.toDF(*df.columns)


def _band(k: int) -> Column:
    """The bucket of band k."""
    return F.xxhash64(F.lit(k), F.substring("sketch", 1 + k * 2 * ROWS, 2 * ROWS))


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(nid, packed): the packed text of each asked node."""
    wanted = asked.join(nodes.select("nid", "rep"), "nid").select("nid", "rep.doc_id", "rep.text_key")
    packed = docs.mapInArrow(_pack_batches, PACKED)
    same = F.col("a.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("a.text_key") == F.col("d.text_key"))
    return packed.alias("d").join(wanted.alias("a"), same).select("nid", "packed").groupBy("nid").agg(F.first("packed").alias("packed"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the node pairs (u, v) that the full sets confirm. A node v of many pairs is sent to many tasks."""
    texts = _texts(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("nid")).distinct())
    left, right = texts.select(F.col("nid").alias("u"), F.col("packed").alias("text_u")), texts.select(F.col("nid").alias("v"), F.col("packed").alias("text_v"))
    dealt, hot = deal(pairs, "v")
    both = dealt.join(left, "u").join(spread(right, hot, "v"), ["v", "__part"])
    return both.select("u", "v", "text_u", "text_v").mapInArrow(_verify_batches, "u bigint, v bigint")


def _joined(docs: DataFrame, nodes: DataFrame, members: DataFrame, stars: DataFrame) -> DataFrame:
    """The stars after every likely pair of two components that shares a bucket was verified.

    A bucket is done after one pass, unless it is crowded: more members than a block outside its largest component. In a crowded one each
    member meets one block of others in a pass; passes go on while they join components, ROUNDS at most. What is crowded then
    is dealt by a second band that two members share, and what even so is crowded by all pairs of blocks.
    """
    for turn in range(ROUNDS):
        mixed = settle(_mixed(members, stars))
        if mixed.isEmpty():
            return stars
        before, stars = stars, _pass(docs, nodes, members, stars, mixed, turn)
        crowded = mixed.where("parts > 1 AND other_parts > 1").select("key")
        if crowded.isEmpty():
            return stars
        members = settle(members.join(crowded, "key", "left_semi"))
        if stars is before:
            break
    sub = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64("key", _band(k)).alias("key")) for k in range(BANDS)])).alias("s")
    finer = members.join(nodes.select("nid", "sketch"), "nid").select("band", "nid", "n", "key", "sketch").select("band", "nid", "n", sub)
    finer = settle(finer.where("s.k <> band").select(F.col("s.key").alias("key"), F.lit(0).alias("band"), "nid", "n"))
    return _pass(docs, nodes, finer, stars, settle(_mixed(finer, stars)), None)


def _pass(docs: DataFrame, nodes: DataFrame, members: DataFrame, stars: DataFrame, mixed: DataFrame, turn: int | None) -> DataFrame:
    """The stars after one pass over the blocks of `members`; the same object if no link was found."""
    marked = settle(_blocks_of(nodes, members, stars, mixed, turn).mapInArrow(_over_blocks(exact=False), "key bigint, nid bigint"))
    if marked.isEmpty():
        return stars
    left = settle(members.join(marked.distinct(), ["key", "nid"], "left_semi"))
    texts = _texts(docs, nodes, left.select("nid").distinct())
    links = settle(_blocks_of(nodes, left, stars, settle(_mixed(left, stars)), turn, texts).mapInArrow(_over_blocks(exact=True), "u bigint, v bigint"))
    return stars if links.isEmpty() else star_edges(stars.unionByName(links))


def _placed(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Members with the component that they are in so far."""
    root = stars.select(F.col("u").alias("nid"), F.col("v").alias("root"))
    return members.join(root, "nid", "left").select("key", "band", "nid", "n", F.coalesce("root", "nid").alias("comp"))


def _mixed(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Buckets with several components: members, the largest component, and into how many blocks all members and those outside it go."""
    by_comp = _placed(members, stars).groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = F.max(F.struct("c", "s", "comp"))
    by_key = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("s").alias("s"), most.alias("most")).where("comps > 1")
    parts = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    others = parts(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s"))
    return by_key.select("key", F.col("c").alias("__n"), F.col("most.comp").alias("largest"), parts(F.col("c"), F.col("s")).alias("parts"), others.alias("other_parts"))


def _blocks_of(nodes: DataFrame, members: DataFrame, stars: DataFrame, mixed: DataFrame, turn: int | None, texts: DataFrame | None = None) -> DataFrame:
    """Members of mixed buckets, dealt in blocks (key, lo, hi): sides 0 and 1 of a block meet, or, if lo is hi, all of it.

    A bucket that fits is one block. Of a large one, parts of the largest component meet the others: the former are dealt
    once, the others to all parts, so both come to about as many rows as the bucket has members if the others fit one block. If they don't, the bucket is crowded:
    each member goes to one block, another one at each `turn`; or, with no `turn`, all pairs of parts of the others meet too.
    """
    held = skew_join(_placed(members, stars), mixed.drop("__n"), "key", place=F.struct("nid", "band"), sizes=mixed)
    parts, others, at = F.col("parts"), F.col("other_parts"), lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    mine = F.pmod(F.xxhash64("nid"), parts).cast("int")
    far = parts + F.pmod(F.xxhash64("nid"), others).cast("int")
    each = lambda n, f: F.transform(F.sequence(zero, n - 1), f)
    with_largest = each(parts, lambda p: at(p, far, one))
    with_others = each(others, lambda q: at(F.least(far, parts + q), F.greatest(far, parts + q), (far > parts + q).cast("int")))
    dealt = F.when(F.col("comp") == F.col("largest"), each(others, lambda q: at(mine, parts + q, zero))).otherwise(F.concat(with_largest, with_others))
    if turn is not None:
        own = F.pmod(F.xxhash64("nid", F.lit(turn)), parts).cast("int")
        dealt = F.when(others > 1, F.array(at(own, own, zero))).otherwise(dealt)
    dealt = F.when(parts <= 1, F.array(at(zero, zero, zero))).otherwise(dealt)
    rows = held.select("key", "band", "nid", "n", "comp", F.explode(dealt).alias("b")).select("key", "b.lo", "b.hi", "b.side", "band", "nid", "n", "comp")
    rows = rows.join(nodes.select("nid", "sketch"), "nid")
    rows = rows.select(*BLOCKED) if texts is None else rows.join(texts, "nid").select(*BLOCKED, "packed")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "nid")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, e.y FROM t JOIN e ON t.b = e.x) SELECT a, min(b) AS m FROM t GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id
"""
