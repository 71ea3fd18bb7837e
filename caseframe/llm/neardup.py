"""Near-duplicates by a chosen-path set similarity join over minhash tokens.

1. Every document becomes its set of five-word shingles, a digest of that set,
   and ``SIZE`` minwise tokens. Documents with equal sets form one class.
2. Independent trees branch the classes: a node selects minwise positions, and
   its documents go to a child for each selected position's value. Small nodes
   are compared exhaustively on their tokens; larger ones branch again, within
   the task while they fit there and through another exchange while they don't.
   A late node that branching doesn't part is compared in all pairs of chunks.
3. Plausible pairs join classes to candidate groups. Each group's texts meet in
   one task, which confirms links on the full sets of all its documents. Groups
   too large for a task are cut to chunks: a first round joins what is linked
   within a chunk or to some pivots that are in all chunks; then every two
   chunks meet whose set sizes allow a link, except those within the largest
   group of the first round, whose members are connected already.
4. Connected components of the confirmed links are the near-duplicate groups.

Vertices are classes of equal sets, named by the first of their rows' own
numbers, so that rows may share a doc_id and ids may be of any size.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseframe.llm.columns import shield
from caseframe.sources import scratch

SHINGLE = 5
#: A link has 100 * intersection >= LINK * union.
LINK = 75
#: Minwise tokens of a document. Only their low four bits are compared.
SIZE = 128
#: Positions selected at the root, one tree each or two. At similarity 0.75 a
#: link between classes survives no tree with a chance of 0.25 ** 16.
ROOTS = 16
#: Token pairs that agree at least so often are plausible: 0.55 similarity plus chance agreement.
PLAUSIBLE = int(SIZE * (0.55 * 15 / 16 + 1 / 16))
#: Nodes up to SMALL are compared at once, those up to FITS within a task.
SMALL, FITS = 256, 4096
#: Levels of branching within a task, and through exchanges before nodes that keep over DENSE of their parent are cut to chunks.
DEPTH, EXCHANGES = 4, 3
DENSE = 0.8
#: Most classes, and most shingles, of a candidate group that one task confirms as a whole.
GROUP, WEIGHT = 4096, 1 << 21
#: Classes of an oversized group that meet all of its others in the first round.
PIVOTS = 64
#: Sizes of linked sets are at most 100 / LINK apart, so that they lie in one band of this ratio or in two adjacent ones.
BAND = 1.34

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.random.default_rng(20240917).integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M2
        h = (h ^ (h >> np.uint64(27))) * _M3
        return h ^ (h >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, cached; a full cache is emptied."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; fewer than five words make one, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(ids))
    with np.errstate(over="ignore"):
        h = np.full(len(ids) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            h = _mix(h * _M1 + ids[k : len(ids) - width + 1 + k])
    return np.unique(h)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """For each position the smallest of the set's hashes under that position's function, 32 bits."""
    low = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        with np.errstate(over="ignore"):
            low = np.minimum(low, (hashes[at : at + 2048, None] * _FACTORS[None, :]).min(axis=0))
    # The winners are hashed once more, so that their low bits are uniform too.
    return (_mix(low) >> np.uint64(32)).astype(np.uint32)


def _fixed(values: np.ndarray) -> pa.Array:
    """An Arrow binary array of the rows of a C-ordered byte matrix."""
    n, width = values.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


SIGNED = "row long, doc_id long, n_shingles long, digest binary, tokens binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, tokens, sizes = [], [], []
        for text in batch.column(2).to_pylist():
            s = shingles(text)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            tokens.append(minwise(s).tobytes() if len(s) else None)
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_shingles", "digest", "tokens"])


NODES = "node long, rep long, nibbles binary"


def _node_ids(salt: np.ndarray, position: int, value: np.ndarray) -> np.ndarray:
    """Id of the child of nodes ``salt`` that holds ``value`` at ``position``."""
    with np.errstate(over="ignore"):
        return _mix(_mix(salt * _M1 + np.uint64(position + 1)) + value.astype(np.uint64) * _M2)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root children of each class in every tree; root positions are spread over the tokens."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, SIZE)
        low = (tokens & np.uint32(15)).astype(np.uint8)
        packed = low[:, ::2] | (low[:, 1::2] << np.uint8(4))
        zero = np.zeros(n, dtype=np.uint64)
        for r in range(ROOTS):
            p = r * (SIZE // ROOTS)
            yield pa.RecordBatch.from_arrays([pa.array(_node_ids(zero, p, tokens[:, p]).view(np.int64)), batch.column(0), _fixed(packed)], ["node", "rep", "nibbles"])


def _unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), SIZE), dtype=np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


class _Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _exhaust(rows: np.ndarray, tokens: np.ndarray, forest: _Forest, found: list[tuple[int, int]]) -> None:
    """Compare ``rows`` on their tokens; plausible pairs that join two trees of the forest are found.

    Breadth first: a row that is reached is compared with those that are not
    yet, which connects what all pairs connect; copies of one text cost little.
    """
    left = rows
    held = tokens[left]
    while len(left) > 1:
        reached = [(int(left[0]), held[0])]
        left, held = left[1:], held[1:]
        while reached and len(left):
            a, own = reached.pop()
            near = (held == own).sum(axis=1, dtype=np.int32) >= PLAUSIBLE
            if not near.any():
                continue
            for b, one in zip(left[near].tolist(), held[near], strict=True):
                reached.append((b, one))
                if forest.join(a, b):
                    found.append((a, b))
            left, held = left[~near], held[~near]


def _branch(node: int, depth: int) -> list[int]:
    """Positions that a node selects, by its id: one, or two for every third node (1 / 0.75 on average)."""
    h = xxhash.xxh3_64_intdigest(node.to_bytes(8, "little"), seed=depth)
    first = h % SIZE
    return [first, (first + 1 + (h >> 16) % (SIZE - 1)) % SIZE] if (h >> 40) % 3 == 0 else [first]


def _exchanged(node: int, level: int) -> list[int]:
    """Positions that a node selects at an exchange: those of no root, and others at each of seven levels."""
    return sorted({p - p % (SIZE // ROOTS) + 1 + level % (SIZE // ROOTS - 1) for p in _branch(node, 100 + level)})


def _descend(node: int, rows: np.ndarray, tokens: np.ndarray, depth: int, forest: _Forest, found: list[tuple[int, int]]) -> None:
    if len(rows) <= SMALL or depth >= DEPTH:
        _exhaust(rows, tokens, forest, found)
        return
    for p in _branch(node, depth):
        values = tokens[rows, p]
        for v in range(16):
            inside = rows[values == v]
            if len(inside) > 1:
                child = int(_node_ids(np.array([node], dtype=np.uint64), p, np.array([v], dtype=np.uint64))[0])
                # A child that keeps nearly all rows is a dense node: branching can't part it.
                _descend(child, inside, tokens, DEPTH if len(inside) > DENSE * len(rows) else depth + 1, forest, found)


LEVEL = "kind int, a long, b long, nibbles binary, family long"


def _level(level: int, last: bool | None = None, whole: bool = False):
    """Runs of equal nodes: pairs (kind 0: a, b) of those that fit the task, children (kind 1: node, rep, nibbles, family) of the others.

    The last level has no children: each of its runs is held at once, and ``whole`` compares all of its pairs.
    """
    last = level >= EXCHANGES if last is None else last

    def emit(kind: int, a: np.ndarray, b: np.ndarray, packed: np.ndarray | None, family: int | None = None) -> pa.RecordBatch:
        bits = _fixed(packed) if packed is not None else pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), bits, pa.array([family] * len(a), pa.int64())], ["kind", "a", "b", "nibbles", "family"])

    def children(node: int, reps: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        tokens = _unpack(packed)
        for p in _exchanged(node & (2**64 - 1), level):
            salt = np.full(len(reps), node, dtype=np.int64).view(np.uint64)
            # Children of one node at one position are a family; no token is SIZE.
            family = _node_ids(salt[:1], p, np.array([SIZE])).view(np.int64)
            yield emit(1, _node_ids(salt, p, tokens[:, p]).view(np.int64), reps, packed, int(family[0]))

    def solve(node: int, reps: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        _descend(node & (2**64 - 1), np.arange(len(reps)), _unpack(packed), DEPTH if whole else 0, _Forest(len(reps)), found)
        pairs = np.array([(reps[x], reps[y]) for x, y in found if reps[x] != reps[y]], dtype=np.int64).reshape(-1, 2)
        if len(pairs):
            yield emit(0, pairs.min(axis=1), pairs.max(axis=1), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, packed, nodes = np.empty(0, dtype=np.int64), np.empty((0, SIZE // 2), dtype=np.uint8), np.empty(0, dtype=np.int64)
        large: int | None = None  # the node whose rows have begun to go to children
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            nodes = np.concatenate([nodes, batch.column(0).to_numpy()])
            reps = np.concatenate([reps, batch.column(1).to_numpy()])
            packed = np.concatenate([packed, np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(n, SIZE // 2)])
            starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            ends = np.r_[starts[1:], len(nodes)]
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                if e == len(nodes) or nodes[s] == large:
                    continue  # the last run may go on
                yield from solve(int(nodes[s]), reps[s:e], packed[s:e])
            s = int(starts[-1])
            if large is not None and len(starts) > 1 or large is not None and nodes[0] == large:
                e = int(ends[0]) if nodes[0] == large else 0
                if e:
                    yield from children(large, reps[:e], packed[:e])
                    s = max(s, e)
            if not last and s < len(nodes) and len(nodes) - s > FITS:
                large = int(nodes[s])
                yield from children(large, reps[s:], packed[s:])
                s = len(nodes)
            nodes, reps, packed = nodes[s:], reps[s:], packed[s:]
        if len(nodes) > 1 and nodes[0] != large:
            yield from solve(int(nodes[0]), reps, packed)
        elif len(nodes) and nodes[0] == large:
            yield from children(large, reps, packed)

    return run


def _rounds(classes: DataFrame) -> DataFrame:
    """Plausible pairs (a, b), a < b, of all trees; they join each node's plausible classes, without being all its pairs."""
    nodes = classes.select("rep", "tokens").mapInArrow(_roots, NODES).withColumn("family", F.lit(None).cast("long"))
    found = classes.sparkSession.createDataFrame([], "a long, b long")

    def compared(rows: DataFrame, level: int, last: bool, whole: bool = False) -> DataFrame:
        spread = rows.select("node", "rep", "nibbles").repartition("node").sortWithinPartitions("node", F.xxhash64(F.lit(level), "rep"))
        return scratch.keep(spread.mapInArrow(_level(level, last, whole), LEVEL), "pairs")

    for level in itertools.count():
        if level >= EXCHANGES:
            # Nodes that parted from their parent branch on until they fit; the others are cut to blocks.
            sizes = nodes.groupBy("node", "family").agg(F.count("*").alias("n"))
            parents = sizes.groupBy("family").agg(F.sum("n").alias("all"))
            dense = scratch.keep(sizes.where(F.col("n") > FITS).join(parents, "family").where(F.col("n") > DENSE * F.col("all")).select("node"), "dense")
            if not dense.isEmpty():
                blocks = nodes.join(dense, "node", "left_semi").select("node", "rep", "nibbles", F.lit(0).alias("band"), F.lit(1).alias("side"), F.lit(1).alias("weight"))
                blocks = _blocks(blocks, "node", FITS)
                found = found.unionByName(compared(blocks, level, True, True).select("a", "b"))
                nodes = nodes.join(dense, "node", "left_anti")
        both = compared(nodes, level, False)
        found = found.unionByName(both.where("kind = 0").select("a", "b"))
        rest = both.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("rep"), "nibbles", "family")
        if rest.isEmpty():
            break
        nodes = rest
    return found.distinct()


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` (key, rep, band, side, weight and others), each once for every block that it is in, with the block's id as the key.

    The rows of a key, band and side are dealt to chunks of under half of
    ``size`` rows and of WEIGHT. Every two chunks of a key whose bands are equal
    or adjacent are a block, but for two of side 0, whose rows are connected.
    """
    place, kind = [key, "band", "side"], "array<struct<band:int,side:int,chunk:bigint>>"
    share = lambda value, most: F.ceil(value / max(1, most * 9 // 20)).cast("long")
    chunks = rows.groupBy(*place).agg(F.greatest(share(F.count("*"), size), share(F.sum("weight"), WEIGHT), F.lit(1)).alias("_k"))
    held = rows.join(chunks, place).withColumn("_c", F.pmod(F.xxhash64(key, "rep"), F.col("_k")))
    # What stands beside each place: the other places of its key, at most six with their numbers of chunks.
    other = chunks.select(key, F.col("band").alias("_band"), F.col("side").alias("_side"), F.col("_k").alias("_n"))
    beside = chunks.join(other, key).where("abs(band - _band) <= 1 and side + _side > 0").groupBy(*place).agg(F.collect_list(F.struct("_band", "_side", "_n")).alias("_beside"))
    held = held.join(beside, place, "left").withColumn("_beside", F.coalesce("_beside", F.expr("cast(array() as array<struct<_band:int,_side:int,_n:bigint>>)")))
    held = held.withColumn("_self", F.struct("band", "side", F.col("_c").alias("chunk")))
    met = f"flatten(transform(_beside, b -> transform(sequence(0L, b._n - 1), x -> named_struct('band', b._band, 'side', b._side, 'chunk', x))))"
    # A chunk meets itself in each block that it is in; alone only if it is in no other.
    met = f"filter(cast({met} as {kind}), x -> x <> _self)"
    held = held.withColumn("_met", F.expr(f"if(size({met}) = 0 and side > 0, array(_self), {met})"))
    block = F.explode(F.transform("_met", lambda x: F.xxhash64(F.col(key), F.least(x, F.col("_self")), F.greatest(x, F.col("_self")))))
    return held.withColumn(key, block).drop("band", "side", "weight", "_k", "_c", "_beside", "_self", "_met")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps; each is a min per node and a
    join back, and every step's links are written, so nothing is collected and
    no lineage grows. A node of very many links is pre-aggregated, and its join
    is split by the engine.
    """
    with scratch.recorded() as old:
        links = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    spark, before = links.sparkSession, None
    while True:
        # Large star: neighbours above a node go to its smallest neighbour or itself.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        with scratch.recorded() as new:
            links = scratch.keep(small, "links")
        scratch.drop(spark, old)
        old = new
        # Numbers of rows may be of any size, so hashes are added up, not they.
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _linked(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect what all links of ``sets`` connect, exactly.

    Breadth first: a set that is reached looks for links among those that are
    not yet, so copies of one text cost little. Postings hold open sets only;
    they are built anew whenever half of these are gone.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(codes) > 1
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    # Shingles of one set alone can't be common to two.
    shared = several[codes]
    codes, owner = np.unique(codes[shared], return_inverse=True)[1].astype(np.int32), owner[shared]
    start = np.searchsorted(owner, np.arange(m + 1))
    width = int(codes.max()) + 1 if len(codes) else 0
    is_open, left = np.ones(m, dtype=bool), m
    held = first = posted = None

    def post() -> None:
        nonlocal held, first, posted
        here = is_open[owner]
        by = np.argsort(codes[here], kind="stable")
        posted = owner[here][by]
        first = np.r_[0, np.cumsum(np.bincount(codes[here], minlength=width))]
        held = left

    for seed in range(m):
        if not is_open[seed]:
            continue
        is_open[seed], left, reached = False, left - 1, [seed]
        while reached and left:
            if held is None or 2 * left <= held:
                post()
            i = reached.pop()
            mine = codes[start[i] : start[i + 1]]
            counts = first[mine + 1] - first[mine]
            total = int(counts.sum())
            if not total:
                continue
            index = np.repeat(first[mine] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
            overlap = np.bincount(posted[index], minlength=m)
            near = np.flatnonzero(is_open & (100 * overlap >= LINK * (sizes + sizes[i] - overlap)))
            is_open[near] = False
            left -= len(near)
            reached += near.tolist()
            for j in near.tolist():
                yield i, j


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal groups (group, rep, text), on full sets."""

    def links(reps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = np.array([(reps[i], reps[j]) for i, j in _linked(sets)] if len(reps) > 1 else [], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], ["a", "b"])

    group, reps, sets = None, [], []
    for batch in batches:
        for g, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if g != group:
                if len(reps) > 1:
                    yield links(reps, sets)
                group, reps, sets = g, [], []
            # A block may be asked for twice with one row.
            if not reps or r != reps[-1]:
                reps.append(r)
                sets.append(shingles(t.as_py()))
    if len(reps) > 1:
        yield links(reps, sets)


def _meet(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Confirmed links (a, b) within each group of ``met`` (component, rep), whose texts ``rows`` (row, text) has."""
    # A merge join at every size: the groups grow with the input, so they are never broadcast.
    texts = rows.select(F.col("row").alias("rep"), "text").join(met.select("component", "rep").hint("merge"), "rep")
    placed = texts.repartition("component").sortWithinPartitions("component", "rep").select("component", "rep", "text")
    return scratch.keep(placed.mapInArrow(_confirm, "a long, b long"), "confirmed")


def _meet_large(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Links that connect what all links within groups too large for a task connect: ``large`` has component, rep, band, weight."""
    one = F.lit(1)
    # First round: each chunk with itself and the group's pivots.
    chunks = large.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / max(1, GROUP - PIVOTS)), F.ceil(F.sum("weight") / WEIGHT), one).cast("long").alias("_k"))
    order = Window.partitionBy("component").orderBy(F.xxhash64("rep"), "rep")
    pivots = large.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= min(PIVOTS, GROUP // 2)).select("component", "rep")
    dealt = large.join(chunks, "component").select("component", "rep", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("_k")).alias("_c"))
    everywhere = pivots.join(chunks, "component").select("component", "rep", F.explode(F.expr("sequence(0L, _k - 1)")).alias("_c"))
    first = dealt.unionByName(everywhere).distinct().select(F.xxhash64("component", "_c").alias("component"), "rep")
    links = _meet(rows, first)
    # Second round: what the largest group of the first one doesn't hold meets everything, also that group.
    found = components(links).withColumnsRenamed({"node": "rep", "component": "_in"})
    placed = scratch.keep(large.join(found, "rep", "left").withColumn("_in", F.coalesce("_in", "rep")), "placed")
    largest = placed.groupBy("component", "_in").agg(F.count("*").alias("_n")).groupBy("component").agg(F.max_by("_in", F.struct("_n", "_in")).alias("_most"))
    sided = placed.join(largest, "component").withColumn("side", F.when(F.col("_in") == F.col("_most"), 0).otherwise(1)).drop("_in", "_most")
    return links.unionByName(_meet(rows, _blocks(sided, "component", GROUP)))


def _grouped(rows: DataFrame, unknown: bool) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first for each of ``rows`` (row, doc_id, text), whose numbers are unique.

    ``first`` is true for one row of each group: that of the smallest doc_id,
    nulls last, and of those the one with the smallest number. Rows without a
    doc_id are in groups only if ``unknown``.
    """
    signed = scratch.keep(rows.select("row", "doc_id", "text").mapInArrow(_sign, SIGNED), "signed")
    known = F.lit(True) if unknown else F.col("doc_id").isNotNull()
    usable = signed.where(F.col("digest").isNotNull() & known)
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    classes = usable.groupBy("digest").agg(F.min("row").alias("rep"), lead.alias("lead"), F.max("tokens").alias("tokens"), F.max("n_shingles").alias("n_shingles"))
    classes = scratch.keep(classes, "classes")
    groups = components(_rounds(classes)).withColumnRenamed("node", "rep")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(BAND))).cast("int")
    groups = scratch.keep(groups.join(classes.select("rep", F.col("n_shingles").alias("weight"), band.alias("band")), "rep"), "groups")
    sizes = groups.groupBy("component").agg(((F.count("*") > GROUP) | (F.sum("weight") > WEIGHT) & (F.count("*") > 2)).alias("_large"))
    counted = groups.join(sizes, "component")
    links = _meet(rows, counted.where("not _large"))
    large = counted.where("_large").drop("_large")
    if not large.isEmpty():
        links = links.unionByName(_meet_large(rows, large))
    found = components(links).withColumnRenamed("node", "rep")
    labels = scratch.keep(classes.select("digest", "rep", "lead").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("rep"), "labels")
    leads = labels.groupBy("component").agg(F.min("lead").alias("lead"))
    labels = labels.drop("lead").join(leads, "component").select("digest", F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("lead"))
    some = usable.join(labels, "digest").select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("lead")).alias("first"))
    alone = signed.where(F.col("digest").isNull() | ~known).select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return some.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Rows are linked where their shingle sets are similar; component_id is the
    smallest doc_id that a row reaches, and the row is kept if it is its own.
    Null, empty and white-space texts have no shingles and are linked with
    nothing. Rows may share a doc_id: each is linked by its own text, and
    repeated rows are kept alike. A row with a null doc_id is linked with
    nothing, has a null component and is kept. Texts of any length are compared
    whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"), "rows")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _grouped(rows, False).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, of which one of each group of near-duplicates stays.

    Of a group, the row of the smallest doc_id stays, and one only of repeated
    rows and of rows that share it; a null doc_id comes last. Rows without
    shingles stay. Columns of any name are carried.
    """
    inside, original = shield(docs, ("doc_id", "text"), ())
    rows = scratch.keep(inside.withColumn("row", F.monotonically_increasing_id()), "rows")
    gone = _grouped(rows.select("row", F.col("doc_id").cast("long"), "text"), True).where("not first").select("row")
    return rows.join(gone.hint("merge"), "row", "left_anti").select(*original())
