"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Paragraphs are cut to pieces by what they say, never by position: after a
sentence, and after words with certain ends, so that an edit changes only the
pieces that it touches. Every piece is hashed to three cells, which add up
counts, digests and check digests. Two sketches subtract cell by cell; peeling cells
that hold one digest recovers the pieces in which the versions differ. Where
that fails, both are sketched again with more cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the fingerprint itself in each of its three parts, and the growth of a retry.
PART, GROWTH = 8, 8
PARTS = 3
#: Of the pairs of bytes that end a word, about one in so many ends a piece.
ENDS_ONE_IN = 6
#: Cells that one vectorized attempt may hold.
CELLS = 1 << 21
#: One key in so many starts a range of documents; more rows make longer ranges, about RANGES at most, so that their starts (2 MB) can go to every task.
RANGE_ROWS, RANGES = 128, 262_144
LOWEST = -(2**63)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        return h ^ (h >> np.uint64(33))


_SPACE, _LINE, _MARKS = 32, 10, np.isin(np.arange(256), np.frombuffer(b".!?", dtype=np.uint8))
_ENDS = (_mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(ENDS_ONE_IN)) == 0


def pieces(text: str) -> list[bytes]:
    """The pieces of a text in order; together they are the text."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return []
    # A piece ends at a line feed, at the last of some sentence marks, and at a space after certain two bytes.
    mark = _MARKS[b]
    end = (b == _LINE) | mark & ~np.r_[mark[1:], False]
    pair = np.zeros(len(b), dtype=np.int64)
    pair[2:] = b[:-2].astype(np.int64) << 8 | b[1:-1]
    end |= (b == _SPACE) & _ENDS[pair]
    end[-1] = True
    cuts = [0, *(np.flatnonzero(end) + 1).tolist()]
    return [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def digests(text: str) -> np.ndarray:
    """64-bit digests of a text's pieces; the n-th repetition of a piece is a piece of its own."""
    raw = list(map(xxhash.xxh3_64_intdigest, pieces(text)))
    keys = np.array(raw, dtype=np.uint64)
    if len(set(raw)) != len(raw):
        seen: Counter[int] = Counter()
        for i, key in enumerate(raw):
            if n := seen[key]:
                keys[i] ^= np.uint64(0x9E3779B97F4A7C15 * n & (2**64 - 1))
            seen[key] += 1
    return keys


def _checks(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)


def _places(keys: np.ndarray, part: int, r: int) -> np.ndarray:
    """The cell of each key in part ``r``; other sizes hash anew."""
    with np.errstate(over="ignore"):
        return r * part + (_mix(keys + np.uint64((part * PARTS + r) * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(part)).astype(np.int64)


class Cells:
    """Sketches of ``n`` texts at once: counts, digest sums and check sums, modulo 2**64."""

    def __init__(self, n: int, part: int) -> None:
        self.part, self.width = part, PARTS * part
        self.count = np.zeros(n * self.width, dtype=np.int64)
        self.keys = np.zeros(n * self.width, dtype=np.uint64)
        self.sums = np.zeros(n * self.width, dtype=np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int64), keys.shape)
        factor = sign.astype(np.uint64)  # -1 wraps around
        with np.errstate(over="ignore"):
            k, c = keys * factor, _checks(keys) * factor
        for r in range(PARTS):
            at = owner * self.width + _places(keys, self.part, r)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, k)
            np.add.at(self.sums, at, c)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Removes what can be recovered: (owner, digest, sign) of it."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            sign = self.count[live]
            with np.errstate(over="ignore"):
                key = self.keys[live] * sign.astype(np.uint64)
                pure = (np.abs(sign) == 1) & (self.sums[live] == _checks(key) * sign.astype(np.uint64))
            live, key, sign = live[pure], key[pure], sign[pure]
            owner = live // self.width
            _, first = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1, return_index=True)
            owner, key, sign = owner[first], key[first], sign[first]
            if not len(key):
                break
            found.append((owner, key, sign))
            self.add(owner, key, -sign)
            touched = np.concatenate([owner * self.width + _places(key, self.part, r) for r in range(PARTS)])
            live = np.unique(touched[np.abs(self.count[touched]) == 1])
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def failed(self, n: int) -> np.ndarray:
        return ((self.count != 0) | (self.keys != 0) | (self.sums != 0)).reshape(n, self.width).any(axis=1)


def _gather(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    return owner, np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The base sketch of each set of digests: count, digest sum and check sum of every cell, base64."""
    cells = Cells(len(sets), PART)
    cells.add(*_gather(sets))
    packed = np.zeros((len(sets), cells.width), dtype=np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u4")]))
    packed["n"] = cells.count.reshape(len(sets), -1)
    packed["k"] = cells.keys.reshape(len(sets), -1)
    packed["c"] = (cells.sums & np.uint64(0xFFFFFFFF)).reshape(len(sets), -1)
    return [base64.b64encode(row.tobytes()).decode("ascii") for row in packed]


class Difference(NamedTuple):
    """Digests that only the one or the other text has, and the cells of the sketch that they were recovered from."""

    left: np.ndarray
    right: np.ndarray
    cells: int


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> list[Difference]:
    """The differing digests of each pair of sets, recovered by peeling the subtracted sketches; where that fails, larger ones are tried."""
    out: list[Difference | None] = [None] * len(left)
    todo, part = np.arange(len(left)), PART
    while len(todo):
        again: list[np.ndarray] = []
        step = max(1, CELLS // (PARTS * part))
        for at in range(0, len(todo), step):
            rows = todo[at : at + step]
            # Sketches with fewer cells than the sizes differ by can't be peeled.
            gap = np.array([abs(len(left[i]) - len(right[i])) for i in rows])
            again.append(rows[gap > PARTS * part])
            rows = rows[gap <= PARTS * part]
            if not len(rows):
                continue
            cells = Cells(len(rows), part)
            cells.add(*_gather([left[i] for i in rows]))
            cells.add(*_gather([right[i] for i in rows]), -1)
            owner, key, sign = cells.peel()
            failed = cells.failed(len(rows))
            by = np.lexsort((key, -sign, owner))
            owner, key, sign = owner[by], key[by], sign[by]
            first = np.searchsorted(owner, np.arange(len(rows) + 1))
            for k in np.flatnonzero(~failed).tolist():
                mine = slice(first[k], first[k + 1])
                split = int((sign[mine] > 0).sum())
                out[rows[k]] = Difference(key[mine][:split], key[mine][split:], PARTS * part)
            again.append(rows[failed])
        todo, part = np.sort(np.concatenate(again)), part * GROWTH
    return out


def likeness(left: list[np.ndarray], found: list[Difference]) -> np.ndarray:
    """Common pieces as a share of all pieces, from the recovered differences; 1 where neither has any."""
    sizes = np.array([len(s) for s in left], dtype=np.int64)
    every = sizes + np.array([len(d.right) for d in found], dtype=np.int64)
    return np.where(every > 0, (sizes - np.array([len(d.left) for d in found], dtype=np.int64)) / np.maximum(every, 1), 1.0)


def edit(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by as many, or all, first characters of the other one."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_n_chars long, "
    "n_pieces long, only_text array<long>, only_edited array<long>, cells_edited long, n_next_differing long, cells_next long"
)


def _batch(ids: list[int], texts: list[str], following: list[str], sets: list[np.ndarray], following_sets: list[np.ndarray]) -> pa.RecordBatch:
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    edited_sets = [digests(t) for t in edited]
    to_edited, to_next = differences(sets, edited_sets), differences(sets, following_sets)
    longs = lambda values: pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))
    columns = [
        pa.array([None if i == LOWEST else i for i in ids], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(fingerprints(sets), pa.string()),
        pa.array(fingerprints(edited_sets), pa.string()),
        pa.array(likeness(sets, to_edited)),
        pa.array(likeness(sets, to_next)),
        pa.array([len(t) for t in edited], pa.int64()),
        pa.array([len(s) for s in sets], pa.int64()),
        longs([d.left for d in to_edited]),
        longs([d.right for d in to_edited]),
        pa.array([d.cells for d in to_edited], pa.int64()),
        pa.array([len(d.left) + len(d.right) for d in to_next], pa.int64()),
        pa.array([d.cells for d in to_next], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in RESULT.split(", ")])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and descending key, each range closed by the first row of the next one."""
    waiting: tuple | None = None  # range, key, text, digests of the row before
    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)
        ids, texts, following, sets, following_sets = [], [], [], [], []
        for where, key, ghost, text in rows:
            text = text or ""
            new = (where, key, ghost, text, digests(text))
            if waiting is not None and waiting[0] == where and not waiting[2]:
                ids.append(waiting[1])
                texts.append(waiting[3])
                following.append(text)
                sets.append(waiting[4])
                following_sets.append(new[4])
            waiting = new
        if ids:
            yield _batch(ids, texts, following, sets, following_sets)


def versions(docs: DataFrame) -> DataFrame:
    """The fingerprint of each row's text and of its edited text, their likeness, and what differs.

    only_text and only_edited are the recovered digests of pieces that only the
    one or the other version has, cells_edited the cells of the sketch that
    they were peeled from; n_next_differing and cells_next are the same of the
    next document.

    The edited text takes its second half from the next document in descending
    doc_id; the last one takes it from the first. ``docs`` needs doc_id and
    text. A null text is empty; rows with a null doc_id come last; rows with
    equal doc_ids are ordered by their texts' hash and text; a single row is
    its own next document. Equal texts have equal fingerprints. An empty table
    gives an empty result; other columns are ignored.

    Documents are dealt to key ranges, each of which also gets the first
    document of the next range, so every text moves once and is compared where
    its successor is. Ranges are streamed; none is held in memory.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), "text")
    total, top = rows.agg(F.count("*"), F.max("key")).first()
    every = max(RANGE_ROWS, -(-total // RANGES))
    starts = rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").distinct().collect()
    # Descending; the highest key starts the first range.
    bounds = np.array(sorted({r[0] for r in starts} | ({top} if top is not None else set())), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            # Range number: how many starts are at or above the key, less one, so range 0 begins with the highest key.
            where = len(bounds) - np.searchsorted(bounds, keys, side="left") - 1
            at_start = np.flatnonzero(bounds[np.minimum(np.searchsorted(bounds, keys, side="left"), len(bounds) - 1)] == keys)
            order = np.concatenate([np.arange(len(keys)), at_start])
            before = (where[at_start] - 1) % len(bounds)
            ghost = np.concatenate([np.zeros(len(keys), dtype=bool), np.ones(len(at_start), dtype=bool)])
            taken = batch.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([where, before])), taken.column(0), pa.array(ghost), taken.column(1)], ["where", "key", "ghost", "text"])

    dealt = rows.mapInArrow(deal, "where long, key long, ghost boolean, text string")
    placed = dealt.repartition("where").sortWithinPartitions("where", "ghost", F.desc("key"), F.xxhash64("text"), "text")
    return placed.mapInArrow(_compare, RESULT)
