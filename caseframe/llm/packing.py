"""Best-fit packing of tokenized documents into sequences, with certified bin counts.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.
Hash partitions pack their pieces by best-fit decreasing. A dual-feasible-
function lower bound certifies a partition whose bin count it reaches; the
partitions with a gap give up their badly filled bins, whose pieces are dealt
anew into fewer partitions and packed again, until every partition is certified
or a round saves no bin. Every row carries its partition's bins and bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from caseframe.sources import scratch


CAPACITY = 2048
#: Cached words per worker; a full cache is emptied.
CACHE_WORDS = 800_000
#: Combining marks begin here; text below is in composed form already.
FIRST_MARK = "\u0300"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordTokenizer(dict):
    """Ids of white-space separated words as little-endian 32-bit bytes, cached by word.

    The vocabulary never joins characters across white space, so a text's ids
    are its words' ids in a row. Words below U+0300 that can't hold a special
    token go through the merge ranks directly (lower case, pretokens, merges by rank);
    all others through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        end = model["model"]["end_of_word_suffix"]
        table = {c: b for b, c in _byte_letters().items()}
        # The word end is a byte that UTF-8 never has; it joins the last byte first.
        as_bytes = lambda t: bytes(table[c] for c in t.removesuffix(end)) + b"\xff" * t.endswith(end)
        ranks, ids = {bytes([b]): b for b in range(256)}, [0] * 512
        letters = _byte_letters()
        for b in range(255):
            ranks[bytes([b, 255])] = 256 + b
            ids[b], ids[256 + b] = vocab.get(letters[b], 0), vocab.get(letters[b] + end, 0)
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if (key := as_bytes(a + b)) not in ranks:
                ranks[key] = len(ids) + 1
                ids += [0] * (ranks[key] - len(ids)) + [vocab[a + b]]
        self.ids = [i.to_bytes(4, "little") for i in ids]
        self.merged = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.piece = self.merged._encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if (text.isascii() or max(text) < FIRST_MARK) and "<|" not in text:
            text = text.lower()
            if text.isalpha():
                parts = (text,)
            elif text[:-1].isalpha() and text[-1] in ".,;:!?":
                parts = (text[:-1], text[-1])
            else:
                parts = PIECES.findall(text)
            out = b"".join([self.ids[i] for p in parts for i in self.piece(p.encode() + b"\xff")])
        else:
            out = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow U+00FF in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then id 0, cut where over ``capacity``.

    A null or empty text is the closing id alone; a null doc_id stays null;
    repeated rows have pieces each; other columns are left behind; an empty
    table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = words.encode(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(i)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array([r[c] for r in rows], pa.int32() if c == 0 else pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], [c.split(" ")[0] for c in PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece, and the number of bins.

    Bins are kept by their room; a bit set of the rooms in use finds the
    tightest bin in constant time, so packing is linear after sorting.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, at = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i], at[i] = b, capacity - room
        left = room - n
        if left:
            if not open_by_room[left]:
                rooms |= 1 << left
            open_by_room[left].append(b)
    return bins, at, count


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by the best of the dual feasible functions of Fekete and Schepers and of Martello and Toth."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    # Thresholds: pieces over capacity - e count as whole, those under e as nothing.
    above, mass = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * sizes)
    for e in range(0, capacity // 2 + 1):
        whole = int(above[capacity - e + 1]) if e else 0
        middle = int(mass[min(capacity, capacity - e)] - (mass[e - 1] if e else 0))
        best = max(best, whole - (-middle // capacity))
    # Rounding: x -> floor((k + 1) x / capacity) / k, exact multiples of 1 / (k + 1) stay as they are.
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part_bins long, part_bound long, settled boolean"
#: Bins filled to this share stay where a partition has a gap.
FULL = 0.995


def _packer(capacity: int, level: int):
    """Packs the rows of one partition number; badly filled bins of a partition with a gap aren't settled."""

    def pack(group: pa.Table) -> pa.Table:
        keys = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]]
        group = group.take(pc.sort_indices(group, sort_keys=keys))
        lengths = group["length"].to_numpy()
        bins, at, count = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        settled = np.ones(len(lengths), dtype=bool)
        if count > bound:
            settled = np.bincount(bins, weights=lengths, minlength=count)[bins] >= capacity * FULL
        made = [(np.int64(level) << 56) + (np.int64(group["_part"][0].as_py()) << 32) + bins, at, np.full(len(bins), count), np.full(len(bins), bound), settled]
        names = [c.split(" ")[0] for c in PACKED.split(", ")]
        return pa.table([*[group[c] for c in names[:5]], *map(pa.array, made)], names=names)

    return pack


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, rows_per_part: int = 8192, rounds: int = 32) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound, certified.

    part_bins and part_bound are the bins of the partition that packed the
    piece and the fewest that any packing of it needs; ``certified`` says that
    they are equal. ``docs`` needs doc_id and text; other columns are ignored. A
    null or empty text is one piece of the closing id; longer documents than
    ``capacity`` are cut and nothing else is; a null doc_id stays null; repeated
    rows are packed each; an empty table gives an empty result. Partition sizes
    depend on the number of pieces, never on a key, so no partition is
    unbounded. Rounds end by themselves; ``rounds`` only bounds the numbers of
    sequences.
    """
    todo = scratch.keep(pieces(docs, path, capacity), "pieces")
    total, before, done = todo.count(), None, []
    for level in range(rounds):
        parts = max(1, -(-total // rows_per_part))
        spread = F.xxhash64(F.lit(level), "doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id() if level == 0 else F.col("sequence_id"))
        dealt = todo.withColumn("_part", F.pmod(spread, F.lit(parts)))
        packed = scratch.keep(dealt.groupBy("_part").applyInArrow(_packer(capacity, level), PACKED), f"packed{level}")
        bins, left, open_bins = packed.agg(F.count_if(F.col("offset") == 0), F.count_if(~F.col("settled")), F.count_if((F.col("offset") == 0) & ~F.col("settled"))).first()
        if before is not None and bins >= before:
            break  # no bin saved: the packing before stays
        if done:
            done[-1] = done[-1].where("settled")
        done.append(packed)
        if not left or parts == 1:
            break
        todo, total, before = packed.where("not settled"), left, open_bins
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled").withColumn("certified", F.col("part_bins") == F.col("part_bound"))
