"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each task tokenises its rows and packs them in groups of a bounded number of pieces: no row is shuffled.
A document that is longer than a window fills whole windows by itself; what is left is cut into pieces of at most
`piece` tokens.  A group of pieces is divided among k windows: partial partitions, at first one piece each, are merged
by pairs, those of the largest spread first, the fullest part of one with the emptiest of the other.  k starts at the
fewest windows that could do and rises until none of them is above capacity.
Copies of a document, such as a mix leaves side by side, go to different groups (up to POOLS), so they don't meet in a window;
row_no tells their pieces apart.

Defined results: a null or empty text is the end token alone; rows with equal ids are documents of their own; an empty
table gives no rows; other columns are not read.  sequence_id and row_no hold the number of the task in their high bits.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches
from .words import slices, span_hashes

CAPACITY, PIECE, GROUP, POOLS = 2048, 512, 1024, 4
GENERATION, JOINED = 400_000, 10_000
SLICE_BYTES = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_no long, sequence_id long, offset long"


class Generation:
    """Token ids of segments by the hashes of these."""

    def __init__(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where each one's ids are listed
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it isn't known."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        near = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[near] == hashes, self.slot[near], -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, len(self.size) + np.arange(len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def listed(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots, one after the other, and how many each has."""
        size = self.size[slots]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.first[slots] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


class SegmentEncoder:
    """Token ids of texts, with the ids of the words met before kept.

    A text is cut before each single space between two characters that are not white space.  The pre-tokenizer of
    byte-level BPE never makes a token across such a place, so the parts can be encoded apart.
    What is kept has two generations of at most about GENERATION segments: a full young one becomes the old one, and what is met
    in the old one goes to the young one, so that frequent words stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())])  # in byte-level BPE a character stands for a byte
        self.young, self.old = Generation(), Generation()

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments start; a non-empty document starts one."""
        at = np.flatnonzero(data[1:-1] == 32) + 1
        before, after = data[at - 1], data[at + 1]
        # The bytes that lead the white space outside ASCII, all of it at U+0085, U+00A0, U+1680, U+20xx and U+3000.
        rare = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3)) | ((before >= 0x80) & ((data[at - 2] == 0xC2) | ((data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3))))
        starts = np.zeros(len(data), bool)
        starts[at[(before > 32) & (after > 32) & ~rare]] = True
        filled = np.diff(offsets) > 0
        starts[offsets[1:][filled] - 1] = False  # a space that ends a document
        starts[offsets[:-1][filled]] = True
        return np.flatnonzero(starts)

    def encode_new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which segments were encoded, their ids, and how many each has.

        Plain ones (a space, then no white space at either end) are encoded in one call: with the space before each, they
        stand as in a text, and the bytes of the tokens tell where each ends.
        """
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ends, inner = data[end - 1], data[np.minimum(start + 1, end - 1)]
        plain = (data[start] == 32) & (inner > 32) & ~((inner == 0xC2) | ((inner >= 0xE1) & (inner <= 0xE3))) & (ends > 32) & (ends < 0x80)
        first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids = np.concatenate([np.zeros(0, np.uint32)] + [self.encode_text(b"".join([texts[i] for i in part.tolist()])) for part in np.array_split(first, len(first) // JOINED + 1)])
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(end[first] - start[first]), "left") + 1
        others = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i].decode("utf-8") for i in rest.tolist()], add_special_tokens=False)]
        size = np.concatenate([np.diff(cuts, prepend=0), np.fromiter(map(len, others), np.int64, len(others))])
        return np.concatenate([first, rest]), np.concatenate([ids, np.array([i for x in others for i in x], np.uint32)]), size

    def encode_text(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice, and where each document's begin in them."""
        start = self.segments(data, offsets)
        end = np.append(start[1:], len(data))
        unique, where, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.young.known) > GENERATION:
            self.young, self.old = Generation(), self.young
        index = self.young.find(unique)
        lost = np.flatnonzero(index < 0)
        kept = self.old.find(unique[lost])
        again = lost[kept >= 0]
        ids, size = self.old.listed(kept[kept >= 0])
        new = lost[kept < 0]
        if len(new):
            order, new_ids, new_size = self.encode_new(data, start[where[new]], end[where[new]])
            again, ids, size = np.concatenate([again, new[order]]), np.concatenate([ids, new_ids]), np.concatenate([size, new_size])
        if len(again):
            index[again] = len(self.young.size) + np.arange(len(again))
            self.young.add(unique[again], ids, size)
        ids, size = self.young.listed(index[inverse])
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)]


_encoders: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One per worker process, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """The part, 0 to k-1, of each item: Karmarkar-Karp differencing into k parts of near-equal sums.

    A partial partition is the ascending list of its parts that aren't empty, each a number with the part's sum in the high
    bits and its first item in the low ones; the items of a part form a chain.
    """
    n = len(lengths)
    bits = max(1, n.bit_length())
    items, following, last = (1 << bits) - 1, [-1] * n, list(range(n))

    def joined(x: int, y: int) -> int:
        head = y & items
        following[last[x & items]], last[x & items] = head, last[head]
        return x + y - head

    heap = [(-x, i, [(x << bits) | i]) for i, x in enumerate(lengths.tolist())]
    heapq.heapify(heap)
    for number in range(n, 2 * n - 1):
        _, _, one = heapq.heappop(heap)
        _, _, two = heap[0]
        both = max(0, len(one) + len(two) - k)
        # Of k parts each, those that are empty included, the fullest of one joins the emptiest of the other, and so on.
        parts = one[both:] + two[both:] + [joined(x, y) for x, y in zip(one[:both], two[:both][::-1], strict=True)]
        parts.sort()
        spread = (parts[-1] >> bits) - (parts[0] >> bits if len(parts) == k else 0)
        heapq.heapreplace(heap, (-spread, number, parts))
    part = np.zeros(n, np.int64)
    for j, x in enumerate(heap[0][2]):
        i = x & items
        while i >= 0:
            part[i] = j
            i = following[i]
    return part


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item; the number of windows rises until all of them hold at most `capacity`."""
    k = -(-int(lengths.sum()) // capacity)
    while True:
        part = differencing(lengths, k)
        if np.bincount(part, weights=lengths).max() <= capacity:
            return part
        k += 1


def pieces(ids: np.ndarray, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole windows, then near-equal pieces of what is left."""
    whole = len(ids) - len(ids) % capacity
    for start in range(0, whole, capacity):
        yield start, capacity
    rest = len(ids) - whole
    n = -(-rest // piece)
    for j in range(n):
        a, b = rest * j // n, rest * (j + 1) // n
        yield whole + a, b - a


def pack_rows(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int, piece: int, group: int) -> Iterator[pa.RecordBatch]:
    made = encoder(path)
    base = TaskContext.get().partitionId() << 40
    sequences = rows = 0
    pools: list[tuple[set, list[tuple]]] = [(set(), []) for _ in range(POOLS)]
    out: list[tuple] = []

    def packed(pool: list[tuple]) -> None:
        nonlocal sequences
        part = windows(np.fromiter((p[2] for p in pool), np.int64, len(pool)), capacity)
        filled = np.zeros(int(part.max()) + 1, np.int64)
        for p, j in zip(pool, part.tolist(), strict=True):
            out.append((*p, base + sequences + j, int(filled[j])))
            filled[j] += p[2]
        sequences += len(filled)

    def flushed() -> pa.RecordBatch:
        nonlocal out
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)
        out = []
        return batch

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, last, data, offsets in slices(batch.column(1), SLICE_BYTES):
            all_ids, bounds = made.encode(data, offsets)
            for d in range(first, last):
                ids = np.append(all_ids[bounds[d - first] : bounds[d - first + 1]], np.uint32(end_id)).astype("<u4")
                doc_id = doc_ids[d]
                at = next((i for i, (met, _) in enumerate(pools) if doc_id not in met), POOLS - 1)
                for start, length in pieces(ids, capacity, piece):
                    row = (doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + rows)
                    if length == capacity:
                        out.append((*row, base + sequences, 0))
                        sequences += 1
                        continue
                    met, pool = pools[at]
                    pool.append(row)
                    if doc_id is not None:
                        met.add(doc_id)
                    if len(pool) == group:
                        packed(pool)
                        pools[at] = (set(), [])
                rows += 1
            if len(out) >= 50_000:
                yield flushed()
    for _, pool in pools:
        if pool:
            packed(pool)
    yield flushed()


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, row_no, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(lambda batches: pack_rows(batches, tokenizer, end_id, capacity, piece, group), SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer_path())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
