"""Encoding and decoding with a merge-type (byte-pair) piece vocabulary by an agenda of adjacent symbol pairs.

A text is normalised, cut into symbols of one character, and all adjacent pairs that form a piece go on an agenda.  The pair of the
best score, the leftmost of a tie, is merged; the merged symbol's pairs with its neighbours go on the agenda, and entries whose
symbols have changed since are passed over.  Symbols that are no piece at the end become the pieces of their bytes.

A merge can't cross a character that is in no piece with another one.  Nor can it cross the place before a space mark, if no piece has
that mark behind another character, as is usual, nor that between a letter and another character, if no piece has both side by side; else texts aren't cut there.  So texts are cut there into segments that don't
change each other, and the ids of segments that a worker has met are kept (two generations of `KEPT` segments of at most `SHORT` characters): only new segments take the agenda.

Every segment that takes the agenda is also given to the sentencepiece library, a batch of them at a time, and `agrees` says row by row whether the
library has the same ids for all segments of the text.  The model goes to the workers as a broadcast variable of its bytes, so nothing has to be installed under the same path.

Defined results: a null text is empty, an empty text has only the begin and end ids; a text of any length is encoded whole, alone in its batch
if it is long; rows are independent of each other, so rows with equal or null ids each give one; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor

from .common import bounded_batches

SPACE = "▁"
KEPT, SHORT = 250_000, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
IDS_SCHEMA = "doc_id long, ids array<int>, decoded string, agrees boolean"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)


def _number(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """The numbered fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            if key & 7 == 2:
                size, at = _number(data, at)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Segments(dict):
    """Ids, as bytes, of the segments met so far, and what is yet to be checked."""

    def __init__(self, coder: PieceCoder):
        self.coder, self.older, self.unchecked = coder, {}, {}

    def __missing__(self, segment: str) -> bytes:
        found = self.older.get(segment)
        if found is None:
            found = self.unchecked.get(segment)
        if found is None:
            found = self.unchecked[segment] = self.coder.merged(segment)
        if len(segment) <= SHORT:
            self[segment] = found
        return found

    def aged(self) -> None:
        """Between batches: a full generation becomes the older one."""
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()


class PieceCoder:
    """What a task needs of a model: pieces and scores, normalisation, and the memory of segments."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(memoryview(model)):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        kinds = [p.get(3, NORMAL) for p in pieces]
        texts = [bytes(p[1]).decode() for p in pieces]
        if trainer.get(3) != 2 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies without user-defined or unused pieces are read")
        if bytes(normaliser.get(2, b"")) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only the identity normalisation with escaped, kept spaces is read")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        self.begin, self.end = (np.array([trainer.get(n, d)], "<u4").tobytes() for n, d in ((41, 1), (42, 2)))
        scores = (float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0 for p in pieces)
        self.score = {t: s for t, s, k in zip(texts, scores, kinds, strict=True) if k == NORMAL}
        self.ids = {t: np.array([i], "<u4").tobytes() for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL}
        byte_ids = {int(t[3:-1], 16): np.array([i], "<u4").tobytes() for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE}
        unknown = np.array([kinds.index(UNKNOWN)], "<u4").tobytes()
        self.byte_ids = [byte_ids.get(b) for b in range(256)] if byte_ids else None
        self.unknown = unknown
        surface = bytes(trainer.get(44, b" \xe2\x81\x87 "))
        shown = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), UNKNOWN: lambda t: surface, CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:-1], 16)])}
        self.shown = [shown[k](t) for t, k in zip(texts, kinds, strict=True)]
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.spaced = {i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL and t.startswith(SPACE)}
        joined = {c for t in self.score if len(t) > 1 for c in t}
        self.apart = next(c for c in ("\n", "\x00", *map(chr, range(0xE000, 0xF8FF))) if c not in joined)
        pairs = {(a, b) for t in self.score for a, b in zip(t, t[1:], strict=False)}
        letters = {c for c in joined if c.isalpha()}
        mixed = any((a in letters) != (b in letters) for a, b in pairs if SPACE not in (a, b))
        groups = [letters | joined - {SPACE}] if mixed else [letters, joined - letters - {SPACE}]
        inner = "|".join(f"[{''.join(map(re.escape, sorted(g)))}]+" for g in groups if g)
        single = f"[^{SPACE}{''.join(map(re.escape, sorted(joined - {SPACE})))}]"
        crossed = any(b == SPACE and a != SPACE for a, b in pairs)
        self.cut = re.compile(f"(?:{SPACE}|{inner})+|{single}" if crossed else f"{SPACE}*(?:{inner})|{SPACE}+|{single}")
        self.known = Segments(self)

    def merged(self, segment: str) -> bytes:
        """The ids of a segment, by the agenda."""
        symbols: list[str | None] = list(segment)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for left in range(n - 1):
            worth = score.get(symbols[left] + symbols[left + 1])
            if worth is not None:
                agenda.append((-worth, left, left + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue
            symbols[left], symbols[right] = a + b, None
            after[left] = over = after[right]
            if over >= 0:
                before[over] = left
            for x, y in ((before[left], left), (left, over)):
                if x >= 0 and y >= 0:
                    pair = symbols[x] + symbols[y]
                    worth = score.get(pair)
                    if worth is not None:
                        heapq.heappush(agenda, (-worth, x, y, len(pair)))
        return b"".join(self.ids.get(s) or self.spelled(s) for s in symbols if s is not None)

    def spelled(self, symbol: str) -> bytes:
        """The ids of the bytes of what is no piece."""
        return b"".join(self.byte_ids[b] for b in symbol.encode()) if self.byte_ids else self.unknown

    def encode(self, text: str) -> bytes:
        """The ids of a text with begin and end, as unsigned 32-bit little-endian numbers."""
        if not text:
            return self.begin + self.end
        known = self.known
        return b"".join([self.begin, *[known[s] for s in self.segments(text)], self.end])

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def differing(self, library: SentencePieceProcessor) -> set[str]:
        """The segments that came since the last call for which the library has other ids.

        A segment is put behind a character that no merge crosses, whose ids are then taken off.
        """
        new, self.known.unchecked = self.known.unchecked, {}
        names = list(new)
        lead = len(library.encode(self.apart))
        theirs = library.encode([self.apart + s.replace(SPACE, " ") for s in names], num_threads=1)
        return {s for s, t in zip(names, theirs, strict=True) if np.array(t[lead:], "<u4").tobytes() != new[s]}

    def decode(self, ids: np.ndarray) -> str:
        shown = self.shown
        numbers = ids.tolist()
        found = b"".join([shown[i] for i in numbers]).decode("utf-8", "each-byte")
        return found[1:] if self.prefix and next((i in self.spaced for i in numbers if i not in self.control), False) else found


_coders: dict[bytes, tuple[PieceCoder, SentencePieceProcessor]] = {}


def coder_of(model: bytes) -> tuple[PieceCoder, SentencePieceProcessor]:
    """The coder and the library's processor of a model; a worker keeps those of one model."""
    key = hashlib.sha256(model).digest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = (PieceCoder(model), SentencePieceProcessor(model_proto=model))
    return _coders[key]


def coded_rows(batches: Iterable[pa.RecordBatch], model: bytes, digests: bool) -> Iterator[pa.RecordBatch]:
    coder, library = coder_of(model)
    wrong: set[str] = set()
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        coded = [coder.encode(t) for t in texts]
        wrong |= coder.differing(library)
        coder.known.aged()
        agrees = [not wrong or wrong.isdisjoint(coder.segments(t)) for t in texts]
        ids = [np.frombuffer(c, "<u4") for c in coded]
        decoded = [coder.decode(i) for i in ids]
        if digests:
            columns = {
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            }
        else:
            columns = {"ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values(), pa.array(agrees, pa.bool_())], names=["doc_id", *columns, "agrees"])


def coded(docs: DataFrame, model: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, ids, decoded, agrees; with digests n_tokens and SHA-256 instead of ids and text.  No row is shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(lambda batches: coded_rows(batches, shared.value, digests), DIGEST_SCHEMA if digests else IDS_SCHEMA)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), digests=True)
