"""Quality rules, with repetition found by suffix arrays.

The words of each document get a suffix array (prefix doubling; all documents of a bounded slice at once, suffixes never
reach past their document).  From the longest common prefix of neighbours in it follow the maximal repeated
substrings: a suffix opens a repeat as long as its longer common prefix with a neighbour.  Repeats of at least
`min_words` words are united into spans; a document fails if the spans cover more than `max_covered` of its words
or one repeat is longer than `max_longest` words.  Both limits bind beyond the base rules, which allow a fifth of the words in
repeated windows of five: few long repeats weigh more than many short ones, and a long passage given twice fails a text of any length.

Defined results: a null text has no words, and a text of under 10 words fails the base rules; equal rows get equal
verdicts; an empty table gives no rows; other columns are not read.  Everything is per document, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches
from .words import Words, combine, power_tables, slices, span_hashes

MIN_WORDS, MAX_COVERED, MAX_LONGEST = 16, 0.1, 100
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each range."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def duplicate_lines(words: Words) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10))
    doc = np.searchsorted(offsets, start, "right") - 1
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    key = combine(span_hashes(data, start, end), doc.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return np.bincount(doc[later], minlength=len(offsets) - 1)


def repeat_window_words(hashes: np.ndarray, doc: np.ndarray, bounds: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, the words in windows of `width` words that its text has twice or more."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    key = combine(hashes[:n], doc[:n].astype(np.uint64))
    for j in range(1, width):
        key = combine(key, hashes[j : j + n])
    whole = doc[:n] == doc[width - 1 :]
    found = np.zeros(n, bool)
    found[whole] = repeated(key[whole])
    return per_doc(covered(np.flatnonzero(found), np.full(int(found.sum()), width), len(hashes)), bounds)


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    depth = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def longest_repeats(hashes: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, how many words the longest substring that starts there and occurs again in its document has.

    Memory is a fixed number of arrays of the slice's words, however often the doubling goes on.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    stop = bounds[1:][doc]
    place = np.arange(n)
    order = np.lexsort((hashes, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.maximum.accumulate(np.where(fresh, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    width = 1
    tied = order[_in_groups(group)]
    while len(tied):
        follows = tied + width
        inside = follows < stop[tied]
        second = np.where(inside, rank[np.minimum(follows, n - 1)] + 1, 0)
        first = rank[tied]
        sub = np.lexsort((second, first))
        tied, first, second = tied[sub], first[sub], second[sub]
        at = np.arange(len(tied))
        opens = np.ones(len(tied), bool)
        opens[1:] = first[1:] != first[:-1]
        leader = np.maximum.accumulate(np.where(opens, at, 0))
        opens[1:] |= second[1:] != second[:-1]
        begin = np.maximum.accumulate(np.where(opens, at, 0))
        rank[tied] = first + begin - leader
        width *= 2
        tied = tied[_in_groups(rank[tied])]
    order = np.empty(n, np.int64)
    order[rank] = place
    left, right = order[:-1], order[1:]
    pairs = np.flatnonzero((doc[left] == doc[right]) & (hashes[left] == hashes[right]))
    left, right = left[pairs], right[pairs]
    room = np.minimum(stop[left] - left, stop[right] - right)
    powers, inverse = power_tables(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    common = np.zeros(len(pairs), np.int64)
    while width:  # the common prefix, by halves, from hashes of whole spans
        fits = common + width <= room
        a, b = np.where(fits, left + common, 0), np.where(fits, right + common, 0)
        reach = np.where(fits, width, 0)
        common += reach * ((sums[a + reach] - sums[a]) * inverse[a] == (sums[b + reach] - sums[b]) * inverse[b])
        width //= 2
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _in_groups(sorted_ranks: np.ndarray) -> np.ndarray:
    """Which of the ranks, equal ones side by side, are not alone."""
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    flags = np.zeros(len(sorted_ranks), bool)
    flags[1:] |= same
    flags[:-1] |= same
    return flags


def judge(data: np.ndarray, offsets: np.ndarray, limits: tuple[int, float, int]) -> dict[str, np.ndarray]:
    """All figures and verdicts of a slice of documents."""
    min_words, max_covered, max_longest = limits
    words = Words(data, offsets)
    hashes, doc, bounds, n = words.hashes(lower=False), words.doc, words.bounds, words.counts
    separators = (data == 32) | ((data >= 9) & (data <= 13))
    out = {"n_words": n, "word_chars": per_doc(~separators & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_doc(_SYMBOL[data], offsets)}
    out["n_dup_lines"] = duplicate_lines(words)
    out["n_repeat_words"] = repeat_window_words(hashes, doc, bounds)
    longest = longest_repeats(hashes, doc, bounds)
    start = np.flatnonzero(longest >= min_words)
    out["covered_words"] = per_doc(covered(start, longest[start], len(hashes)), bounds)
    out["longest_repeat"] = np.zeros(len(n), np.int64)
    np.maximum.at(out["longest_repeat"], doc, longest)
    out["base_failed"] = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n)
    out["kept"] = ~out["base_failed"] & ~(out["covered_words"] > max_covered * n) & ~(out["longest_repeat"] > max_longest)
    return out


def judged_rows(batches: Iterable[pa.RecordBatch], limits: tuple[int, float, int]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1)):
            found = judge(data, offsets, limits)
            arrays = [batch.column(0).slice(first, last - first)] + [pa.array(found[x].astype(bool if x in ("base_failed", "kept") else np.int64)) for x in names[1:]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """A row per row of docs: the columns of SCHEMA."""
    bounded_batches(docs.sparkSession)
    limits = (min_words, max_covered, max_longest)
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(lambda batches: judged_rows(batches, limits), SCHEMA)


def _kept_rows(batches: Iterable[pa.RecordBatch], at: int, limits: tuple[int, float, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [judge(data, offsets, limits)["kept"] for _, _, data, offsets in slices(batch.column(at))]
        yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    bounded_batches(spark)
    at, limits = docs.columns.index("text"), (MIN_WORDS, MAX_COVERED, MAX_LONGEST)
    return docs.mapInArrow(lambda batches: _kept_rows(batches, at, limits), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
