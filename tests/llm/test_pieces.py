"""Encoding and decoding by the agenda against the sentencepiece library and against a walk over all pairs."""

import hashlib
import random

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
import sentencepiece
from corpus import SCHEMA, frame, rows

from terrafold.llm import piece_coding

ALPHABET = [" ", " ", "▁", "\n", "\0", "a", "b", "the", " of", "ß", "é", "中", "😀", "<s>", "́", "\t", ".", "&&", "²", "9", ""]


@pytest.fixture(scope="module")
def model():
    with open(piece_coding.model_path(), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def merged_plainly(coder, text):
    """All adjacent pairs are looked at for each merge, over the whole text."""
    symbols = list(coder.prefix + text.replace(" ", piece_coding.SPACE)) if text else []
    while True:
        pairs = [(-coder.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in coder.score]
        if not pairs:
            return coder.begin + b"".join(coder.ids.get(s) or coder.spelled(s) for s in symbols) + coder.end
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_random_texts_and_ids(model, library):
    coder, rng = piece_coding.PieceCoder(model), random.Random(3)
    for i in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert coder.decode(np.frombuffer(ids, "<u4")) == library.decode(np.frombuffer(ids, "<u4").tolist())
        assert i % 10 or ids == merged_plainly(coder, text)
        some = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(1, 259) for _ in range(rng.randint(0, 6))]
        assert coder.decode(np.array(some, "<u4")) == library.decode(some)
    assert coder.differing(library) == set()


def test_segments_put_together_are_the_text(model):
    coder = piece_coding.PieceCoder(model)
    text = "".join(ALPHABET) * 3
    assert "".join(coder.segments(text)) == coder.prefix + text.replace(" ", piece_coding.SPACE)


def test_whole_table(spark, library):
    """Nulls, empty and blank texts, ties, repeated rows, rows without an id, a very long text, extra columns of clashing names."""
    data = [*rows(), *rows()[:3], (None, "no id", "en", "s", 1), (None, None, None, None, None), (990, "x" * 200_000 + " end", "en", "s", 1), (991, "\0 ▁ 😀", "en", "s", 1)]
    docs = frame(spark, data).selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS agrees").repartition(3)
    got = sorted((tuple(r) for r in piece_coding.coded(docs, piece_coding.model_path()).collect()), key=repr)
    expected = []
    for doc_id, text, *_ in data:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        expected.append((doc_id, ids, library.decode(ids), True))
    assert got == sorted(expected, key=repr)
    digests = sorted((tuple(r) for r in piece_coding.coded(docs, piece_coding.model_path(), digests=True).collect()), key=repr)
    assert digests == sorted(((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), a) for d, i, t, a in expected), key=repr)


def test_a_small_memory_gives_the_same(spark, model, monkeypatch):
    """Generations change between batches; what the library has otherwise would be told."""
    monkeypatch.setattr(piece_coding, "KEPT", 5)
    coder, library = piece_coding.PieceCoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [t for _, t, *_ in rows() if t]
    for t in texts:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode(t, add_bos=True, add_eos=True)
        coder.known.aged()
    assert len(coder.known) <= 5 + max(len(coder.segments(t)) for t in texts)


def test_a_wrong_segment_is_told(model, library):
    coder = piece_coding.PieceCoder(model)
    coder.encode("right wrong")
    coder.known.unchecked["▁wrong"] = b"\0\0\0\0"
    assert coder.differing(library) == {"▁wrong"}


def test_empty_table(spark):
    assert piece_coding.coded(spark.createDataFrame([], SCHEMA), piece_coding.model_path()).count() == 0
