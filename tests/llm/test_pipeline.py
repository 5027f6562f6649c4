"""The pipeline against a version by brute force, and the registration of its stages."""

import pytest
from corpus import SCHEMA, frame, jaccard_components, lower, quality, rows, words

from terrafold.llm import repetition

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark, tmp_path):
    data = [*rows(4, 80), (500, "x y z " * 50, "en", "s1", 1)]
    frame(spark, data).write.parquet(f"{tmp_path}/in/documents.parquet")
    kept = [r for r in data if quality(r[1], repetition.MIN_WORDS, repetition.MAX_COVERED, repetition.MAX_LONGEST, 0)[6]]
    largest = {}
    for r in kept:
        largest[lower(r[1])] = max(r[0], largest.get(lower(r[1]), -1))
    kept = [r for r in kept if largest[lower(r[1])] == r[0]]
    component = jaccard_components(kept, 80, 5)  # the stage has the general rule: five words, four fifths
    kept = [r for r in kept if component[r[0]][1] == r[0]]

    docs, names = spark.read.parquet(f"{tmp_path}/in/documents.parquet"), [x.split()[0] for x in SCHEMA.split(", ")]
    expected = [None, None, {r[0] for r in kept}]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"{tmp_path}/in").write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.columns == names
        if number == 2:
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(expected[2])
    mixed = spark.read.parquet(f"{tmp_path}/3").groupBy("doc_id").count().collect()
    pieces = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    total = {r["doc_id"]: (r["sum(length)"], r["max(doc_tokens)"]) for r in pieces}
    for r in mixed:
        assert 1 <= r["count"] <= 2
        assert total[r["doc_id"]][0] == r["count"] * total[r["doc_id"]][1]

    again = corpus_pipeline.run(spark, f"{tmp_path}/in")
    assert again.agg({"length": "sum"}).first()[0] == sum(x for x, _ in total.values())


def test_near_copies_of_the_general_rule_go(spark):
    """Five-word shingles, four fifths in common: one word changed in 50, a passage inserted or cut; a copy below that stays."""
    from terrafold.llm import jaccard_join

    def text(name, n):
        return [f"{name}{i}" for i in range(n)]

    a, b, c = text("a", 50), text("b", 100), text("c", 40)
    pairs = {1: a, 2: [*a[:25], "new", *a[26:]], 3: b, 4: [*b[:50], *text("in", 12), *b[50:]], 5: [*b[:40], *b[52:]], 6: c, 7: [*c[:20], "new", *c[21:]]}
    data = [*rows(4, 40), *((1000 + d, " ".join(w), "en", "s1", 1) for d, w in pairs.items())]
    sets = {}
    for d, t, *_ in data:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}
    group = {d: d for d in sets}
    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                low, high = sorted((group[x], group[y]))
                group = {d: low if g == high else g for d, g in group.items()}
    got = {r["doc_id"] for r in jaccard_join.stage(spark, frame(spark, data), "").collect()}
    assert got == {d for d, g in group.items() if d == g}
    assert {d - 1000 for d in got if d > 1000} == {1, 3, 6, 7}


def test_stages_on_an_empty_table(spark):
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame(spark, []), "")
        assert out.count() == 0 and (number == 4 or out.columns == [x.split()[0] for x in SCHEMA.split(", ")])


def test_jaccard_stage_goes_by_rows(spark):
    """Of a group one row stays: that of the smallest id, also if ids are missing, shared or all missing; clashing columns stay as they are."""
    from pyspark.sql import functions as F

    from terrafold.llm import jaccard_join

    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = [" ".join([*w[:30], f"new{k}", *w[31:]]) for w in (a, b, c) for k in range(2)]
    data = [(None, near[0], None, None, 0), (5, near[1], None, None, 0), (None, near[2], None, None, 0), (None, near[3], None, None, 0), (7, near[4], None, None, 0), (7, near[5], None, None, 0), (7, near[5], None, None, 0), (None, "", None, None, 0), (9, None, None, None, 0)]
    docs = frame(spark, data).withColumns({x: F.lit("x") for x in ("row", "doc", "group", "n", "cls", "k1", "t1", "__t1", "__id", "probe")})
    out = jaccard_join.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {(r["doc_id"], (r["text"] or "")[:1]) for r in out.collect()}
    assert got == {(5, "a"), (None, "b"), (7, "c"), (None, ""), (9, "")}
    assert len({r["text"] for r in out.collect()}) == 5


def test_stages_with_clashing_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    data = [*rows(6, 40), (700, " ".join(f"word{i}" for i in range(60_000)), "en", "s1", 1)]
    docs = frame(spark, data).withColumns({x: F.lit("x") for x in ("row", "row_no", "batch", "digest", "copies", "size", "target", "start", "length", "__row")})
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if number < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            assert 700 in {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.filter("doc_id = 700").agg(F.countDistinct("row_no")).first()[0] >= 1


def test_stages_with_null_ids_and_columns(spark):
    """Documents without an id go through all stages, and one of equal texts stays."""
    clean = [" ".join(f"{a}{i}" for i in range(30)) for a in "pqr"]
    data = [(None, clean[0], None, None, None), (None, clean[0], None, None, None), (1, clean[1], None, None, None), (None, clean[2], None, "s", None), (2, None, None, None, None)]
    docs = frame(spark, data)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, "")
        if number in (1, 2):
            assert sorted(r["text"] for r in docs.collect()) == clean
    assert {r["text"] for r in docs.collect()} <= set(clean)
