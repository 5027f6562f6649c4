"""Readers and writers on small files."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from terrafold.sources import scans


def test_objects(spark, tmp_path):
    folder = tmp_path / "room1" / "Annotations"
    folder.mkdir(parents=True)
    (folder / "chair_2.txt").write_text("1 2 3 10 20 30\n4 5 6 7 8 9\n")
    (folder / "chair_1.txt").write_text("0 0 0 1 1 1\nbroken line\n")
    (folder / "thing_1.txt").write_text("9 9 9 0 0 0\n")
    got = sorted(tuple(r) for r in scans.objects(spark, f"{tmp_path}/*/Annotations/*.txt", {"chair": 7}).select("scene", "x", "sem", "ins").collect())
    assert got == [("room1", 0.0, 7, 0), ("room1", 1.0, 7, 1), ("room1", 4.0, 7, 1), ("room1", 9.0, 12, 2)]


def test_label_map(spark, tmp_path):
    (tmp_path / "map.tsv").write_text("id\traw\tc\td\te\tf\tg\tclass\n1\tdesk lamp\t\t\t\t\t\tlamp\n")
    rows = spark.createDataFrame([("desk lamp",), ("ghost",)], "label string")
    got = {r["label"]: r["name"] for r in scans.mapped(rows, scans.label_map(spark, f"{tmp_path}/map.tsv"), "label").collect()}
    assert got == {"desk lamp": "lamp", "ghost": "unannotated"}


def test_segments(spark, tmp_path):
    (tmp_path / "s1.segs.json").write_text(json.dumps({"segIndices": [5, 5, 6, 7]}))
    (tmp_path / "s1.aggregation.json").write_text(json.dumps({"segGroups": [{"label": "a", "segments": [5, 6]}, {"label": "b", "segments": [6]}]}))
    segments, groups = scans.vertex_segments(spark, f"{tmp_path}/*.segs.json"), scans.segment_groups(spark, f"{tmp_path}/*.aggregation.json")
    assert sorted((r["vertex"], r["label"]) for r in scans.annotated(segments, groups).collect()) == [(0, "a"), (1, "a"), (2, "b")]
    assert [r["segment"] for r in scans.repeated_segments(groups).collect()] == [6]


def test_label_files_round_trip(spark, tmp_path):
    data = [(f"s{s}", i, s * 1000 + i) for s in range(3) for i in range(20)]
    scans.write_label_lines(spark.createDataFrame(data, "scene string, point_idx long, code long").repartition(5), f"{tmp_path}/out")
    for s in range(3):
        [file] = Path(tmp_path, "out", f"scene=s{s}").glob("part-*.txt")
        (tmp_path / f"s{s}.txt").write_text(file.read_text())
    got = sorted(tuple(r) for r in scans.label_lines(spark, f"{tmp_path}/s*.txt").collect())
    assert got == data


def test_labels_from_zero(spark):
    rows = spark.createDataFrame([(float(i),) for i in (-1, 0, 12, 13)], "label double")
    assert [r[0] for r in rows.select(scans.labels_from_zero(F.col("label"))).collect()] == [0, 1, 13, 0]
