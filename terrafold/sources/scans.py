"""Readers of raw scans and their annotations, and writers of per-scene label files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import attach, cut
from ..operators.neighbors import knn
from ..operators.order import running

UNKNOWN_CLASS, UNANNOTATED = 12, "unannotated"


def objects(spark: SparkSession, paths: str, codes: dict[str, int], first: int = 0, name_at: int = -1) -> DataFrame:
    """(scene, point_idx, x, y, z, r, g, b, sem, ins) of files scene/Annotations/class_number.txt with a point per line.

    An object's class is its file's name (or, with name_at, the name of a folder above it) up to `_`, its number the place of its file in the scene's sorted names.
    Objects are numbered over the few file names, not over points; points are numbered in the order of files and lines.  Lines that aren't six
    numbers are left out.
    """
    lines = numbered_lines(spark, paths)
    value = F.split(F.trim("value"), r"\s+")
    numbers = [F.get(value, i).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "r", "g", "b"))]
    parts = F.split("path", "/")
    scene = F.element_at(parts, -3)
    points = lines.select(scene.alias("scene"), "path", "line", *numbers).dropna()
    files = lines.select(scene.alias("scene"), "path").distinct()
    name = F.regexp_extract(F.element_at(parts, name_at), r"(?:.*=)?([^_]*)_", 1)
    code = F.coalesce(*[F.when(name == k, v) for k, v in codes.items()], F.lit(UNKNOWN_CLASS))
    files = files.select("scene", "path", code.alias("sem"), (F.row_number().over(W.partitionBy("scene").orderBy("path")) - 1 + first).alias("ins"))
    named = attach(points, files, ["scene", "path"]).drop("path")
    placed = running(named, ["scene"], ["ins", "line"], [])
    return placed.select("scene", (F.col("place") - 1).alias("point_idx"), *[c for c in named.columns if c not in ("scene", "line")])


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, value) of text files; lines count from 0.

    A large file is read in blocks by several tasks: a line's number is its place in its block and the lines of the blocks before.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = cut(rows, "lines")
    order = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select("path", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("path", "block").orderBy("at")) - 1
    return attach(rows.withColumn("place", place), blocks, ["path", "block"]).select("path", (F.col("before") + F.col("place")).alias("line"), "value")


def object_labels(room: DataFrame, objects: DataFrame) -> DataFrame:
    """room (scene, id, x, y, z) with ordinal and label of the object one of whose points has it as nearest; of several the last object.

    objects: (scene, ordinal, label, id, x, y, z), a row per point of an object.  Room points that are nobody's nearest are left out.
    """
    near = knn(objects.select("scene", "id", *"xyz"), room.select("scene", "id", *"xyz"), 1)
    named = near.join(objects.select("scene", F.col("id").alias("src"), "ordinal", "label"), ["scene", "src"])
    best = named.groupBy("scene", F.col("dst").alias("id")).agg(F.max(F.struct("ordinal", "label")).alias("best"))
    return room.join(best, ["scene", "id"]).select(*room.columns, "best.ordinal", "best.label")


def label_map(spark: SparkSession, path: str, raw: int = 1, to: int = 7) -> DataFrame:
    """(raw_name, name) from a table of tab-separated values with a header."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col(f"`{rows.columns[raw]}`").alias("raw_name"), F.col(f"`{rows.columns[to]}`").alias("name"))


def mapped(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows with the mapped name of a raw one, UNANNOTATED if the map has none."""
    return rows.join(names.withColumnRenamed("raw_name", column), column, "left").withColumn("name", F.coalesce("name", F.lit(UNANNOTATED)))


def vertex_segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, vertex, segment) from JSON files with segIndices."""
    rows = spark.read.schema("segIndices array<long>").option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode("segIndices").alias("vertex", "segment"))


def segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, label, segment) from JSON files with segGroups; ordinal is the group's place."""
    rows = spark.read.schema("segGroups array<struct<label:string,segments:array<long>>>").option("multiLine", True).json(path)
    groups = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode("segGroups").alias("ordinal", "g"))
    return groups.select("file", "ordinal", "g.label", F.explode("g.segments").alias("segment"))


def annotated(segments: DataFrame, groups: DataFrame, scene_of: str = r"([^/.]*)[^/]*$") -> DataFrame:
    """(scene, vertex, label, ordinal) of the vertices of grouped segments; of several groups of a segment the last counts."""
    scene = F.regexp_extract("file", scene_of, 1).alias("scene")
    last = groups.select(scene, "segment", "ordinal", "label").groupBy("scene", "segment").agg(F.max(F.struct("ordinal", "label")).alias("g"))
    return segments.select(scene, "vertex", "segment").join(last, ["scene", "segment"]).select("scene", "vertex", "g.label", "g.ordinal")


def repeated_segments(groups: DataFrame) -> DataFrame:
    """Segments that more than one group of their file has; a sound scan has none."""
    return groups.groupBy("file", "segment").agg(F.countDistinct("ordinal").alias("groups")).filter("groups > 1")


def label_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(scene, point_idx, code): files with a number per line, the line's place being the point; the file's name, or its scene= folder, is the scene."""
    lines = numbered_lines(spark, paths)
    folder = F.regexp_extract("path", r"scene=([^/]*)/[^/]*$", 1)
    scene = F.when(folder != "", folder).otherwise(F.regexp_extract("path", r"([^/]*?)(\.txt)?$", 1))
    return lines.filter(F.trim("value") != "").select(scene.alias("scene"), F.col("line").alias("point_idx"), F.trim("value").cast("long").alias("code"))


def write_label_lines(codes: DataFrame, path: str) -> None:
    """A folder per scene with one file, a code per line in the order of the points; a scene's rows meet in one task, as its file asks."""
    write_lines(codes.select("scene", F.col("point_idx").alias("line"), F.col("code").cast("string").alias("value")), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder per scene with one text file of the lines (scene, line, value) in order."""
    rows = cut(lines.select("scene", "line", "value"))
    rows.repartition("scene").sortWithinPartitions("scene", "line").select("scene", "value").write.mode("overwrite").partitionBy("scene").text(path)


def delimited_points(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = r"\s+") -> DataFrame:
    """(path, line, columns) of text files with a point per line; columns that have no name ("") are skipped, and lines with other than numbers left out."""
    value = F.split(F.trim("value"), sep)
    numbers = [F.get(value, i).try_cast("double").alias(c) for i, c in enumerate(columns) if c]
    return numbered_lines(spark, paths).select("path", "line", *numbers).dropna()


def with_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """points (scene, point_idx, ...) with the code of the label files' same line, as label."""
    return points.join(labels.select("scene", "point_idx", F.col("code").alias("label")), ["scene", "point_idx"])


def arrays(spark: SparkSession, paths: str, columns: list[str]) -> DataFrame:
    """(path, point_idx, columns) of files with one saved matrix each, a row per point; a file is read by one task, as its format asks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                for first in range(0, len(matrix), 100_000):
                    part = matrix[first : first + 100_000]
                    yield pd.DataFrame({"path": path, "point_idx": np.arange(first, first + len(part)), **{c: part[:, i].astype(float) for i, c in enumerate(columns)}})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, f"path string, point_idx long, {', '.join(f'{c} double' for c in columns)}")


def labels_from_zero(label: Column, last: int = 14) -> Column:
    """Labels of matrices that count from 0 with -1 for none: one more, and 0 for none and for what becomes `last`."""
    return F.when(label + 1 == last, 0).otherwise(label + 1).cast("long")


#: Fixed names of the types in the headers of polygon files, and what they are.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4",
    "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def ply_vertices(spark: SparkSession, paths: str, columns: list[str]) -> DataFrame:
    """(path, point_idx, columns) of polygon files, text or binary; a column that a file lacks is null.  A file is read by one task, as its format asks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                head, body = content.split(b"end_header", 1)
                lines = [x.split() for x in head.decode("ascii").splitlines()]
                kind = next(x[1] for x in lines if x[:1] == ["format"])
                elements = [i for i, x in enumerate(lines) if x[:1] == ["element"]]
                start = next(i for i in elements if lines[i][1] == "vertex")
                if start != elements[0]:
                    raise ValueError(f"{path}: vertices don't come first")
                n, names = int(lines[start][2]), []
                for x in lines[start + 1 :]:
                    if x[0] == "element":
                        break
                    names.append((x[2], PLY_TYPES[x[1]]))
                body = body[body.index(b"\n") + 1 :]
                if kind == "ascii":
                    table = np.array([x.split()[: len(names)] for x in body.decode("ascii").splitlines()[:n]], float).reshape(n, len(names))
                    found = {name: table[:, i] for i, (name, _) in enumerate(names)}
                else:
                    order = "<" if "little" in kind else ">"
                    table = np.frombuffer(body, np.dtype([(name, order + t) for name, t in names]), n)
                    found = {name: table[name].astype(float) for name, _ in names}
                for first in range(0, n, 100_000):
                    last = min(n, first + 100_000)
                    yield pd.DataFrame({"path": path, "point_idx": np.arange(first, last), **{c: found[c][first:last] if c in found else np.nan for c in columns}})

    read = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, f"path string, point_idx long, {', '.join(f'{c} double' for c in columns)}")
    return read.select("path", "point_idx", *[F.nanvl(c, F.lit(None)).alias(c) for c in columns])


def write_ply(points: DataFrame, path: str, properties: dict[str, str]) -> None:
    """A folder per scene with a polygon file in text: the properties (column to type) of its points in the order of point_idx."""
    count = points.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    head = ["ply", "format ascii 1.0", None, *[f"property {t} {c}" for c, t in properties.items()], "end_header"]
    header = count.select("scene", F.posexplode(F.array(*[F.concat(F.lit("element vertex "), F.col("n").cast("string")) if x is None else F.lit(x) for x in head])).alias("line", "value"))
    header = header.select("scene", (F.col("line") - len(head)).cast("long").alias("line"), "value")
    value = F.concat_ws(" ", *[(F.col(c).cast("long") if PLY_TYPES[t][0] in "iu" else F.col(c)).cast("string") for c, t in properties.items()])
    write_lines(header.unionByName(points.select("scene", F.col("point_idx").alias("line"), value.alias("value"))), path)


def coloured(points: DataFrame, label: str, palette: list[tuple[int, int, int]]) -> DataFrame:
    """points with red, green and blue from the palette by their label, grey for one below 0."""
    colours = F.array(*[F.array(*map(F.lit, c)) for c in palette])
    at = F.when(F.col(label) < 0, F.array(F.lit(128), F.lit(128), F.lit(128))).otherwise(F.get(colours, (F.col(label) % len(palette)).cast("int")))
    return points.withColumns({c: F.get(at, F.lit(i)) for i, c in enumerate(("red", "green", "blue"))})


def write_scenes(rows: DataFrame, path: str) -> None:
    """Points, nodes or edges as Parquet with a folder per scene; a large scene is written by several tasks."""
    rows.write.mode("overwrite").partitionBy("scene").parquet(path)


def read_scenes(spark: SparkSession, path: str, scenes: list[str] | None = None, containing: str | None = None) -> DataFrame:
    """What write_scenes wrote, of some scenes, or of those whose name contains a text, such as the area of a test split; other folders aren't read."""
    rows = spark.read.option("basePath", path).parquet(path)
    if scenes is not None:
        rows = rows.filter(F.col("scene").isin(scenes))
    return rows if containing is None else rows.filter(F.contains(F.col("scene").cast("string"), F.lit(containing)))
