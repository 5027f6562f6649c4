"""A data source of mesh files: vertices and faces as tables, a binary file being read by as many tasks as it has ranges of rows.

    spark.dataSource.register(MeshSource)
    spark.read.format("mesh").option("element", "face").load("/scans/*.ply")

Vertices are (path, point_idx, columns...), the columns being those of the option `columns` (comma-separated) as doubles, null where a file lacks one; faces are (path, face, corners array<long>).
A task seeks to its rows.  Rows of an element with a list, such as faces, have a place of their own just if all lists have one length; where the file's size shows that, tasks take
ranges and make sure of it; else, and for text files, one task reads an element of a file from its beginning, batch by batch, never as a whole.  Files must lie on a mounted path, as tasks open and seek them.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scans import PLY_TYPES, write_lines

ROWS, BATCH = 1_000_000, 100_000


@dataclass
class Element:
    name: str
    rows: int
    fixed: list[tuple[str, str]]  # name and type of each property before and without lists
    lists: list[tuple[str, str, str]]  # name, type of the length, type of the entries


@dataclass
class Header:
    kind: str
    elements: list[Element]
    size: int  # bytes up to the data

    @property
    def order(self) -> str:
        return ">" if "big" in self.kind else "<"


def read_header(path: str) -> Header:
    kind, elements = "", []
    with open(path, "rb") as file:
        if file.readline().strip() != b"ply":
            raise ValueError(f"{path} isn't a polygon file")
        for raw in iter(file.readline, b""):
            x = raw.decode("ascii").split()
            if x[:1] == ["format"]:
                kind = x[1]
            elif x[:1] == ["element"]:
                elements.append(Element(x[1], int(x[2]), [], []))
            elif x[:2] == ["property", "list"]:
                elements[-1].lists.append((x[4], PLY_TYPES[x[2]], PLY_TYPES[x[3]]))
            elif x[:1] == ["property"]:
                if elements[-1].lists:
                    raise ValueError(f"{path}: a property behind a list isn't read")
                elements[-1].fixed.append((x[2], PLY_TYPES[x[1]]))
            elif x[:1] == ["end_header"]:
                return Header(kind, elements, file.tell())
    raise ValueError(f"{path} has no end of its header")


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int
    offset: int | None  # of the file's first row of the element; None: read from the beginning
    width: int  # bytes of a row


def fixed_width(header: Header, element: Element, lengths: tuple[int, ...] = ()) -> np.dtype:
    """The type of a row whose lists have these lengths."""
    fields = [(n, header.order + t) for n, t in element.fixed]
    for (n, c, t), k in zip(element.lists, lengths, strict=True):
        fields += [(f"{n} length", header.order + c), (n, header.order + t, (k,))]
    return np.dtype(fields)


def first_lengths(path: str, header: Header, element: Element, offset: int) -> tuple[int, ...]:
    """The lengths of the first row's lists."""
    lengths: list[int] = []
    with open(path, "rb") as file:
        file.seek(offset + fixed_width(header, Element(element.name, 1, element.fixed, [])).itemsize)
        for _, c, t in element.lists:
            lengths.append(int(np.frombuffer(file.read(np.dtype(c).itemsize), header.order + c)[0]))
            file.seek(lengths[-1] * np.dtype(t).itemsize, os.SEEK_CUR)
    return tuple(lengths)


def planned(path: str, wanted: str, rows: int) -> list[Part]:
    """The ranges of rows that tasks take."""
    header, parts = read_header(path), []
    offset: int | None = None if header.kind == "ascii" else header.size
    for i, element in enumerate(header.elements):
        width = None
        if offset is not None and element.rows:
            if not element.lists:
                width = fixed_width(header, element).itemsize
            elif i == len(header.elements) - 1:
                supposed = fixed_width(header, element, first_lengths(path, header, element, offset)).itemsize
                width = supposed if os.path.getsize(path) - offset == supposed * element.rows else None
        if element.name == wanted and element.rows:
            if width is None:
                parts.append(Part(path, 0, element.rows, None, 0))
            else:
                parts += [Part(path, a, min(element.rows, a + rows), offset, width) for a in range(0, element.rows, rows)]
        offset = None if element.rows and width is None or offset is None else offset + (width or 0) * element.rows
    return parts


def ranged(part: Part, header: Header, element: Element) -> Iterator[np.ndarray]:
    """The rows of a range, as records."""
    kind = fixed_width(header, element, first_lengths(part.path, header, element, part.offset) if element.lists else ())
    with open(part.path, "rb") as file:
        file.seek(part.offset + part.first * part.width)
        for a in range(part.first, part.last, BATCH):
            n = min(part.last, a + BATCH) - a
            table = np.frombuffer(file.read(n * part.width), kind)
            if len(table) < n:
                raise ValueError(f"{part.path} ends before its {element.name} {a + len(table)}")
            for name, _, _ in element.lists:
                if (table[f"{name} length"] != table[name].shape[1]).any():
                    raise ValueError(f"{part.path}: lists of several lengths that have the size of lists of one")
            yield table


def one_by_one(path: str, header: Header, wanted: str) -> Iterator[tuple[list[float], list[list[int]]]]:
    """Each row's properties and lists, read from the beginning."""
    with open(path, "rb") as file:
        file.seek(header.size)
        for element in header.elements:
            for _ in range(element.rows):
                if header.kind == "ascii":
                    x, lists = file.readline().split(), []
                    fixed, at = [float(v) for v in x[: len(element.fixed)]], len(element.fixed)
                    for _ in element.lists:
                        k = int(x[at])
                        lists.append([int(v) for v in x[at + 1 : at + 1 + k]])
                        at += 1 + k
                else:
                    take = lambda t, k=1: np.frombuffer(file.read(np.dtype(t).itemsize * k), header.order + t, k)
                    fixed = [float(take(t)[0]) for _, t in element.fixed]
                    lists = [take(t, int(take(c)[0])).tolist() for _, c, t in element.lists]
                if element.name == wanted:
                    yield fixed, lists
            if element.name == wanted:
                return


class MeshReader(DataSourceReader):
    def __init__(self, paths: list[str], element: str, columns: list[str], rows: int):
        self.paths, self.element, self.columns, self.rows = paths, element, columns, rows

    def partitions(self) -> list[Part]:
        return [p for path in self.paths for p in planned(path, self.element, self.rows)] or [Part("", 0, 0, None, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        header = read_header(partition.path)
        element = next(e for e in header.elements if e.name == self.element)
        names = [n for n, _ in element.fixed]
        if partition.offset is not None:
            at = partition.first
            for table in ranged(partition, header, element):
                if self.element == "face":
                    corners = table[element.lists[0][0]].astype(np.int64)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * corners.shape[1]), pa.array(corners.ravel()))
                    yield self.batch(partition.path, at, [values])
                else:
                    yield self.batch(partition.path, at, [pa.array(table[c].astype(float)) if c in names else pa.nulls(len(table), pa.float64()) for c in self.columns])
                at += len(table)
            return
        held: list = []
        first = 0
        for row in one_by_one(partition.path, header, self.element):
            held.append(row)
            if len(held) == BATCH:
                yield self.loose(partition.path, first, held, names)
                first, held = first + len(held), []
        if held:
            yield self.loose(partition.path, first, held, names)

    def loose(self, path: str, first: int, rows: list, names: list[str]) -> pa.RecordBatch:
        if self.element == "face":
            return self.batch(path, first, [pa.array([lists[0] for _, lists in rows], pa.list_(pa.int64()))])
        return self.batch(path, first, [pa.array([f[names.index(c)] for f, _ in rows], pa.float64()) if c in names else pa.nulls(len(rows), pa.float64()) for c in self.columns])

    def batch(self, path: str, first: int, values: list[pa.Array]) -> pa.RecordBatch:
        n = len(values[0])
        number = "face" if self.element == "face" else "point_idx"
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(first, first + n)), *values], names=["path", number, *(["corners"] if self.element == "face" else self.columns)])


class MeshSource(DataSource):
    """Options: path (one, several with commas, or a pattern), element (vertex or face), columns (x,y,z by default), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", "x,y,z").split(",")]

    def schema(self) -> str:
        if self.options.get("element", "vertex") == "face":
            return "path string, face long, corners array<long>"
        return f"path string, point_idx long, {', '.join(f'`{c}` double' for c in self._columns())}"

    def reader(self, schema) -> MeshReader:  # noqa: ANN001
        paths: list[str] = []
        for given in self.options["path"].split(","):
            url = urlparse(given.strip())
            if url.scheme not in ("", "file"):
                raise ValueError(f"{given} isn't on a mounted path")
            found = sorted(glob.glob(url.path))
            if not found:
                raise FileNotFoundError(given)
            paths += found
        return MeshReader(paths, self.options.get("element", "vertex"), self._columns(), int(self.options.get("rows", ROWS)))


def mesh(spark: SparkSession, paths: str, columns: tuple[str, ...] = ("x", "y", "z"), rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of mesh files."""
    spark.dataSource.register(MeshSource)
    read = lambda element: spark.read.format("mesh").option("element", element).option("columns", ",".join(columns)).option("rows", str(rows)).load(paths)
    return read("vertex"), read("face")


def face_groups(faces: DataFrame, groups: DataFrame) -> DataFrame:
    """(face, group) of each corner for `neighbors.face_adjacency`: faces (path, face, corners), groups (path, point_idx, group); a face's name is that of its file and its number."""
    corners = faces.select("path", F.concat_ws(":", "path", F.col("face").cast("string")).alias("face"), F.explode("corners").alias("point_idx"))
    return corners.join(groups.select("path", "point_idx", "group"), ["path", "point_idx"]).select("face", "group")


def write_mesh(points: DataFrame, faces: DataFrame, path: str) -> None:
    """A folder per scene with a text file of its vertices (scene, point_idx, x, y, z) in order, numbered from 0 without gaps, and faces (scene, face, corners)."""
    count = points.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).join(faces.groupBy("scene").agg(F.count(F.lit(1)).alias("m")), "scene", "left")
    text = lambda name, n: F.concat(F.lit(f"element {name} "), F.coalesce(n, F.lit(0)).cast("string"))
    head = [F.lit("ply"), F.lit("format ascii 1.0"), text("vertex", F.col("n")), *[F.lit(f"property double {c}") for c in "xyz"], text("face", F.col("m")), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    lines = count.select("scene", F.posexplode(F.array(*head)).alias("line", "value")).select("scene", F.lit(0).alias("part"), F.col("line").cast("long").alias("line"), "value")
    lines = lines.unionByName(points.select("scene", F.lit(1).alias("part"), F.col("point_idx").cast("long").alias("line"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]).alias("value")))
    corners = F.concat_ws(" ", F.size("corners").cast("string"), F.array_join(F.col("corners").cast("array<string>"), " "))
    lines = lines.unionByName(faces.select("scene", F.lit(2).alias("part"), F.col("face").cast("long").alias("line"), corners.alias("value")))
    write_lines(lines.select("scene", (F.col("part") * F.lit(1 << 48) + F.col("line")).alias("line"), "value"), path)
