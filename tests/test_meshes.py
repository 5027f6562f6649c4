"""Mesh files in ranges of rows: binary and text, triangles and mixed polygons, several files, and adjacency from their faces."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from terrafold.operators import neighbors
from terrafold.sources import meshes


def write(path, vertices, faces, kind="binary_little_endian", behind=False):
    """A polygon file with colours and faces; behind: another element after the faces."""
    head = ["ply", f"format {kind} 1.0", "comment made for a test", f"element vertex {len(vertices)}", *[f"property float {c}" for c in "xyz"], "property uchar red"]
    head += [f"element face {len(faces)}", "property list uchar int vertex_indices"] + (["element edge 1", "property int a"] if behind else []) + ["end_header", ""]
    order = ">" if "big" in kind else "<"
    with open(path, "wb") as file:
        file.write("\n".join(head).encode())
        if kind == "ascii":
            file.write("".join(" ".join(map(str, v)) + "\n" for v in vertices).encode())
            file.write("".join(" ".join(map(str, [len(f), *f])) + "\n" for f in faces).encode())
        else:
            file.write(b"".join(struct.pack(order + "fffB", *v) for v in vertices))
            file.write(b"".join(struct.pack(f"{order}B{len(f)}i", len(f), *f) for f in faces))
            file.write(struct.pack(order + "i", 7) if behind else b"")


def made(n=2500, mixed=False, seed=1):
    rng = random.Random(seed)
    vertices = [(i / 4, -i / 8, rng.randrange(100) / 2, i % 256) for i in range(n)]
    return vertices, [[rng.randrange(n) for _ in range(rng.choice([3, 4, 5]) if mixed else 3)] for _ in range(n * 2)]


@pytest.mark.parametrize("kind,mixed,behind,tasks", [("binary_little_endian", False, False, 13), ("binary_big_endian", False, False, 13), ("binary_little_endian", True, False, 1), ("binary_little_endian", False, True, 1), ("ascii", True, False, 1)])
def test_vertices_and_faces(spark, tmp_path, kind, mixed, behind, tasks):
    vertices, faces = made(mixed=mixed)
    write(tmp_path / "a.ply", vertices, faces, kind, behind)
    v, f = meshes.mesh(spark, f"file://{tmp_path}/*.ply", ("x", "y", "z", "red", "alpha"), rows=400)
    assert f.rdd.getNumPartitions() == tasks and v.rdd.getNumPartitions() == (1 if kind == "ascii" else 7)
    rows = v.orderBy("point_idx").collect()
    assert [(r["point_idx"], r["x"], r["y"], r["z"], r["red"], r["alpha"]) for r in rows] == [(i, *map(float, x), None) for i, x in enumerate(vertices)]
    assert [r["corners"] for r in f.orderBy("face").collect()] == faces


def test_several_files_and_adjacency(spark, tmp_path):
    sets = {name: made(60, seed=s) for s, name in enumerate(("a", "b"))}
    for name, (vertices, faces) in sets.items():
        write(tmp_path / f"{name}.ply", vertices, faces)
    v, f = meshes.mesh(spark, str(tmp_path / "*.ply"), rows=50)
    groups = v.select("path", "point_idx", F.concat(F.regexp_extract("path", r"(\w)\.ply", 1), (F.col("point_idx") % 12).cast("string")).alias("group"))
    got = {(r["src"], r["dst"]) for r in neighbors.face_adjacency(meshes.face_groups(f, groups)).collect()}
    assert got == {(f"{n}{i % 12}", f"{n}{j % 12}") for n, (_, faces) in sets.items() for face in faces for i in face for j in face if i % 12 != j % 12}


def test_odd_files(spark, tmp_path):
    write(tmp_path / "empty.ply", [], [])
    v, f = meshes.mesh(spark, str(tmp_path / "empty.ply"))
    assert v.count() == f.count() == 0
    # three lists of two, three and four entries take as many bytes as three of three
    vertices, _ = made(5)
    write(tmp_path / "even.ply", vertices, [[0, 1, 2], [0, 1], [0, 1, 2, 3]])
    with pytest.raises(Exception, match="lists of several lengths"):
        meshes.mesh(spark, str(tmp_path / "even.ply"))[1].collect()
    (tmp_path / "no.ply").write_bytes(b"obj\n")
    with pytest.raises(Exception, match="isn't a polygon file"):
        meshes.mesh(spark, str(tmp_path / "no.ply"))[0].collect()


def test_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("s", 0, 0.5, 1.0, 2.0), ("s", 1, -1.0, 0.0, 3.0), ("s", 2, 4.0, 4.0, 4.0), ("t", 0, 1.0, 1.0, 1.0)], "scene string, point_idx long, x double, y double, z double")
    faces = spark.createDataFrame([("s", 0, [0, 1, 2]), ("s", 1, [2, 1])], "scene string, face long, corners array<long>")
    meshes.write_mesh(points, faces, f"file://{tmp_path}/out")
    v, f = meshes.mesh(spark, f"{tmp_path}/out/scene=*/part-*")
    scene = F.regexp_extract("path", "scene=([^/]*)", 1)
    assert {(r[0], *r[2:]) for r in v.select(scene, "path", "point_idx", *"xyz").collect()} == {tuple(r) for r in points.collect()}
    assert {(r[0], r[1], tuple(r[2])) for r in f.select(scene, "face", "corners").collect()} == {("s", 0, (0, 1, 2)), ("s", 1, (2, 1))}
