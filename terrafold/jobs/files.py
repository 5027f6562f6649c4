"""Queries that write the given tables in the shapes of scans and label files, and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import cut, work_dir
from ..operators import colours, voxel
from ..operators.neighbors import face_adjacency
from ..sources import meshes, scans
from ..sources.fixtures import POINTS, cloud, points, table
from .neighbours import edges, edges_sql
from .voxels import MAJORITY, WIDE, cells_sql

PALETTE = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]
CODES = {"chair": 3, "table": 4, "sofa": 5}


def object_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation folders with a text file per object, read with class, number and point index."""
    path = work_dir(spark, "objects")
    names = F.element_at(F.array(*[F.lit(x) for x in ("chair", "lamp", "sofa", "table")]), (F.col("ins") + 1).cast("int"))
    p = points(spark, sf_dir).withColumn("name", F.concat(names, F.lit("_"), F.col("ins") + 1))
    value = F.concat_ws(" ", *[F.round(a, 4).cast("string") for a in "xyz"], *[(F.col("point_idx") * k % 256).cast("string") for k in (1, 3, 7)])
    rows = cut(p.select(F.col("scene").alias("room"), "name", "point_idx", value.alias("value")))
    rows.repartition("room", "name").sortWithinPartitions("room", "name", "point_idx").select("room", "name", "value").write.partitionBy("room", "name").text(path)
    found = scans.objects(spark, f"{path}/room=*/name=*/*.txt", CODES, name_at=-2)
    return found.select(F.regexp_extract("scene", r"room=(.*)", 1).cast("int").alias("scene"), "point_idx", *"xyz", *"rgb", F.col("sem").cast("long").alias("sem"), F.col("ins").cast("long").alias("ins"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files with a code per point, read by line."""
    path = work_dir(spark, "labels")
    scans.write_label_lines(points(spark, sf_dir).select("scene", (F.col("point_idx") % 7 * 1000 + F.col("sp")).alias("code"), "point_idx"), path)
    found = scans.label_lines(spark, f"{path}/scene=*")
    return found.select(F.col("scene").cast("int").alias("scene"), F.col("point_idx").alias("line"), "code")


def polygon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points coloured by their superpoint's class in polygon files, read with a column that they lack."""
    path = work_dir(spark, "polygons")
    p = scans.coloured(points(spark, sf_dir).withColumn("kind", F.when(F.col("sp") == 7, -1).otherwise(F.col("sp"))), "kind", PALETTE)
    scans.write_ply(p.withColumns({a: F.round(a, 4) for a in "xyz"}), path, {"x": "double", "y": "double", "z": "double", "red": "uchar", "green": "uchar", "blue": "uchar", "sem": "int"})
    found = scans.ply_vertices(spark, f"{path}/scene=*/*.txt", ["x", "y", "z", "red", "green", "blue", "sem", "ins"])
    return found.select(F.regexp_extract("path", r"scene=([^/]*)", 1).cast("int").alias("scene"), F.col("point_idx").alias("line"), *"xyz", "red", "green", "blue", "sem", F.coalesce("ins", F.lit(-1.0)).alias("ins"))


def outdoor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large scan as text (place, intensity, colour) and its labels as another file, pruned by voxels over the whole scan, not by chunks."""
    path = work_dir(spark, "outdoor")
    c = cloud(spark, sf_dir)
    value = F.concat_ws(" ", *[F.format_string("%.6f", a) for a in "xyz"], F.lit("0"), F.lit("1"), F.lit("2"), F.lit("3"), F.col("label").cast("string"))
    cut(c.select("scene", value.alias("value"))).write.partitionBy("scene").text(path)
    rows = scans.delimited_points(spark, f"{path}/scene=*/*.txt", ["x", "y", "z", "", "r", "g", "b", "label"])
    found = voxel.downsampled(rows.withColumn("scene", F.regexp_extract("path", r"scene=([^/]*)", 1).cast("long")).withColumn("label", F.col("label").cast("long")), WIDE, "label")
    return found.select("scene", *voxel.CELL, "points", "label")


def segment_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment and group files of a mesh as JSON, joined to labelled vertices; of several groups of a segment the last counts."""
    path = work_dir(spark, "segments")
    p = points(spark, sf_dir)
    order = F.array_sort(F.collect_list(F.struct("point_idx", "sp")))
    p.groupBy(F.concat(F.lit("s"), "scene").alias("file")).agg(order["sp"].alias("segIndices")).repartition("file").write.partitionBy("file").json(f"{path}/segs")
    members = p.select(F.concat(F.lit("s"), "scene").alias("file"), "sem", (F.col("sp") % 6).alias("segment")).distinct()
    groups = members.groupBy("file", "sem").agg(F.sort_array(F.collect_list("segment")).alias("segments")).select("file", F.struct("sem", F.concat(F.lit("class"), "sem").alias("label"), "segments").alias("g"))
    groups = groups.groupBy("file").agg(F.array_sort(F.collect_list("g")).alias("segGroups")).withColumn("segGroups", F.transform("segGroups", lambda g: F.struct(g["label"].alias("label"), g["segments"].alias("segments"))))
    groups.repartition("file").write.partitionBy("file").json(f"{path}/groups")
    found = scans.annotated(scans.vertex_segments(spark, f"{path}/segs/file=*/*.json"), scans.segment_groups(spark, f"{path}/groups/file=*/*.json"), r"file=([^/]*)/[^/]*$")
    return found.select("scene", F.col("vertex").cast("long").alias("vertex"), "label", F.col("ordinal").cast("long").alias("ordinal"))


def label_map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of raw and mapped names as tab-separated values, joined to rows; unknown names are unannotated."""
    path = work_dir(spark, "names")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 3 != 1").select(F.lit(0).alias("id"), F.col("n_name").alias("raw"), F.col("r_name").alias("to"))
    rows.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return scans.mapped(suppliers, scans.label_map(spark, path, 1, 2), "n_name").select("s_suppkey", "name")


def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written by scene as Parquet; the test split is the scenes whose name has the area."""
    path = work_dir(spark, "scenes")
    scans.write_scenes(points(spark, sf_dir).withColumn("scene", F.concat(F.lit("area_"), F.col("scene") % 3, F.lit("_room_"), F.col("scene"))), path)
    return scans.read_scenes(spark, path, containing="area_2").select("scene", "point_idx", F.round("x", 6).alias("x"), "sp")


def repeated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that several groups of a file name; files are customers' segments, groups their orders' months, segments the days."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), F.month("o_orderdate").alias("ordinal"), (F.col("o_orderkey") % 97).alias("segment"))
    return scans.repeated_segments(o.filter("ordinal <= 2 or segment % 3 = 0"))


def embedding_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of all embeddings by their whole vectors."""
    e = table(spark, sf_dir, "embeddings")
    return colours.embedding_colours(e.select("vec_id", "embedding"), "embedding").select("vec_id", *colours.NAMES)


def error_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong classes of points, class 0 being unknown."""
    p = points(spark, sf_dir).withColumns({c: (F.col("point_idx") * m % 256).cast("int") for c, m in zip(colours.NAMES, (7, 11, 13), strict=True)})
    return colours.error_colours(p, "sem", "noisy").select("scene", "point_idx", *colours.NAMES)


def mesh_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints that meet in a face of mesh files: every point with its two nearest is a face, written and read again."""
    path = work_dir(spark, "meshes")
    place = (F.row_number().over(W.partitionBy("scene").orderBy("point_idx")) - 1).cast("long")
    p = cut(points(spark, sf_dir).withColumn("vertex", place))
    at = p.select("scene", F.col("point_idx").alias("dst"), F.col("vertex").alias("corner"))
    near = edges(spark, sf_dir, 2).select("scene", "src", "dst", "rank").join(at, ["scene", "dst"])
    own = p.select("scene", F.col("point_idx").alias("src"), F.col("vertex").alias("face"))
    faces = near.groupBy("scene", "src").agg(F.sort_array(F.collect_list(F.struct("rank", "corner"))).alias("two")).join(own, ["scene", "src"])
    faces = faces.select("scene", "face", F.concat(F.array("face"), F.transform("two", lambda t: t["corner"])).alias("corners"))
    meshes.write_mesh(p.select("scene", F.col("vertex").alias("point_idx"), *"xyz"), faces, path)
    vertices, read = meshes.mesh(spark, f"{path}/scene=*/part-*")
    scene = F.regexp_extract("path", r"scene=([^/]*)/", 1).cast("int").alias("scene")
    groups = vertices.select(scene, "path", "point_idx").join(p.select("scene", F.col("vertex").alias("point_idx"), "sp"), ["scene", "point_idx"])
    groups = groups.select("path", "point_idx", F.concat_ws(":", F.col("scene").cast("string"), F.col("sp").cast("string")).alias("group"))
    return face_adjacency(meshes.face_groups(read, groups))


QUERIES = {f.__name__: f for f in (object_text_files, label_files, polygon_files, outdoor_scan, segment_annotations, label_map_table, scene_split, embedding_colours, error_colours, mesh_adjacency, repeated_segments)}

_LINE = "row_number() OVER (PARTITION BY scene ORDER BY point_idx) - 1"
_COLOUR = ", ".join(f"CAST(CASE WHEN sp = 7 THEN 128 ELSE [{', '.join(str(c[i]) for c in PALETTE)}][sp % 4 + 1] END AS DOUBLE) AS {n}" for i, n in enumerate(("red", "green", "blue")))
ORACLES = {
    "object_text_files": f"""WITH {POINTS}, o AS (SELECT *, CASE ins WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS number, CASE ins WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 5 ELSE 4 END AS code FROM points)
        SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY number, point_idx) - 1 AS point_idx, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, CAST(point_idx % 256 AS DOUBLE) AS r, CAST(point_idx * 3 % 256 AS DOUBLE) AS g, CAST(point_idx * 7 % 256 AS DOUBLE) AS b,
        CAST(code AS BIGINT) AS sem, dense_rank() OVER (PARTITION BY scene ORDER BY number) - 1 AS ins FROM o""",
    "label_files": f"WITH {POINTS} SELECT scene, {_LINE} AS line, point_idx % 7 * 1000 + sp AS code FROM points",
    "polygon_files": f"WITH {POINTS} SELECT scene, {_LINE} AS line, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, {_COLOUR}, CAST(sem AS DOUBLE) AS sem, CAST(-1 AS DOUBLE) AS ins FROM points",
    "outdoor_scan": f"""WITH cloud AS (SELECT l_suppkey % 4 AS scene, round(l_quantity, 6) AS x, round(l_extendedprice / 1000, 6) AS y, round(l_discount * 100, 6) AS z, l_partkey % 5 AS label FROM lineitem), {cells_sql("cloud", WIDE)}, m AS ({MAJORITY.format("label")})
        SELECT scene, vx, vy, vz, points, m.label FROM (SELECT scene, vx, vy, vz, count(*) AS points FROM cells GROUP BY ALL) JOIN m USING (scene, vx, vy, vz)""",
    "segment_annotations": f"""WITH {POINTS}, g AS (SELECT DISTINCT scene, sem, sp % 6 AS segment FROM points), o AS (SELECT scene, sem, row_number() OVER (PARTITION BY scene ORDER BY sem) - 1 AS ordinal FROM (SELECT DISTINCT scene, sem FROM points)),
        b AS (SELECT scene, segment, max(ordinal) AS ordinal, max_by(sem, ordinal) AS sem FROM g JOIN o USING (scene, sem) GROUP BY scene, segment), v AS (SELECT scene, {_LINE} AS vertex, sp FROM points)
        SELECT 's' || v.scene AS scene, vertex, 'class' || sem AS label, ordinal FROM v JOIN b ON b.scene = v.scene AND b.segment = v.sp""",
    "label_map_table": "SELECT s_suppkey, CASE WHEN n_nationkey % 3 <> 1 THEN r_name ELSE 'unannotated' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "scene_split": f"WITH {POINTS} SELECT 'area_' || scene % 3 || '_room_' || scene AS scene, point_idx, round(x, 6) AS x, sp FROM points WHERE scene % 3 = 2",
    "error_colours": f"""WITH {POINTS}, c AS (SELECT *, point_idx * 7 % 256 AS r, point_idx * 11 % 256 AS g, point_idx * 13 % 256 AS b FROM points),
        h AS (SELECT *, greatest(r, g, b) / CAST(255 AS DOUBLE) AS high, least(r, g, b) / CAST(255 AS DOUBLE) AS low FROM c), s AS (SELECT *, least(CASE WHEN high > 0 THEN (high - low) / high ELSE 0 END + CAST(0.3 AS DOUBLE), 1) AS strong, least(high + CAST(0.1 AS DOUBLE), 1) AS light FROM h),
        d AS (SELECT *, light * (1 - strong) AS dark, sem = noisy OR sem = 0 AS good FROM s)
        SELECT scene, point_idx, CAST(floor(255 * CASE WHEN good THEN dark ELSE light END) AS INT) AS red, CAST(floor(255 * CASE WHEN good THEN light ELSE dark END) AS INT) AS green, CAST(floor(255 * dark) AS INT) AS blue FROM d""",
    "mesh_adjacency": f"""WITH {POINTS}, {edges_sql(2)}, f AS (SELECT point_idx AS face, point_idx AS corner FROM points UNION ALL SELECT src, dst FROM edges), g AS (SELECT DISTINCT f.face, p.scene || ':' || p.sp AS g FROM f JOIN points p ON p.point_idx = f.corner)
        SELECT DISTINCT a.g AS src, b.g AS dst FROM g a JOIN g b ON a.face = b.face AND a.g <> b.g""",
    "repeated_segments": """SELECT o_custkey % 50 AS file, o_orderkey % 97 AS segment, count(DISTINCT month(o_orderdate)) AS groups FROM orders
        WHERE month(o_orderdate) <= 2 OR o_orderkey % 97 % 3 = 0 GROUP BY ALL HAVING count(DISTINCT month(o_orderdate)) > 1""",
}
