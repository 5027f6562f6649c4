"""Queries on the preparation of points, labels and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, prepare, voxel
from ..sources import scans
from ..sources.fixtures import CLOUD, POINTS, cloud, points, table
from .objects import PARTLY, partly_labelled
from .voxels import cells_sql

SCALE, WIDE = 50, 5.0
FULL, SHRINK, HELD, STEPS = 64.0, 8.0, 3000, 8


def rounded(df: DataFrame, columns: str = "xyz") -> DataFrame:
    return df.withColumns({a: F.round(a, 6) for a in columns})


def integer_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.integer_cells(points(spark, sf_dir), SCALE, ["scene", "point_idx"])


def affine_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scene is turned by an angle of its own and every second one is mirrored."""
    p = points(spark, sf_dir).select("scene", "point_idx", *"xyz")
    return rounded(prepare.affine(p, prepare.rotation(F.col("scene") * 0.7, F.when(F.col("scene") % 2 == 0, 1.0).otherwise(-1.0))))


def random_box_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepare.random_box(cloud(spark, sf_dir), FULL, SHRINK, HELD, STEPS)).withColumn("step", F.col("step").cast("long"))


def crop_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the largest block, moved to its least corner."""
    return rounded(voxel.block_rows(cloud(spark, sf_dir), 5000))


def elastic_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepare.distortion(points(spark, sf_dir).select("scene", "point_idx", *"xyz"), 0.1, 0.02))


def dense_superpoint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints that a crop leaves, numbered from 0."""
    p = points(spark, sf_dir).filter("sem != 1")
    return p.select("scene", "point_idx", "sp").join(prepare.dense_ids(p, ["scene"], ["sp"]), ["scene", "sp"])


def compacted_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance ids with holes (orders by their number modulo 97 without every third), largest into the lowest hole."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("scene"), (F.col("l_orderkey") % 97).alias("ins")).filter("(ins * 7 + scene) % 3 != 0")
    return prepare.compacted(rows, ["scene"], "ins")


def decoded_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number back from the codes of the label files."""
    p = partly_labelled(spark, sf_dir)
    p = p.filter(F.col("ins") != labels.IGNORED)
    code = F.col("sem") * 1000 + F.col("ins") + 1
    kind, number = prepare.decoded(code)
    return p.select("scene", "point_idx", kind.alias("class"), number.alias("number"))


def class_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names (nations) mapped to classes (regions); a name that the map lacks is unannotated."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).filter("n_nationkey % 5 != 0").select(F.col("n_name").alias("raw_name"), F.col("r_name").alias("name"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return scans.mapped(rows, names, "n_name").select("c_custkey", "name")


def predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over the vector as scores, its largest value and the first class that has it."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", prepare.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return p.select("vec_id", prepare.first_largest(F.col("p")).alias("class"), F.round(F.array_max("p"), 6).alias("prob"))


def one_hot_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in tens, rounded halves to even, as a vector of six, summed per flag."""
    hot = prepare.one_hot(F.col("l_quantity") / 10, 0, 5)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", hot.alias("hot"))
    return rows.groupBy("l_returnflag").agg(*[F.sum(F.get("hot", F.lit(i))).alias(f"h{i}") for i in range(6)])


def unique_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three columns: the distinct ones in order, and how many rows have each."""
    keys = ["l_discount", "l_quantity", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = rows.withColumn("whole", F.lit(0))
    return prepare.dense_ids(one, ["whole"], keys).join(rows, keys).select(*keys, "index", "n")


def log_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logarithm of the voxels of each instance; instances without any have none."""
    found = labels.occupancy(voxel.with_cells(partly_labelled(spark, sf_dir), 0.05), "ins", voxel.CELL)
    return found.select("scene", "ins", F.round(F.ln("voxels"), 6).alias("log_voxels"))


def voxel_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with their mean place, mean colour without its fraction, and the histograms of labels and objects."""
    li = table(spark, sf_dir, "lineitem")
    colour = [(F.col("l_partkey") * k % 256).alias(c) for c, k in (("r", 1), ("g", 3), ("b", 7))]
    rows = li.select((F.col("l_suppkey") % 4).alias("scene"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), (F.col("l_partkey") % 5).alias("label"), (F.col("l_orderkey") % 7).alias("object"), *colour)
    found = voxel.pruned(rows, WIDE, ["r", "g", "b"], ["label", "object"])
    text = {h: F.array_join(F.transform(h, lambda e: F.concat_ws(":", e["value"], e["n"])), ",") for h in ("label", "object")}
    return rounded(found, ["mean_x", "mean_y", "mean_z"]).withColumns(text)


def perfect_voxel_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of most points of a voxel among those above 0, counted from 0; 0 as well without any."""
    found = voxel.label_histogram(cloud(spark, sf_dir), WIDE, "label")
    return found.groupBy("scene", *voxel.CELL).agg((voxel.majority(F.col("label"), F.col("n"))).alias("label")).withColumn("label", F.greatest(F.col("label") - 1, F.lit(0)))


def superpoint_soft_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of the largest share, the lowest of a tie; ignored points are the last bin."""
    p = points(spark, sf_dir).withColumn("noisy", F.when(F.col("point_idx") % 3 == 0, labels.IGNORED).otherwise(F.col("noisy")))
    return labels.soft_label(labels.soft_histogram(p, "sp", "noisy"), "sp")


def mask_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scene, how many points two masks have in either, in both, and in the first only."""
    p = points(spark, sf_dir)
    one, two = p.filter("sem = 0").select("scene", "point_idx"), p.filter("noisy < 3").select("scene", "point_idx")
    return labels.mask_operations(one, two)


def gt_instance_first_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes whose class is that of the instance's first point; an unlabelled first point counts as class 0."""
    p = partly_labelled(spark, sf_dir).withColumn("noisy", F.when(F.col("point_idx") % 7 == 1, labels.IGNORED).otherwise(F.col("noisy")))
    return labels.instance_codes(p, "ins", labels.first_label(p.filter(F.col("ins") != labels.IGNORED), "ins", "noisy")).select("scene", "point_idx", "code")


def weak_label_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy of propagated labels: all, floor and wall (classes 0 and 1), others, and instances without those."""
    given = F.col("point_idx") % 5 != 0
    p = points(spark, sf_dir).withColumn("truth", F.when(F.col("point_idx") % 11 == 0, labels.IGNORED).otherwise(F.col("sem")))
    found = labels.propagation_report(p, F.col("truth"), F.when(given, F.col("noisy") % 3).otherwise(labels.IGNORED), F.col("ins"), F.when(given, F.col("sp") % 4).otherwise(labels.IGNORED))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def dice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class, the soft dice loss of the vector as scores against the label."""
    e = table(spark, sf_dir, "embeddings").select("label", prepare.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return labels.dice(e, "p", "label").select(F.col("class").cast("long").alias("class"), F.round("loss", 6).alias("loss"))


def offset_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance (sum of the parts) and direction of the superpoints' offsets to instances (true) and to classes (predicted)."""
    p = points(spark, sf_dir)
    true = labels.centre_offsets(p, "sp", "ins")
    made = labels.centre_offsets(p, "sp", "sem").select("scene", "sp", *[F.col(f"o{a}").alias(f"p{a}") for a in "xyz"])
    found = labels.offset_terms(true.join(made, ["scene", "sp"]).withColumn("valid", F.col("sp") % 3 != 0))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


QUERIES = {
    f.__name__: f
    for f in (
        integer_voxels, affine_augmentation, random_box_crop, crop_block_rows, elastic_distortion, dense_superpoint_ids, compacted_instances, decoded_instances, class_remap, predicted_class,
        one_hot_degrees, unique_row_index, log_occupancy, voxel_prune, perfect_voxel_label, superpoint_soft_label, mask_set_operations, gt_instance_first_point, weak_label_breakdown,
        dice_loss, offset_losses,
    )
}

_U = "((CAST(CAST('0x' || substr(md5('crop' || k || '{0}:' || c.scene), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"
_SIDE = {a: f"({FULL} - {SHRINK if a in 'xy' else 0.0} * (k - 1))" for a in "xyz"}
_MOVED = {a: f"(CASE WHEN k = 0 THEN {a} - lo{a} ELSE {a} - lo{a} + least({_SIDE[a]} - (hi{a} - lo{a}) + 0.001, 0) * {_U.format(a)} END)" for a in "xyz"}
_IN = " AND ".join(f"{_MOVED[a]} >= 0 AND {_MOVED[a]} < {_SIDE[a]}" for a in "xyz")
_EXTENT = ", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in "xyz")
_SOFT = "SELECT vec_id, label, embedding, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding))) AS e FROM embeddings"
_OFFSETS = """{0}_means AS (SELECT scene, {0}, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY scene, {0}),
  {0}_own AS (SELECT scene, sp, {0} FROM (SELECT scene, sp, {0}, row_number() OVER (PARTITION BY scene, sp ORDER BY count(*) DESC, {0}) AS k FROM points GROUP BY scene, sp, {0}) WHERE k = 1),
  {0}_offset AS (SELECT s.scene, s.sp, m.x - s.x AS x, m.y - s.y AS y, m.z - s.z AS z FROM (SELECT scene, sp, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY scene, sp) s
    JOIN {0}_own o ON o.scene = s.scene AND o.sp = s.sp JOIN {0}_means m ON m.scene = s.scene AND m.{0} = o.{0})"""
_LEN = "sqrt({0}.x * {0}.x + {0}.y * {0}.y + {0}.z * {0}.z)"
_NOISE = "sqrt(-2 * ln((CAST(CAST('0x' || substr(md5('elastic{0}u:' || scene || ':' || gx || ':' || gy || ':' || gz), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))) * cos((CAST(CAST('0x' || substr(md5('elastic{0}v:' || scene || ':' || gx || ':' || gy || ':' || gz), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE) * CAST(6.283185307179586 AS DOUBLE))"
_PART = {a: f"({a} / CAST(0.1 AS DOUBLE) - floor({a} / CAST(0.1 AS DOUBLE)))" for a in "xyz"}
_HIST = "SELECT scene, vx, vy, vz, string_agg({0} || ':' || n, ',' ORDER BY {0}) AS {0} FROM (SELECT scene, vx, vy, vz, {0}, count(*) AS n FROM cells GROUP BY ALL) GROUP BY scene, vx, vy, vz"
ORACLES = {
    "integer_voxels": f"WITH {POINTS} SELECT scene, point_idx, {', '.join(f'CAST(trunc({a} * {SCALE} - min({a} * {SCALE}) OVER (PARTITION BY scene)) AS BIGINT) AS i{a}' for a in 'xyz')} FROM points",
    "affine_augmentation": f"""WITH {POINTS}, t AS (SELECT *, scene * CAST(0.7 AS DOUBLE) AS a, CASE WHEN scene % 2 = 0 THEN 1 ELSE -1 END AS f FROM points)
        SELECT scene, point_idx, round(x * f * cos(a) - y * sin(a), 6) AS x, round(x * f * sin(a) + y * cos(a), 6) AS y, round(z, 6) AS z FROM t""",
    "random_box_crop": f"""WITH {CLOUD}, e AS (SELECT scene, {_EXTENT} FROM cloud GROUP BY scene), c AS (SELECT cloud.*, e.* EXCLUDE scene FROM cloud JOIN e USING (scene)),
        n AS (SELECT scene, k, count(*) FILTER (k = 0 OR ({_IN})) AS n FROM c, range({STEPS}) t(k) GROUP BY scene, k), s AS (SELECT scene, min(k) AS k FROM n WHERE n <= {HELD} GROUP BY scene)
        SELECT c.scene, c.label, round({_MOVED["x"]}, 6) AS x, round({_MOVED["y"]}, 6) AS y, round({_MOVED["z"]}, 6) AS z, k AS step FROM c JOIN s ON s.scene = c.scene WHERE k = 0 OR ({_IN})""",
    "crop_block_rows": f"""WITH {CLOUD}, e AS (SELECT scene, (min(x) + max(x)) / 2 AS cx, (max(x) - min(x)) / 2 AS hx, (min(y) + max(y)) / 2 AS cy, (max(y) - min(y)) / 2 AS hy FROM cloud GROUP BY scene),
        c AS (SELECT cloud.*, ceil(greatest(abs(x - cx) / hx * 20, abs(y - cy) / hy * 20)) AS step FROM cloud JOIN e USING (scene)),
        s AS (SELECT scene, t.step, (SELECT count(*) FROM c WHERE c.scene = e.scene AND c.step <= t.step) AS n FROM e, range(20) t(step)), b AS (SELECT scene, max(step) AS best FROM s WHERE n <= 5000 GROUP BY scene)
        SELECT scene, label, {", ".join(f"round({a} - min({a}) OVER (PARTITION BY scene), 6) AS {a}" for a in "xyz")} FROM c JOIN b USING (scene) WHERE step <= best""",
    "elastic_distortion": f"""WITH {POINTS}, p AS (SELECT scene, point_idx, x, y, z, i, j, k, CAST(floor(x / CAST(0.1 AS DOUBLE)) AS BIGINT) + i AS cx, CAST(floor(y / CAST(0.1 AS DOUBLE)) AS BIGINT) + j AS cy, CAST(floor(z / CAST(0.1 AS DOUBLE)) AS BIGINT) + k AS cz,
          CASE i WHEN 1 THEN {_PART["x"]} ELSE 1 - {_PART["x"]} END * CASE j WHEN 1 THEN {_PART["y"]} ELSE 1 - {_PART["y"]} END * CASE k WHEN 1 THEN {_PART["z"]} ELSE 1 - {_PART["z"]} END AS w FROM points, range(2) a(i), range(2) b(j), range(2) c(k)),
        g AS (SELECT scene, cx, cy, cz, cx + i - 2 AS gx, cy + j - 2 AS gy, cz + k - 2 AS gz, (3 - abs(i - 2)) * (3 - abs(j - 2)) * (3 - abs(k - 2)) / CAST(729 AS DOUBLE) AS b FROM (SELECT DISTINCT scene, cx, cy, cz FROM p), range(5) a(i), range(5) b(j), range(5) c(k)),
        f AS (SELECT scene, cx, cy, cz, {", ".join(f"sum(b * {_NOISE.format(a)}) AS n{a}" for a in "xyz")} FROM g GROUP BY scene, cx, cy, cz)
        SELECT scene, point_idx, {", ".join(f"round(max({a}) + CAST(0.02 AS DOUBLE) * sum(w * n{a}), 6) AS {a}" for a in "xyz")} FROM p JOIN f USING (scene, cx, cy, cz) GROUP BY scene, point_idx""",
    "dense_superpoint_ids": f'WITH {POINTS} SELECT scene, point_idx, sp, dense_rank() OVER (PARTITION BY scene ORDER BY sp) - 1 AS "index" FROM points WHERE sem <> 1',
    "compacted_instances": """WITH r AS (SELECT DISTINCT l_suppkey % 4 AS scene, l_orderkey % 97 AS ins FROM lineitem WHERE ((l_orderkey % 97) * 7 + l_suppkey % 4) % 3 <> 0), m AS (SELECT scene, count(*) AS m FROM r GROUP BY scene),
        h AS (SELECT scene, k, row_number() OVER (PARTITION BY scene ORDER BY k) AS p FROM (SELECT scene, unnest(range(m)) AS k FROM m) WHERE (scene, k) NOT IN (SELECT (scene, ins) FROM r)),
        t AS (SELECT scene, ins, row_number() OVER (PARTITION BY scene ORDER BY ins DESC) AS p FROM r JOIN m USING (scene) WHERE ins >= m)
        SELECT r.scene, r.ins, coalesce(h.k, r.ins) AS compact FROM r LEFT JOIN t ON t.scene = r.scene AND t.ins = r.ins LEFT JOIN h ON h.scene = t.scene AND h.p = t.p""",
    "decoded_instances": f"WITH {POINTS}, {PARTLY} SELECT scene, point_idx, sem AS class, ins + 1 AS number FROM partly WHERE ins <> -100",
    "class_remap": "SELECT c_custkey, CASE WHEN n_nationkey % 5 <> 0 THEN r_name ELSE 'unannotated' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey",
    "predicted_class": f"WITH s AS ({_SOFT}) SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS class, round(list_max(e) / list_sum(e), 6) AS prob FROM s",
    "one_hot_degrees": f"SELECT l_returnflag, {', '.join(f'CAST(count(*) FILTER (round_even(l_quantity / 10, 0) = {i}) AS DOUBLE) AS h{i}' for i in range(6))} FROM lineitem GROUP BY l_returnflag",
    "unique_row_index": 'SELECT l_discount, l_quantity, l_tax, row_number() OVER (ORDER BY l_discount, l_quantity, l_tax) - 1 AS "index", count(*) AS n FROM lineitem GROUP BY l_discount, l_quantity, l_tax',
    "log_occupancy": f"WITH {POINTS}, {PARTLY}, {cells_sql('partly', 0.05)} SELECT scene, ins, round(ln(count(DISTINCT (vx, vy, vz))), 6) AS log_voxels FROM cells GROUP BY scene, ins",
    "voxel_prune": f"""WITH cloud AS (SELECT l_suppkey % 4 AS scene, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_partkey % 5 AS label, l_orderkey % 7 AS object, l_partkey % 256 AS r, l_partkey * 3 % 256 AS g, l_partkey * 7 % 256 AS b FROM lineitem),
        {cells_sql("cloud", WIDE)}, m AS (SELECT scene, vx, vy, vz, count(*) AS points, {", ".join(f"round(avg({a}), 6) AS mean_{a}" for a in "xyz")}, {", ".join(f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}" for c in "rgb")} FROM cells GROUP BY scene, vx, vy, vz),
        l AS ({_HIST.format("label")}), o AS ({_HIST.format("object")}) SELECT m.*, l.label, o.object FROM m JOIN l USING (scene, vx, vy, vz) JOIN o USING (scene, vx, vy, vz)""",
    "perfect_voxel_label": f"""WITH {CLOUD}, {cells_sql("cloud", WIDE)}, n AS (SELECT scene, vx, vy, vz, label, count(*) AS n FROM cells GROUP BY ALL)
        SELECT scene, vx, vy, vz, coalesce(arg_min(label, (-n, label)) FILTER (label > 0) - 1, 0) AS label FROM n GROUP BY scene, vx, vy, vz""",
    "superpoint_soft_label": f"""WITH {POINTS}, n AS (SELECT scene, sp, CASE WHEN point_idx % 3 = 0 THEN 1000 ELSE noisy END AS label, count(*) AS n FROM points GROUP BY ALL)
        SELECT scene, sp, CASE WHEN label = 1000 THEN -100 ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY scene, sp ORDER BY n DESC, label) AS k FROM n) WHERE k = 1""",
    "mask_set_operations": f"""WITH {POINTS} SELECT scene, count(*) FILTER (sem = 0 OR noisy < 3) AS "either", count(*) FILTER (sem = 0 AND noisy < 3) AS "both", count(*) FILTER (sem = 0 AND noisy >= 3) AS first_only FROM points GROUP BY scene""",
    "gt_instance_first_point": f"""WITH {POINTS}, {PARTLY}, f AS (SELECT scene, ins, CASE WHEN min(point_idx) % 7 = 1 THEN 0 ELSE arg_min(noisy, point_idx) END AS label FROM partly WHERE ins <> -100 GROUP BY scene, ins)
        SELECT scene, point_idx, coalesce(label * 1000 + ins + 1, 0) AS code FROM partly LEFT JOIN f USING (scene, ins)""",
    "weak_label_breakdown": f"""WITH {POINTS}, g AS (SELECT CASE WHEN point_idx % 11 = 0 THEN -100 ELSE sem END AS truth, CASE WHEN point_idx % 5 <> 0 THEN noisy % 3 ELSE -100 END AS given, ins, CASE WHEN point_idx % 5 <> 0 THEN sp % 4 ELSE -100 END AS ins_given FROM points),
        c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (truth <> -100) AS t, count(*) FILTER (given <> -100) AS s, count(*) FILTER (given <> -100 AND given = truth) AS sr, count(*) FILTER (given IN (0, 1)) AS f, count(*) FILTER (given IN (0, 1) AND given = truth) AS fr,
          count(*) FILTER (ins_given <> -100 AND given NOT IN (0, 1)) AS i, count(*) FILTER (ins_given <> -100 AND given NOT IN (0, 1) AND ins_given = ins) AS ir FROM g)
        SELECT {", ".join(f"round({e}, 6) AS {a}" for a, e in (("labelled_of_all", "s / n"), ("stuff_of_all", "f / n"), ("other_of_all", "(s - f) / n"), ("labelled_of_true", "s / CAST(t AS DOUBLE)"), ("stuff_of_true", "f / CAST(t AS DOUBLE)"), ("other_of_true", "(s - f) / CAST(t AS DOUBLE)"),
          ("accuracy", "sr / CAST(s AS DOUBLE)"), ("stuff_accuracy", "fr / CAST(f AS DOUBLE)"), ("other_accuracy", "(sr - fr) / CAST(s - f AS DOUBLE)"), ("instance_of_all", "i / n"), ("instance_of_true", "i / CAST(t AS DOUBLE)"), ("instance_accuracy", "ir / CAST(i AS DOUBLE)")))} FROM c""",
    "dice_loss": f"""WITH s AS ({_SOFT}), p AS (SELECT label, unnest(range(64)) AS class, unnest(list_transform(e, lambda x: x / list_sum(e))) AS p FROM s)
        SELECT class, round(1 - (2 * sum(CASE WHEN label = class THEN p ELSE 0 END) + CAST(0.00001 AS DOUBLE)) / (sum(p * p) + count(*) FILTER (label = class) + CAST(0.0001 AS DOUBLE) + CAST(0.00001 AS DOUBLE)), 6) AS loss FROM p GROUP BY class""",
    "offset_losses": f"""WITH {POINTS}, {_OFFSETS.format("ins")}, {_OFFSETS.format("sem")}, j AS (SELECT abs(p.x - t.x) + abs(p.y - t.y) + abs(p.z - t.z) AS far,
          -(p.x * t.x + p.y * t.y + p.z * t.z) / (({_LEN.format("t")} + CAST(0.00000001 AS DOUBLE)) * ({_LEN.format("p")} + CAST(0.00000001 AS DOUBLE))) AS turn FROM ins_offset t JOIN sem_offset p ON p.scene = t.scene AND p.sp = t.sp WHERE t.sp % 3 <> 0)
        SELECT round(sum(far) / (count(*) + CAST(0.000001 AS DOUBLE)), 6) AS norm_loss, round(sum(turn) / (count(*) + CAST(0.000001 AS DOUBLE)), 6) AS direction_loss FROM j""",
}
