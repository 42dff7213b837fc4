"""Queries over the library's operators, each with the same result in SQL.

Tables hold no volumes, so voxels are either a phantom generated for rows of a table (BODY queries) or plain columns of a table
to which an operator is applied by name. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intensity, names, statistics
from ..model import IDENTITY, INDEX, Grid, Grids
from ..operators import candidates, gates, geometry, morphology, neighbourhood, overlap, planes, regions, resample, surface
from ..sources import phantom, series
from . import cache

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Size in z, y, x of the phantoms here.
Z, Y, X = 14, 16, 18
GRID = Grid((X, Y, Z), (2.0, 2.0, 2.5), (-40.0, -60.0, 30.0))


def part_sql(z: str = "z", y: str = "y", x: str = "x") -> str:
    out = "0"
    for label, c, r, _, _ in phantom.PARTS:
        t = [f"((({v}) - {c[k]!r}e0 * {n}) / ({r[k]!r}e0 * {n}))" for k, (v, n) in enumerate(zip((z, y, x), (Z, Y, X), strict=True))]
        out = f"CASE WHEN {t[0]} * {t[0]} + {t[1]} * {t[1]} + {t[2]} * {t[2]} <= 1 THEN {label} ELSE {out} END"
    return out


def value_sql(part: str) -> str:
    whens = " ".join(f"WHEN {p[0]} THEN {p[3]!r}e0" for p in phantom.PARTS)
    return f"CASE {part} {whens} ELSE -1000e0 END"


TEXTURE = "((x * 7 + y * 13 + z * 29 + volume_id * 3) % 11) - 5"
CASES = "cases AS (SELECT CAST(n_nationkey AS BIGINT) AS volume_id, n_nationkey % 3 - 1 AS sx, n_nationkey % 2 AS sy FROM nation)"
VOXELS = f"""{CASES},
g AS (SELECT volume_id, sx, sy, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM cases, range({Z}) a(z), range({Y}) b(y), range({X}) c(x)),
p AS (SELECT *, {part_sql()} AS part, {part_sql("z", "y - sy", "x - sx")} AS part2 FROM g),
vox AS (SELECT *, CASE WHEN part = 100 THEN 0 ELSE part END AS label, CASE WHEN part2 = 100 THEN 0 ELSE part2 END AS label2,
        {value_sql("part")} + ({TEXTURE}) AS v, {value_sql("part2")} + ({TEXTURE.replace("volume_id * 3", "volume_id * 5")}) AS v2 FROM p)"""

#: The same with voxels computed once, for queries that join them with each other.
KEPT = VOXELS.replace("\ng AS (", "\ng AS MATERIALIZED (").replace("\nvox AS (", "\nvox AS MATERIALIZED (")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("volume_id"), F.lit(0).alias("sz"), (k % 2).alias("sy"), (k % 3 - 1).alias("sx"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, z, y, x with value and label of the fixed phantom (v, label) and of the moved one (v2, label2)."""
    c = cases(spark, sf_dir)
    texture = lambda k: (F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 29 + F.col("volume_id") * k) % 11 - 5
    rows = morphology.grid_voxels(c, ["volume_id"], GRID).join(F.broadcast(c), "volume_id")
    rows = rows.withColumn("part", phantom.part_column(GRID)).withColumn("part2", phantom.part_column(GRID, [F.col("sz"), F.col("sy"), F.col("sx")]))
    bare = lambda p: F.when(F.col(p) == phantom.BODY, 0).otherwise(F.col(p))
    return rows.select("volume_id", *INDEX, bare("part").alias("label"), bare("part2").alias("label2"), (phantom.value_column(F.col("part")) + texture(3)).alias("v"), (phantom.value_column(F.col("part2")) + texture(5)).alias("v2"))


def organ_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("organ")) for k, v in phantom.ORGANS.items()])
    return cases(spark, sf_dir).select("volume_id", F.inline(pairs))


ORGAN_SQL = "CASE {} WHEN 1 THEN 'liver' WHEN 2 THEN 'spleen' WHEN 3 THEN 'kidney_left' END"

# Statistics


@query("masked_describe", """SELECT l_returnflag, count(*) AS n, CAST(0 AS BIGINT) AS n_nonfinite, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max,
  round(quantile_cont(l_extendedprice, 0.01), 1) AS p1, round(quantile_cont(l_extendedprice, 0.99), 1) AS p99 FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag""")
def masked_describe(spark: SparkSession, d: str) -> DataFrame:
    return statistics.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", F.col("l_quantity") > 10)


@query("ncc_by_group", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS ncc FROM lineitem GROUP BY l_returnflag")
def ncc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(statistics.ncc("l_quantity", "l_extendedprice"), 6).alias("ncc"))


NMI_SQL = """
e{0} AS (SELECT {1}, min({2}) AS a0, max({2}) AS a1, min({3}) AS b0, max({3}) AS b1 FROM {4} GROUP BY {1}),
j{0} AS (SELECT t.{1}, least(63, floor((t.{2} - a0) / (a1 - a0) * 64)) AS i, least(63, floor((t.{3} - b0) / (b1 - b0) * 64)) AS j, count(*) AS c FROM {4} t JOIN e{0} ON e{0}.{1} = t.{1} GROUP BY ALL),
n{0} AS (SELECT {1}, sum(c) AS n FROM j{0} GROUP BY {1}),
h{0} AS (SELECT j{0}.{1}, -sum(c / n * ln(c / n)) AS h FROM j{0} JOIN n{0} ON n{0}.{1} = j{0}.{1} GROUP BY j{0}.{1}),
ha{0} AS (SELECT k.{1}, -sum(c / n * ln(c / n)) AS h FROM (SELECT {1}, i, sum(c) AS c FROM j{0} GROUP BY {1}, i) k JOIN n{0} ON n{0}.{1} = k.{1} GROUP BY k.{1}),
hb{0} AS (SELECT k.{1}, -sum(c / n * ln(c / n)) AS h FROM (SELECT {1}, j, sum(c) AS c FROM j{0} GROUP BY {1}, j) k JOIN n{0} ON n{0}.{1} = k.{1} GROUP BY k.{1}),
nmi{0} AS (SELECT h{0}.{1}, (ha{0}.h + hb{0}.h) / h{0}.h AS nmi FROM h{0} JOIN ha{0} ON ha{0}.{1} = h{0}.{1} JOIN hb{0} ON hb{0}.{1} = h{0}.{1})"""


@query("nmi_64", f"WITH {NMI_SQL.format('', 'l_returnflag', 'l_quantity', 'l_extendedprice', 'lineitem')} SELECT l_returnflag, round(nmi, 8) AS nmi FROM nmi")
def nmi_64(spark: SparkSession, d: str) -> DataFrame:
    return statistics.nmi(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", F.round("nmi", 8).alias("nmi"))


@query("similarity_report", f"""WITH {VOXELS}, w AS (SELECT *, v + ((x * 3 + z) % 5) AS v3 FROM vox), {NMI_SQL.format('1', 'volume_id', 'v', 'v2', 'w')}, {NMI_SQL.format('2', 'volume_id', 'v', 'v3', 'w')},
s AS (SELECT volume_id, count(*) AS n_voxels_evaluated, round(corr(v, v2), 4) AS ncc_before, round(corr(v, v3), 4) AS ncc_after FROM w GROUP BY volume_id)
SELECT s.volume_id, n_voxels_evaluated, ncc_before, ncc_after, round(ncc_after - ncc_before, 4) AS ncc_gain, round(nmi1.nmi, 4) AS nmi_before, round(nmi2.nmi, 4) AS nmi_after,
  round(round(nmi2.nmi, 4) - round(nmi1.nmi, 4), 4) AS nmi_gain FROM s JOIN nmi1 ON nmi1.volume_id = s.volume_id JOIN nmi2 ON nmi2.volume_id = s.volume_id""")
def similarity_report(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d).withColumn("v3", F.col("v") + (F.col("x") * 3 + F.col("z")) % 5)
    return statistics.similarity_report(rows, ["volume_id"], "v", "v2", "v3")


@query("tre_landmarks", """WITH e AS (SELECT p_size, sqrt(pow((p_partkey % 7) * 0.25e0, 2) + pow((p_partkey % 5) * 0.5e0, 2) + pow((p_partkey % 3) * 1e0, 2)) AS e,
  sqrt(pow((p_partkey % 7) * 1e0, 2) + pow((p_partkey % 5) * 1e0, 2) + pow(3e0, 2)) AS e0 FROM part)
SELECT p_size, count(*) AS n, round(avg(e), 2) AS mean, round(quantile_cont(e, 0.5), 2) AS median, round(quantile_cont(e, 0.95), 2) AS p95, round(max(e), 2) AS max, round(avg(e0), 2) AS mean_before FROM e GROUP BY p_size""")
def tre_landmarks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    zero = F.lit(0.0)
    rows = table(spark, d, "part").select("p_size", *[zero.alias(f"t{c}") for c in "xyz"], ((k % 7) * 0.25).alias("mx"), ((k % 5) * 0.5).alias("my"), ((k % 3) * 1.0).alias("mz"), ((k % 7) * 1.0).alias("sx"), ((k % 5) * 1.0).alias("sy"), F.lit(3.0).alias("sz"))
    three = lambda p: [f"{p}{c}" for c in "xyz"]
    return statistics.registration_error(rows, ["p_size"], three("m"), three("t"), three("s"))


# Intensities


@query("clip_percentile", """WITH b AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, round(greatest(lo, least(hi, o_totalprice)), 7) AS v FROM orders o JOIN b ON b.o_orderpriority = o.o_orderpriority""")
def clip_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    by = ["o_orderpriority"]
    bounds = intensity.clip_bounds(rows, by, percentiles=intensity.percentiles_for("MR"))
    return intensity.clipped(rows, bounds, by).select("o_orderkey", F.round("v", 7).alias("v"))


@query("hu_window_clip", "SELECT l_orderkey, l_linenumber, greatest(-160e0, least(240e0, l_extendedprice / 100 - 300)) AS v FROM lineitem")
def hu_window_clip(spark: SparkSession, d: str) -> DataFrame:
    low, high = intensity.HU_WINDOWS["ct_soft"]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", intensity.clip(F.col("l_extendedprice") / 100 - 300, low, high).alias("v"))


@query("minmax_norm", """WITH b AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 9) AS v FROM orders o JOIN b ON b.o_orderstatus = o.o_orderstatus""")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    return intensity.min_max(rows, ["o_orderstatus"]).select("o_orderkey", F.round("v", 9).alias("v"))


@query("zscore_norm", """WITH b AS (SELECT o_orderstatus, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY o_orderstatus)
SELECT o_orderkey, round((o_totalprice - m) / s, 7) AS v FROM orders o JOIN b ON b.o_orderstatus = o.o_orderstatus""")
def zscore_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    return intensity.z_score(rows, ["o_orderstatus"]).select("o_orderkey", F.round("v", 7).alias("v"))


@query("nonfinite_repair", """WITH f AS (SELECT event_id, event_type, event_id % 17 AS k, value FROM events),
b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM f WHERE k > 2 GROUP BY event_type)
SELECT event_id, CASE WHEN k = 1 THEN hi WHEN k IN (0, 2) THEN lo ELSE value END AS v FROM f JOIN b ON b.event_type = f.event_type""")
def nonfinite_repair(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 17
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return intensity.repaired(table(spark, d, "events").select("event_id", "event_type", v.alias("v")), ["event_type"]).select("event_id", "v")


@query("feature_normalise", """WITH f AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_linestatus, greatest(-450e0, least(450e0, l_extendedprice / 50 - 600)) AS v FROM lineitem),
b AS (SELECT l_linestatus, min(v) AS lo, max(v) AS hi FROM f GROUP BY l_linestatus)
SELECT l_orderkey, l_linenumber, round((v - lo) / (hi - lo), 9) AS v FROM f JOIN b ON b.l_linestatus = f.l_linestatus""")
def feature_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", (F.col("l_extendedprice") / 50 - 600).alias("v"))
    return intensity.feature_normalised(rows, ["l_linestatus"], modality="CT").select("l_orderkey", "l_linenumber", F.round("v", 9).alias("v"))


@query("voxel_l2_norm", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) + 1e-6))), 6) AS s FROM embeddings""")
def voxel_l2_norm(spark: SparkSession, d: str) -> DataFrame:
    ch = intensity.channel_normalised(F.col("embedding"), "l2")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(ch, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("gram_matrix", """WITH t AS (SELECT label, i, j, CAST(embedding[i + 1] AS DOUBLE) AS a, CAST(embedding[j + 1] AS DOUBLE) AS b FROM embeddings, range(64) u(i), range(64) w(j) WHERE j >= i)
SELECT label, CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) AS n, round(covar_pop(a, b), 7) AS cov FROM t GROUP BY label, i, j""")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").alias("ch"))
    return neighbourhood.gram(rows, ["label"]).select("label", "i", "j", "n", F.round("cov", 7).alias("cov"))


# Labels


@query("dice_by_label", f"""WITH {VOXELS}, t AS (SELECT volume_id, l, sum(CASE WHEN label = l THEN 1 ELSE 0 END) AS f, sum(CASE WHEN label2 = l THEN 1 ELSE 0 END) AS m, sum(CASE WHEN label = l AND label2 = l THEN 1 ELSE 0 END) AS b
  FROM vox, (VALUES (1), (2), (3)) k(l) GROUP BY volume_id, l)
SELECT volume_id, {ORGAN_SQL.format('l')} AS organ, CAST(f AS BIGINT) AS n_fixed, CAST(m AS BIGINT) AS n_moving, CAST(b AS BIGINT) AS n_both, round(2e0 * b / (f + m), 4) AS dice FROM t WHERE f + m > 0""")
def dice_by_label(spark: SparkSession, d: str) -> DataFrame:
    rows, n = volumes(spark, d), organ_names(spark, d)
    side = lambda c: overlap.named(rows.where(F.col(c) != 0).select("volume_id", *INDEX, F.col(c).alias("label")), n).drop("label")
    return overlap.overlap(side("label"), side("label2"), ["volume_id"])


@query("organ_volumes", f"WITH {VOXELS} SELECT volume_id, {ORGAN_SQL.format('label')} AS organ, count(*) AS n_voxels, round(count(*) * 0.01e0, 2) AS volume_ml FROM vox WHERE label <> 0 GROUP BY volume_id, label")
def organ_volumes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.organ_volumes(volumes(spark, d), organ_names(spark, d), GRID.voxel_ml)


@query("organ_centroids", f"WITH {VOXELS} SELECT volume_id, label, count(*) AS n_voxels, round(avg(x) * 2 - 40, 6) AS cx, round(avg(y) * 2 - 60, 6) AS cy, round(avg(z) * 2.5e0 + 30, 6) AS cz FROM vox WHERE label <> 0 GROUP BY volume_id, label")
def organ_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = overlap.organ_centroids(volumes(spark, d), GRID)
    return rows.select("volume_id", "label", "n_voxels", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])


@query("missing_targets", f"""WITH {VOXELS}, t AS (SELECT volume_id, organ FROM cases, (VALUES ('liver'), ('pancreas'), ('spleen')) k(organ))
SELECT volume_id, organ FROM t WHERE NOT EXISTS (SELECT 1 FROM vox v WHERE v.volume_id = t.volume_id AND {ORGAN_SQL.format('v.label')} = t.organ)""")
def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    wanted = cases(spark, d).select("volume_id", F.explode(F.array(*map(F.lit, ("liver", "pancreas", "spleen")))).alias("organ"))
    return overlap.missing_targets(wanted, overlap.present_organs(volumes(spark, d), organ_names(spark, d)))


NAME_SQL = """CASE p_partkey % 6 WHEN 0 THEN ' Left-Kidney.nii.gz' WHEN 1 THEN 'LIVER.nii' WHEN 2 THEN 'gall bladder' WHEN 3 THEN 'Lung Upper-Lobe Left.mha' WHEN 4 THEN 'Bladder' ELSE p_name || '.nrrd' END"""


@query("organ_name_canonical", f"""WITH n AS (SELECT p_partkey, {NAME_SQL} AS name FROM part),
a AS (SELECT p_partkey, lower(trim(name)) AS s FROM n),
b AS (SELECT p_partkey, replace(replace(regexp_replace(s, '(\\.nii\\.gz|\\.nii|\\.nrrd|\\.mha)$', ''), ' ', '_'), '-', '_') AS s FROM a)
SELECT p_partkey, CASE s WHEN 'left_kidney' THEN 'kidney_left' WHEN 'gall_bladder' THEN 'gallbladder' WHEN 'lung_upper_lobe_left' THEN 'lung_left' WHEN 'bladder' THEN 'urinary_bladder' ELSE s END AS organ FROM b""")
def organ_name_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{NAME_SQL} AS name").select("p_partkey", names.canonical(F.col("name")).alias("organ"))


TARGETS_SQL = "t AS (SELECT s_suppkey, unnest([1, 2, 3]) AS position FROM supplier), tt AS (SELECT s_suppkey, position, CASE (s_suppkey + position) % 5 WHEN 0 THEN 'abdomen_solid' WHEN 1 THEN 'liver' WHEN 2 THEN 'Spleen' WHEN 3 THEN 'vessels' ELSE 'unknown thing' END AS target FROM t)"
GROUPS_SQL = """x AS (SELECT s_suppkey, position, unnest(CASE target WHEN 'abdomen_solid' THEN ['liver', 'spleen', 'kidney_left', 'kidney_right'] WHEN 'vessels' THEN ['aorta', 'inferior_vena_cava', 'portal_vein_and_splenic_vein', 'celiac_trunk'] WHEN 'Spleen' THEN ['spleen'] WHEN 'unknown thing' THEN ['unknown_thing'] ELSE [target] END) AS organ,
  unnest(CASE target WHEN 'abdomen_solid' THEN [0, 1, 2, 3] WHEN 'vessels' THEN [0, 1, 2, 3] ELSE [0] END) AS q FROM tt), e AS (SELECT s_suppkey, organ, CAST(min(position * 100 + q) AS BIGINT) AS position FROM x GROUP BY s_suppkey, organ)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position"))
    k = (F.col("s_suppkey") + F.col("position")) % 5
    return rows.withColumn("target", F.when(k == 0, "abdomen_solid").when(k == 1, "liver").when(k == 2, "Spleen").when(k == 3, "vessels").otherwise("unknown thing"))


@query("target_expansion", f"WITH {TARGETS_SQL}, {GROUPS_SQL} SELECT s_suppkey, organ, position FROM e")
def target_expansion(spark: SparkSession, d: str) -> DataFrame:
    return names.expanded(targets(spark, d), ["s_suppkey"])


#: What is expected of these organs: region, deformable, grid, window, dilation, margin and motion, stated here for themselves.
EXPECTED_PROFILES = """('liver', 'abdomen', true, 20, 'ct_liver', 8, 25, 20), ('spleen', 'abdomen', true, 20, 'ct_abdomen', 8, 25, 15), ('kidney_left', 'abdomen', true, 20, 'ct_abdomen', 8, 25, 10),
('kidney_right', 'abdomen', true, 20, 'ct_abdomen', 8, 25, 10), ('aorta', 'abdomen', false, 20, 'ct_soft', 8, 25, 5), ('inferior_vena_cava', 'abdomen', false, 20, 'ct_soft', 8, 25, 10),
('portal_vein_and_splenic_vein', 'abdomen', true, 12, 'ct_liver', 8, 25, 10), ('celiac_trunk', 'abdomen', false, 20, 'ct_soft', 8, 25, 10)"""


@query("merged_profile", f"""WITH {TARGETS_SQL}, {GROUPS_SQL}, pr(organ, region, deformable, g, w, m, r, t) AS (VALUES {EXPECTED_PROFILES}),
f AS (SELECT s_suppkey, e.organ, position, coalesce(region, 'unknown') AS region, coalesce(deformable, true) AS deformable, coalesce(g, 20) AS g, w, coalesce(m, 8) AS m, coalesce(r, 25) AS r, coalesce(t, 10) AS t FROM e LEFT JOIN pr ON pr.organ = e.organ)
SELECT s_suppkey, string_agg(organ, '+' ORDER BY position) AS name, arg_min(region, position) AS region, bool_or(deformable) AS deformable, CAST(min(g) AS DOUBLE) AS bspline_grid_mm, arg_min(w, position) FILTER (w IS NOT NULL) AS hu_window,
  CAST(max(m) AS DOUBLE) AS mask_dilate_mm, CAST(max(r) AS DOUBLE) AS roi_margin_mm, CAST(max(t) AS DOUBLE) AS typical_motion_mm FROM f GROUP BY s_suppkey""")
def merged_profile(spark: SparkSession, d: str) -> DataFrame:
    return names.merged_profiles(names.expanded(targets(spark, d), ["s_suppkey"]), ["s_suppkey"])


@query("pseudonymise", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE substr(sha256('pepper::' || c_name), 1, 10) END AS subject FROM customer")
def pseudonymise(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", names.pseudonym(name, "pepper").alias("subject"))


@query("file_digest", "SELECT page_id, substr(sha256(html), 1, 32) AS digest FROM pages")
def file_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", names.file_digest(F.col("html").cast("binary")).alias("digest"))


@query("same_modality", """WITH m AS (SELECT n_nationkey, ['CT', 'cbct', 'MR', 'PT', 'nm', ''][1 + n_nationkey % 6] AS f, ['CT', 'MR', 'PT'][1 + n_nationkey % 3] AS m FROM nation),
k AS (SELECT *, CASE upper(f) WHEN 'CBCT' THEN 'CT' WHEN 'NM' THEN 'PT' ELSE upper(f) END AS ff FROM m) SELECT n_nationkey, ff <> '' AND ff = m AS same FROM k""")
def same_modality(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), 1 + F.col("n_nationkey") % n)
    return table(spark, d, "nation").select("n_nationkey", names.same_modality(pick(["CT", "cbct", "MR", "PT", "nm", ""], 6), pick(["CT", "MR", "PT"], 3)).alias("same"))


@query("log_final_metric", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE -(doc_id % 100) / 8e0 END AS metric FROM documents""")
def log_final_metric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    line = F.concat(F.lit("\nFinal metric value = 0.5\nFinal metric value  = "), (-(k % 100) / 8.0).cast("string"), F.lit("\n"))
    log = F.concat(F.coalesce("text", F.lit("")), F.when(k % 4 == 0, "").otherwise(line))
    return table(spark, d, "documents").select("doc_id", names.final_metric(log).alias("metric"))


# Geometry

MASK_SQL = f"{VOXELS}, mask AS (SELECT volume_id, z, y, x FROM vox WHERE label = 1)"


def liver(spark: SparkSession, d: str) -> DataFrame:
    return volumes(spark, d).where(F.col("label") == 1).select("volume_id", *INDEX)


@query("bbox_margin", f"""WITH {MASK_SQL} SELECT volume_id, greatest(0, min(z) - 2) AS z_low, least({Z - 1}, max(z) + 2) AS z_high, greatest(0, min(y) - 2) AS y_low, least({Y - 1}, max(y) + 2) AS y_high,
  greatest(0, min(x) - 2) AS x_low, least({X - 1}, max(x) + 2) AS x_high FROM mask GROUP BY volume_id""")
def bbox_margin(spark: SparkSession, d: str) -> DataFrame:
    return geometry.bounding_box(liver(spark, d), ["volume_id"], GRID, 4.0)


@query("crop_to_mask", f"""WITH {MASK_SQL}, b AS (SELECT volume_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM mask GROUP BY volume_id)
SELECT v.volume_id, count(*) AS n, CAST(max(z - z0) AS INT) AS mz, CAST(max(y - y0) AS INT) AS my, CAST(max(x - x0) AS INT) AS mx, sum(v) AS total FROM vox v JOIN b ON b.volume_id = v.volume_id
WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY v.volume_id""")
def crop_to_mask(spark: SparkSession, d: str) -> DataFrame:
    by = ["volume_id"]
    rows = geometry.cropped(volumes(spark, d).select("volume_id", *INDEX, "v"), geometry.bounding_box(liver(spark, d), by, GRID), by)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("z").alias("mz"), F.max("y").alias("my"), F.max("x").alias("mx"), F.sum("v").alias("total"))


@query("center_of_mass", f"""WITH {VOXELS}, m AS (SELECT volume_id, least(0, min(v)) AS lo FROM vox GROUP BY volume_id), w AS (SELECT v.volume_id, z, y, x, v - lo AS w FROM vox v JOIN m ON m.volume_id = v.volume_id)
SELECT volume_id, round(sum(w * x) / sum(w) * 2 - 40, 6) AS cx, round(sum(w * y) / sum(w) * 2 - 60, 6) AS cy, round(sum(w * z) / sum(w) * 2.5e0 + 30, 6) AS cz FROM w GROUP BY volume_id""")
def center_of_mass(spark: SparkSession, d: str) -> DataFrame:
    rows = geometry.centre_of_mass(volumes(spark, d), ["volume_id"], GRID)
    return rows.select("volume_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])


@query("mask_covariance", f"""WITH {MASK_SQL}, pos AS (SELECT volume_id, x * 2e0 - 40 AS px, y * 2e0 - 60 AS py, z * 2.5e0 + 30 AS pz FROM mask)
SELECT volume_id, count(*) AS n, round(covar_samp(px, px), 6) AS cxx, round(covar_samp(px, py), 6) AS cxy, round(covar_samp(px, pz), 6) AS cxz, round(covar_samp(py, py), 6) AS cyy, round(covar_samp(py, pz), 6) AS cyz, round(covar_samp(pz, pz), 6) AS czz FROM pos GROUP BY volume_id""")
def mask_covariance(spark: SparkSession, d: str) -> DataFrame:
    rows = geometry.covariance(liver(spark, d), ["volume_id"], GRID)
    return rows.select("volume_id", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")])


@query("fov_overlap", """WITH k AS (SELECT c_custkey, c_custkey % 40 + 20 AS n, c_custkey % 7 * 5 AS o FROM customer),
b AS (SELECT c_custkey, 99e0 AS fx, 99e0 AS fy, 59e0 AS fz, CAST(o AS DOUBLE) AS lx, CAST(o AS DOUBLE) AS ly, CAST(o AS DOUBLE) AS lz, o + (n - 1) * 2e0 AS hx, o + (n - 1) * 2e0 AS hy, o + (n - 1) * 3e0 AS hz FROM k),
c AS (SELECT c_custkey, greatest(0, least(fx, hx) - greatest(0, lx)) * greatest(0, least(fy, hy) - greatest(0, ly)) * greatest(0, least(fz, hz) - greatest(0, lz)) AS c, fx * fy * fz AS f, (hx - lx) * (hy - ly) * (hz - lz) AS m FROM b)
SELECT c_custkey, round(c / f, 3) AS fixed_fraction, round(c / m, 3) AS moving_fraction, least(round(c / f, 3), round(c / m, 3)) < 0.25 AS low_overlap FROM c""")
def fov_overlap(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n, o = k % 40 + 20, (k % 7 * 5).cast("double")
    fixed = geometry.box_of_grid([F.lit(100), F.lit(100), F.lit(60)], [F.lit(1.0)] * 3, [F.lit(0.0)] * 3)
    moving = geometry.box_of_grid([n, n, n], [F.lit(2.0), F.lit(2.0), F.lit(3.0)], [o, o, o])
    rows = table(spark, d, "customer").select("c_custkey", *[c.alias(f"f_{i}") for i, c in fixed.items()], *[c.alias(f"m_{i}") for i, c in moving.items()])
    return geometry.fov_overlap(rows).select("c_custkey", "fixed_fraction", "moving_fraction", "low_overlap")


# Morphology

SUMS = "count(*) AS n, CAST(sum(z * 10000 + y * 100 + x) AS BIGINT) AS mark"
BALL = [(0, 0, 0), *morphology.FACES]


def marked(mask: DataFrame) -> DataFrame:
    return mask.groupBy("volume_id").agg(F.count("*").alias("n"), F.sum(F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("mark"))


def ball_sql(radius: float) -> str:
    return ", ".join(f"({a}, {b}, {c})" for a, b, c in morphology.ball(radius, GRID))


DILATED = f"o(oz, oy, ox) AS (VALUES {ball_sql(4.0)}), dil AS (SELECT DISTINCT volume_id, z + oz AS z, y + oy AS y, x + ox AS x FROM mask, o WHERE z + oz BETWEEN 0 AND {Z - 1} AND y + oy BETWEEN 0 AND {Y - 1} AND x + ox BETWEEN 0 AND {X - 1})"


@query("dilate_mask", f"WITH {MASK_SQL}, {DILATED} SELECT volume_id, {SUMS} FROM dil GROUP BY volume_id")
def dilate_mask(spark: SparkSession, d: str) -> DataFrame:
    return marked(morphology.dilated(liver(spark, d), ["volume_id"], 4.0, GRID))


@query("erode_mask", f"""WITH {MASK_SQL}, o(oz, oy, ox) AS (VALUES {ball_sql(2.5)}), bad AS (SELECT DISTINCT m.volume_id, m.z, m.y, m.x FROM mask m, o
  WHERE m.z + oz BETWEEN 0 AND {Z - 1} AND m.y + oy BETWEEN 0 AND {Y - 1} AND m.x + ox BETWEEN 0 AND {X - 1} AND (m.volume_id, m.z + oz, m.y + oy, m.x + ox) NOT IN (SELECT volume_id, z, y, x FROM mask))
SELECT volume_id, {SUMS} FROM mask m WHERE (volume_id, z, y, x) NOT IN (SELECT volume_id, z, y, x FROM bad) GROUP BY volume_id""")
def erode_mask(spark: SparkSession, d: str) -> DataFrame:
    return marked(morphology.eroded(liver(spark, d), ["volume_id"], 2.5, GRID))


CONTOUR = "SELECT m.volume_id, m.z, m.y, m.x FROM {0} m LEFT JOIN {0} n ON n.volume_id = m.volume_id AND abs(n.z - m.z) + abs(n.y - m.y) + abs(n.x - m.x) = 1 GROUP BY m.volume_id, m.z, m.y, m.x HAVING count(n.volume_id) < 6"


@query("label_contour", f"WITH {MASK_SQL}, c AS ({CONTOUR.format('mask')}) SELECT volume_id, {SUMS} FROM c GROUP BY volume_id")
def label_contour(spark: SparkSession, d: str) -> DataFrame:
    return marked(morphology.contour(liver(spark, d), ["volume_id"], GRID))


PIECES = "(volume_id % 5 > 0 AND label IN (1, 2)) OR (volume_id % 5 = 0 AND ((z = 1 AND y = 1 AND x BETWEEN 1 AND 3) OR (z = 5 AND y = 5 AND x BETWEEN 4 AND 6)))"


@query("largest_component", f"""WITH RECURSIVE {VOXELS}, m AS (SELECT volume_id, z, y, x, CAST(z * 10000 + y * 100 + x AS BIGINT) AS id FROM vox WHERE {PIECES}),
e AS (SELECT a.volume_id, a.id AS a, b.id AS b FROM m a JOIN m b ON b.volume_id = a.volume_id AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1),
r AS (SELECT volume_id, id AS a, id AS b FROM m UNION SELECT r.volume_id, r.a, e.b FROM r JOIN e ON e.volume_id = r.volume_id AND e.a = r.b),
c AS (SELECT volume_id, a, min(b) AS piece FROM r GROUP BY volume_id, a), n AS (SELECT volume_id, piece, count(*) AS n, CAST(sum(a) AS BIGINT) AS mark FROM c GROUP BY volume_id, piece)
SELECT volume_id, n, mark FROM n QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, piece) = 1""")
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    """Of liver and spleen, which do not touch, and in every fifth volume of two pieces of equal size."""
    mask = volumes(spark, d).where(PIECES).select("volume_id", *INDEX)
    return marked(morphology.largest_component(mask, ["volume_id"]))


@query("fill_holes", f"WITH {VOXELS} SELECT volume_id, {SUMS} FROM p WHERE part > 0 GROUP BY volume_id")
def fill_holes(spark: SparkSession, d: str) -> DataFrame:
    """The body without its organs has them as holes."""
    rows = morphology.grid_voxels(cases(spark, d), ["volume_id"], GRID).where(phantom.part_column(GRID) == phantom.BODY)
    return marked(morphology.filled(rows, ["volume_id"], GRID))


@query("otsu_threshold", """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
h AS (SELECT t.event_type, lo, hi, least(127, floor((value - lo) / (hi - lo) * 128)) AS bin, count(*) AS n FROM events t JOIN e ON e.event_type = t.event_type GROUP BY ALL),
c AS (SELECT event_type, bin, lo + (bin + 0.5e0) * (hi - lo) / 128 AS c, n FROM h),
s AS (SELECT event_type, bin, c, sum(n) OVER w AS n0, sum(n * c) OVER w AS s0, sum(n) OVER (PARTITION BY event_type) AS n, sum(n * c) OVER (PARTITION BY event_type) AS s FROM c WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
b AS (SELECT *, round(n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) / (n * n), 9) AS b FROM s WHERE n > n0)
SELECT event_type, round(arg_min(c, {'a': -b, 'b': bin}), 6) AS threshold FROM b GROUP BY event_type""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return morphology.otsu(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("threshold", 6).alias("threshold"))


@query("hd95_msd", f"""WITH {VOXELS}, a AS (SELECT volume_id, z, y, x FROM vox WHERE label = 1), b AS (SELECT volume_id, z, y, x FROM vox WHERE label2 = 1), ca AS ({CONTOUR.format('a')}), cb AS ({CONTOUR.format('b')}),
d AS (SELECT ca.volume_id, 0 AS s, ca.z, ca.y, ca.x, min(sqrt(pow((ca.x - cb.x) * 2, 2) + pow((ca.y - cb.y) * 2, 2) + pow((ca.z - cb.z) * 2.5e0, 2))) AS d FROM ca JOIN cb ON ca.volume_id = cb.volume_id GROUP BY ALL
  UNION ALL SELECT cb.volume_id, 1, cb.z, cb.y, cb.x, min(sqrt(pow((ca.x - cb.x) * 2, 2) + pow((ca.y - cb.y) * 2, 2) + pow((ca.z - cb.z) * 2.5e0, 2))) FROM ca JOIN cb ON ca.volume_id = cb.volume_id GROUP BY ALL),
q AS (SELECT volume_id, s, quantile_cont(d, 0.95) AS p, avg(d) AS m FROM d GROUP BY volume_id, s)
SELECT volume_id, round(max(p), 2) AS hd95, round(sum(m) / 2, 2) AS msd FROM q GROUP BY volume_id""")
def hd95_msd(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d)
    side = lambda c: rows.where(F.col(c) == 1).select("volume_id", *INDEX)
    return surface.surface_distances(side("label"), side("label2"), ["volume_id"], GRID)


# Resampling and neighbourhoods


def matrices(spark: SparkSession, d: str, step: float) -> DataFrame:
    """A translation for each case: sx and sy grid steps of some mm."""
    m = [1.0, 0.0, 0.0, None, 0.0, 1.0, 0.0, None, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    cell = {3: F.col("sx") * step, 7: F.col("sy") * step}
    return cases(spark, d).select("volume_id", F.array(*[cell.get(i, F.lit(v)).cast("double") for i, v in enumerate(m)]).alias("matrix"))


#: A voxel as one whole number; an index outside of the grid is that of no voxel.
KEY = "((volume_id * 100 + z) * 100 + {0}) * 100 + {1}"


@query("resample_nearest", f"""WITH {VOXELS}, a AS (SELECT volume_id, z, y, x, {KEY.format("y + sy", "x + sx")} AS k FROM g), b AS (SELECT {KEY.format("y", "x")} AS k, v FROM vox)
SELECT volume_id, z, y, x, coalesce(v, -1000) AS v FROM a LEFT JOIN b ON a.k = b.k""")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return resample.resampled(volumes(spark, d), matrices(spark, d, 2.0), ["volume_id"], GRID, GRID, "matrix", "nearest", -1000.0)


def _linear_sql() -> str:
    corners = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j" for i in (0, 1) for j in (0, 1))
    return f"""WITH {VOXELS}, k AS ({corners}), t AS (SELECT volume_id, z, y, x, y + sy * 0.5e0 AS qy, x + sx * 0.5e0 AS qx FROM g),
c AS (SELECT t.volume_id, z, y, x, CAST(floor(qy) + j AS INT) AS ky, CAST(floor(qx) + i AS INT) AS kx, (CASE WHEN j = 1 THEN qy - floor(qy) ELSE 1 - (qy - floor(qy)) END) * (CASE WHEN i = 1 THEN qx - floor(qx) ELSE 1 - (qx - floor(qx)) END) AS w
  FROM t CROSS JOIN k WHERE qy BETWEEN 0 AND {Y - 1} AND qx BETWEEN 0 AND {X - 1}),
d AS (SELECT {KEY.format("y", "x")} AS spot, {KEY.format("ky", "kx")} AS k, w FROM c WHERE w > 0), b AS (SELECT {KEY.format("y", "x")} AS k, v FROM vox),
r AS (SELECT spot, sum(w * v) AS v FROM d JOIN b ON b.k = d.k GROUP BY spot), a AS (SELECT volume_id, z, y, x, {KEY.format("y", "x")} AS spot FROM g)
SELECT volume_id, z, y, x, round(coalesce(r.v, 0), 6) AS v FROM a LEFT JOIN r ON r.spot = a.spot"""


@query("resample_linear", _linear_sql())
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    rows = resample.resampled(volumes(spark, d), matrices(spark, d, 1.0), ["volume_id"], GRID, GRID, "matrix")
    return rows.withColumn("v", F.round("v", 6))


@query("warp_labels", f"""WITH {VOXELS} SELECT a.volume_id, b.label, count(*) AS n FROM vox a JOIN vox b ON b.volume_id = a.volume_id AND b.z = a.z AND b.y = a.y + a.sy AND b.x = a.x + a.sx WHERE b.label <> 0 GROUP BY a.volume_id, b.label""")
def warp_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d).where(F.col("label") != 0).select("volume_id", *INDEX, "label")
    return resample.warped_labels(rows, matrices(spark, d, 2.0), ["volume_id"], GRID, GRID, "matrix").groupBy("volume_id", "label").agg(F.count("*").alias("n"))


@query("box_mean_edge", f"""WITH {VOXELS}, o AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(c AS INT) AS c FROM range(-2, 3) r(a), range(-2, 3) s(b), range(-2, 3) t(c))  ,
k AS (SELECT volume_id, z, y, x, least({Z - 1}, greatest(0, z + a)) AS kz, least({Y - 1}, greatest(0, y + b)) AS ky, least({X - 1}, greatest(0, x + c)) AS kx FROM vox, o)
SELECT k.volume_id, k.z, k.y, k.x, round(avg(v.v), 5) AS v FROM k JOIN vox v ON v.volume_id = k.volume_id AND v.z = kz AND v.y = ky AND v.x = kx GROUP BY k.volume_id, k.z, k.y, k.x""")
def box_mean_edge(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d).select("volume_id", *INDEX, "v")
    return neighbourhood.box_mean(rows, ["volume_id"], ["v"], 2, GRID).withColumn("v", F.round("v", 5))


@query("jacobian_stats", f"""WITH {CASES}, g AS (SELECT volume_id, z, y, x, sx FROM cases, range({Z}) a(z), range({Y}) b(y), range({X}) c(x)),
d AS (SELECT volume_id, 1 + (sx * 0.05e0 * (least({X - 1}, x + 1) * least({X - 1}, x + 1) - greatest(0, x - 1) * greatest(0, x - 1))) / 4 AS det FROM g)
SELECT volume_id, count(*) AS n, round(min(det), 4) AS det_min, round(max(det), 4) AS det_max, round(avg(det), 4) AS det_mean, round(stddev_pop(det), 4) AS det_std, round(quantile_cont(det, 0.01), 4) AS det_p1, round(quantile_cont(det, 0.99), 4) AS det_p99,
  count(*) FILTER (det <= 0) AS n_folded, round(count(*) FILTER (det <= 0) / count(*), 6) AS folding_fraction FROM d GROUP BY volume_id""")
def jacobian_stats(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    field = morphology.grid_voxels(c, ["volume_id"], GRID).join(F.broadcast(c), "volume_id").select("volume_id", *INDEX, (F.col("sx") * 0.05 * F.col("x") * F.col("x")).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    det = neighbourhood.jacobian(field, ["volume_id"], GRID)
    return statistics.jacobian_statistics(det.withColumn("det", F.round("det", 12)), ["volume_id"])


@query("displacement_stats", f"""WITH {CASES}, g AS (SELECT volume_id, sqrt(pow(sx * 1.5e0, 2) + pow(sy * 1.5e0, 2)) AS u FROM cases, range({Z}) a(z), range({Y}) b(y), range({X}) c(x))
SELECT volume_id, round(avg(u), 3) AS mean_mm, round(quantile_cont(u, 0.95), 3) AS p95_mm, round(max(u), 3) AS max_mm FROM g GROUP BY volume_id""")
def displacement_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.displacement_statistics(resample.displacement_field(matrices(spark, d, 1.5), ["volume_id"], GRID, "matrix"), ["volume_id"])


# Candidates, gates, series


@query("init_candidate_ranking", """WITH c AS (SELECT s_nationkey AS case_id, s_suppkey AS ordinal, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE round(s_acctbal / 10000, 2) END AS score FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, ordinal) AS rank FROM c),
l AS (SELECT *, round(score - lead(score) OVER (PARTITION BY case_id ORDER BY rank), 4) AS lead, CASE WHEN count(score) OVER (PARTITION BY case_id) = count(*) OVER (PARTITION BY case_id) THEN round(max(score) OVER (PARTITION BY case_id) - min(score) OVER (PARTITION BY case_id), 4) END AS score_spread FROM r)
SELECT case_id, ordinal, score, CAST(rank AS INT) AS rank, lead, rank = 1 AND coalesce(lead < 0.01, false) AS ambiguous, score_spread FROM l""")
def init_candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("s_suppkey") % 9 != 0, statistics.rounded(F.col("s_acctbal") / 10000, 2))
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("ordinal"), score.alias("score"))
    return candidates.ranked(rows)


RUNS_SQL = """r AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 10000 END AS ncc_gain, c_acctbal / 1000 AS final_metric, (c_custkey % 100) / 100e0 AS liver, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 20) / 10000e0 END AS folding,
  c_custkey % 2 = 0 AS deformable, (c_custkey % 9) / 10e0 AS det_min, CAST(c_custkey % 200 AS DOUBLE) AS trans, (c_custkey % 5) / 10e0 AS scale, (c_custkey % 13) - 1e0 AS det FROM customer)"""
CHECKS_SQL = f"""{RUNS_SQL}, k AS (
  SELECT run_id, 'ncc_gain' AS name, CASE WHEN ncc_gain IS NULL THEN 'WARN' WHEN ncc_gain < 0.01 THEN 'FAIL' ELSE 'PASS' END AS status, ncc_gain AS measured, CAST(0.01 AS DOUBLE) AS threshold FROM r
  UNION ALL SELECT run_id, 'final_metric', CASE WHEN abs(final_metric) < 1e-6 THEN 'FAIL' ELSE 'PASS' END, final_metric, 1e-6 FROM r
  UNION ALL SELECT run_id, 'dice[liver]', CASE WHEN liver < 0.85 THEN 'FAIL' ELSE 'PASS' END, liver, 0.85 FROM r
  UNION ALL SELECT run_id, 'folding_fraction', CASE WHEN folding IS NULL THEN 'WARN' WHEN folding > 1e-3 THEN 'FAIL' ELSE 'PASS' END, folding, 1e-3 FROM r WHERE folding IS NOT NULL OR deformable
  UNION ALL SELECT run_id, 'jacobian_range', 'WARN', det_min, NULL FROM r WHERE det_min < 0.2
  UNION ALL SELECT run_id, 'translation_mm', CASE WHEN trans > 150 THEN 'FAIL' ELSE 'PASS' END, trans, 150 FROM r
  UNION ALL SELECT run_id, 'scale_deviation', CASE WHEN scale > 0.35 THEN 'FAIL' ELSE 'PASS' END, scale, 0.35 FROM r
  UNION ALL SELECT run_id, 'determinant', 'FAIL', det, NULL FROM r WHERE det <= 0)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.lit(None).cast("double")
    return table(spark, d, "customer").select(k.alias("run_id"), F.when(k % 11 != 0, F.col("c_acctbal") / 10000).alias("ncc_gain"), none.alias("nmi_gain"), (F.col("c_acctbal") / 1000).alias("final_metric"), F.create_map(F.lit("liver"), (k % 100) / 100.0).alias("dice"), F.when(k % 6 != 0, (k % 20) / 10000.0).alias("folding_fraction"), (k % 2 == 0).alias("deformable"), ((k % 9) / 10.0).alias("det_min"), F.lit(1.0).alias("det_max"), (k % 200).cast("double").alias("translation_mm"), ((k % 5) / 10.0).alias("scale_deviation"), ((k % 13) - 1.0).alias("determinant"), none.alias("tre_mm"))


GATES = gates.Gates(min_ncc_gain=0.01, min_dice={"liver": 0.85})


@query("gate_checks", f"WITH {CHECKS_SQL} SELECT run_id, name, status, measured, threshold FROM k")
def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    return gates.checks(runs(spark, d), GATES)


VERDICT_SQL = "v AS (SELECT run_id, max(CASE status WHEN 'PASS' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END) AS l, count(*) AS n_checks, count(*) FILTER (status = 'FAIL') AS n_failures, count(*) FILTER (status = 'WARN') AS n_warnings FROM k GROUP BY run_id)"


@query("gate_verdicts", f"WITH {CHECKS_SQL}, {VERDICT_SQL} SELECT run_id, ['PASS', 'WARN', 'FAIL'][l] AS status, n_checks, n_failures, n_warnings FROM v")
def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return gates.verdicts(gates.checks(runs(spark, d), GATES))


@query("batch_summary", f"WITH {CHECKS_SQL}, {VERDICT_SQL} SELECT ['PASS', 'WARN', 'FAIL'][l] AS status, count(*) AS n_runs, CAST(sum(n_failures) AS BIGINT) AS n_failures FROM v GROUP BY l")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return gates.summary(gates.verdicts(gates.checks(runs(spark, d), GATES)))


@query("slice_regularity", """WITH g AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY value)) AS g FROM events),
a AS (SELECT user_id, count(*) AS n_slices, median(g) AS m, stddev_pop(g) AS s, min(g) AS lo, max(g) AS hi FROM g GROUP BY user_id)
SELECT user_id, n_slices, CASE WHEN n_slices >= 3 THEN round(m, 4) END AS median_gap, CASE WHEN n_slices >= 3 THEN round(s, 4) END AS std_gap, CASE WHEN n_slices >= 3 THEN round(lo, 4) END AS min_gap, CASE WHEN n_slices >= 3 THEN round(hi, 4) END AS max_gap,
  CASE WHEN n_slices >= 3 THEN s > greatest(m * 0.01, 0.01) END AS irregular FROM a""")
def slice_regularity(spark: SparkSession, d: str) -> DataFrame:
    return series.slice_regularity(table(spark, d, "events"), ["user_id"], "value")


@query("series_inventory", """WITH h AS (SELECT user_id AS series_uid, 'f' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS path, event_type AS modality FROM events),
a AS (SELECT series_uid, count(*) AS n_files, min(path) AS first_file, arg_min(modality, path) AS modality FROM h GROUP BY series_uid)
SELECT *, CAST(row_number() OVER (ORDER BY n_files DESC, series_uid) AS INT) AS rank FROM a""")
def series_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("series_uid"), F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("path"), F.col("event_type").alias("modality"))
    return series.inventory(rows)


@query("dicom_quantise", """WITH b AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus),
s AS (SELECT o_orderkey, o_totalprice AS v, lo, (hi - lo) / 32000 AS slope FROM orders o JOIN b ON b.o_orderstatus = o.o_orderstatus)
SELECT o_orderkey, CAST(least(32000, greatest(0, round_even((v - lo) / slope, 0))) AS INT) AS stored, round(slope, 9) AS slope, lo AS intercept FROM s""")
def dicom_quantise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    return series.stored(rows, ["o_orderstatus"]).select("o_orderkey", "stored", F.round("slope", 9).alias("slope"), "intercept")


# More of labels, starts and neighbourhoods


@query("present_organs", f"WITH {VOXELS} SELECT DISTINCT volume_id, {ORGAN_SQL.format('label')} AS organ FROM vox WHERE label <> 0")
def present_organs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.present_organs(volumes(spark, d), organ_names(spark, d))


@query("first_come_labels", f"""WITH {VOXELS}, m AS (SELECT volume_id, z, y, x, label AS l FROM vox WHERE label > 0 UNION ALL SELECT volume_id, z, y, x, label2 + 10 FROM vox WHERE label2 > 0)
SELECT volume_id, label, count(*) AS n FROM (SELECT volume_id, z, y, x, min(l) AS label FROM m GROUP BY volume_id, z, y, x) GROUP BY volume_id, label""")
def first_come_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d)
    one = rows.where(F.col("label") > 0).select("volume_id", *INDEX, "label")
    two = rows.where(F.col("label2") > 0).select("volume_id", *INDEX, (F.col("label2") + 10).alias("label"))
    return overlap.first_come(one.unionByName(two)).groupBy("volume_id", "label").agg(F.count("*").alias("n"))


@query("organ_mask_union", f"WITH {VOXELS} SELECT volume_id, {SUMS} FROM vox WHERE label IN (1, 3) GROUP BY volume_id")
def organ_mask_union(spark: SparkSession, d: str) -> DataFrame:
    return marked(overlap.organ_mask(volumes(spark, d).select("volume_id", *INDEX, "label"), organ_names(spark, d), ["liver", "kidney_left"]))


@query("organ_centroid_start", f"""WITH {VOXELS}, f AS (SELECT volume_id, label AS l, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vox WHERE label > 0 GROUP BY volume_id, label), m AS (SELECT volume_id, label2 AS l, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vox WHERE label2 > 0 GROUP BY volume_id, label2)
SELECT f.volume_id AS case_id, count(*) AS n_organs, round(avg(m.x - f.x) * 2, 6) + 0 AS dx, round(avg(m.y - f.y) * 2, 6) + 0 AS dy, round(avg(m.z - f.z) * 2.5e0, 6) + 0 AS dz FROM f JOIN m ON f.volume_id = m.volume_id AND f.l = m.l GROUP BY f.volume_id""")
def organ_centroid_start(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d)

    def side(c: str) -> DataFrame:
        labels = rows.where(F.col(c) != 0).select("volume_id", *INDEX, F.col(c).alias("label"))
        return overlap.organ_centroids(labels, GRID).select(F.col("volume_id").alias("case_id"), F.col("label").alias("organ"), "cx", "cy", "cz")

    out = candidates.organ_centroid_start(side("label"), side("label2"))
    return out.select("case_id", "n_organs", *[(F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


@query("closing", f"""WITH {VOXELS}, mask AS (SELECT volume_id, z, y, x FROM vox WHERE label = 1 AND (x + y + z) % 3 > 0), {DILATED.replace(ball_sql(4.0), ball_sql(2.0))}, o2(oz, oy, ox) AS (VALUES {ball_sql(2.0)}),
bad AS (SELECT DISTINCT m.volume_id, m.z, m.y, m.x FROM dil m, o2 WHERE m.z + oz BETWEEN 0 AND {Z - 1} AND m.y + oy BETWEEN 0 AND {Y - 1} AND m.x + ox BETWEEN 0 AND {X - 1} AND (m.volume_id, m.z + oz, m.y + oy, m.x + ox) NOT IN (SELECT volume_id, z, y, x FROM dil))
SELECT volume_id, {SUMS} FROM dil WHERE (volume_id, z, y, x) NOT IN (SELECT volume_id, z, y, x FROM bad) GROUP BY volume_id""")
def closing(spark: SparkSession, d: str) -> DataFrame:
    rows = liver(spark, d).where((F.col("x") + F.col("y") + F.col("z")) % 3 > 0)
    return marked(morphology.closed(rows, ["volume_id"], 2.0, GRID))


@query("shift_edge", f"""WITH {VOXELS}, a AS (SELECT volume_id, z, y, x, {KEY.format("y", "greatest(0, x - 3)")} AS k FROM g), b AS (SELECT {KEY.format("y", "x")} AS k, v FROM vox)
SELECT volume_id, z, y, x, v FROM a JOIN b ON a.k = b.k""")
def shift_edge(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d)
    return rows.select("volume_id", *INDEX, neighbourhood.shift(F.col("v"), ["volume_id"], "x", 3).alias("v"))


@query("checkerboard", f"WITH {VOXELS} SELECT volume_id, CAST((z // 4 + y // 4 + x // 4) % 2 AS BIGINT) AS tile, round(avg(v), 6) AS v FROM vox GROUP BY volume_id, tile")
def checkerboard(spark: SparkSession, d: str) -> DataFrame:
    return volumes(spark, d).groupBy("volume_id", geometry.checkerboard(4).alias("tile")).agg(F.round(F.avg("v"), 6).alias("v"))


@query("world_field", f"""WITH {CASES} SELECT volume_id, round(sx * 0.1e0 * {(X - 1) / 2 * 2.0}e0, 9) + 0 AS dx, round(sy * 0.2e0 * {(Y - 1) / 2 * 2.0}e0, 9) + 0 AS dy, round(0.3e0 * {(Z - 1) / 2 * 2.5}e0, 9) AS dz FROM cases""")
def world_field(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d).select("volume_id", (F.col("sx") * 0.1).alias("dx"), (F.col("sy") * 0.2).alias("dy"), F.lit(0.3).alias("dz"))
    return resample.world_field(rows, GRID).select("volume_id", *[(F.round(c, 9) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


@query("series_warnings", """WITH w AS (SELECT n_nationkey, n_nationkey % 2 = 0 AS irregular, n_nationkey % 6 AS m, n_nationkey % 5 AS t FROM nation)
SELECT n_nationkey, array_to_string(list_filter([CASE WHEN irregular THEN 'irregular slice spacing' END, CASE WHEN m < 4 THEN 'fewer than 4 voxels along an axis' END, CASE WHEN m IN (2, 3) THEN 'PET values are not SUV' END, CASE WHEN m = 5 THEN 'unsupported modality' END,
  CASE WHEN t > 0 THEN 'tilted gantry' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM w""")
def series_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    modality = F.element_at(F.array(*map(F.lit, ("CT", "MR", "PT", "PT", "US", "XX"))), 1 + k % 6)
    rows = table(spark, d, "nation").select("n_nationkey", (k % 2 == 0).alias("irregular"), F.array(F.lit(9), F.lit(9), k % 6).alias("size"), modality.alias("modality"), F.lit("BQML").alias("units"), (k % 5).cast("double").alias("tilt_deg"))
    return rows.select("n_nationkey", F.array_join(series.warnings(rows), "; ").alias("warnings"))


@query("log_hints", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fields of view hardly overlap: improve the starting point or lower the required ratio of valid samples' WHEN 1 THEN 'lower the resolution or crop to the region of interest' WHEN 2 THEN 'an input path does not exist' END AS hint FROM documents""")
def log_hints(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("ERROR: Too many samples map outside moving image", "Not enough memory", "No such file or directory", "all well"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", names.hint(said).alias("hint"))


@query("log_diagnosis", """WITH k AS (SELECT doc_id, doc_id % 16 AS m, doc_id % 3 AS i FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN m % 4 = 1 THEN 'fields of view hardly overlap: improve the start, widen the mask or ask for fewer valid samples' WHEN m % 4 = 2 THEN 'no samples within the mask: ask for fewer or widen it' END,
  CASE WHEN m >= 8 THEN i || ' images for 2 metrics: one image or one for each metric is needed' END, CASE WHEN m % 8 >= 4 THEN 'the metric became invalid: check for values that are not finite, masks and overlap' END], lambda x: x IS NOT NULL), '; ') AS hints,
  CASE WHEN m > 0 THEN 'case ' || m END AS description FROM k""")
def log_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Every text followed by what a log may say: one of two sentences on samples, one on images, one on the metric."""
    k = F.col("doc_id") % 16
    say = lambda when, what: F.when(when, F.lit(f"\n{what}\n")).otherwise("")
    plain = F.regexp_replace(F.coalesce(F.lower("text"), F.lit("")), "singular|description:|samples|metric|input primary|should equal|advancedtransformadapter", "")
    log = F.concat(plain, say(k % 4 == 1, "Too many samples MAP outside moving image buffer: 9 / 10"), say(k % 4 == 2, "not enough Samples"), say(k >= 8, "Input Primary is required"), say(k % 8 >= 4, "the matrix is Singular"), F.when(k > 0, F.concat(F.lit("\nDescription: first\nDescription:  case "), k.cast("string"), F.lit(" \n"))).otherwise(""))
    # A column of its own, so that the log is made once and not for each use.
    rows = table(spark, d, "documents").select("doc_id", log.alias("log"))
    return rows.select("doc_id", F.array_join(names.diagnosis(F.col("log"), F.col("doc_id") % 3, 2), "; ").alias("hints"), names.last_description(F.col("log")).alias("description"))


# Regions, reports and settings of a run

NAMED = f"(SELECT volume_id, z, y, x, {ORGAN_SQL.format('{0}')} AS organ FROM vox WHERE {{0}} <> 0)"
#: Volumes without labels, and without the target, so that each way of choosing a mask occurs.
SOME_SQL = f"org AS (SELECT * FROM {NAMED.format('label')} WHERE volume_id % 4 <> 3 AND NOT (volume_id % 4 = 2 AND organ = 'spleen')), org2 AS (SELECT * FROM {NAMED.format('label2')} WHERE volume_id % 5 <> 4)"


def organs(spark: SparkSession, d: str, label: str) -> DataFrame:
    rows = volumes(spark, d).where(F.col(label) != 0).select("volume_id", *INDEX, F.col(label).alias("label"))
    return overlap.named(rows, organ_names(spark, d)).drop("label")


def some_organs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("volume_id") % 4
    return organs(spark, d, "label").where((k != 3) & ~((k == 2) & (F.col("organ") == "spleen")))


@query("combined_mask", f"""WITH {VOXELS}, {SOME_SQL}, has AS (SELECT DISTINCT volume_id FROM org WHERE organ = 'spleen'),
mask AS (SELECT DISTINCT volume_id, z, y, x FROM org WHERE organ = 'spleen' OR volume_id NOT IN (SELECT volume_id FROM has)), {DILATED}
SELECT volume_id, {SUMS} FROM dil GROUP BY volume_id""")
def combined_mask(spark: SparkSession, d: str) -> DataFrame:
    return marked(regions.combined_mask(some_organs(spark, d), ["volume_id"], GRID, ["spleen"], 4.0))


def _roi_sql() -> str:
    ends = ", ".join(f"greatest(0, min({c}) - {m}) AS {c}_low, least({n - 1}, max({c}) + {m}) AS {c}_high" for c, n, m in (("z", Z, 2), ("y", Y, 3), ("x", X, 3)))
    pick = lambda s, c, n: f"CASE WHEN applied THEN coalesce({s}.{c}_low, 0) ELSE 0 END AS {s}_{c}_low, CASE WHEN applied THEN coalesce({s}.{c}_high, {n - 1}) ELSE {n - 1} END AS {s}_{c}_high"
    size = lambda s: " * ".join(f"({s}_{c}_high - {s}_{c}_low + 1)" for c in INDEX)
    sides = ", ".join(pick(s, c, n) for s in ("fixed", "moving") for c, n in zip(INDEX, (Z, Y, X), strict=True))
    return f"""WITH {VOXELS}, {SOME_SQL}, fixed AS (SELECT volume_id, {ends} FROM org WHERE organ IN ('spleen', 'pancreas') GROUP BY volume_id),
moving AS (SELECT volume_id, {ends} FROM org2 WHERE organ IN ('spleen', 'pancreas') GROUP BY volume_id),
j AS (SELECT volume_id, volume_id IN (SELECT volume_id FROM org) AND volume_id IN (SELECT volume_id FROM org2) AS applied FROM cases),
k AS (SELECT j.volume_id, applied, CASE WHEN NOT applied THEN 'missing segmentation' END AS reason, {sides} FROM j LEFT JOIN fixed ON fixed.volume_id = j.volume_id LEFT JOIN moving ON moving.volume_id = j.volume_id),
t AS (SELECT *, CAST({size('fixed')} AS BIGINT) AS fixed_voxels, CAST({size('moving')} AS BIGINT) AS moving_voxels FROM k)
SELECT *, round({2 * Z * Y * X}e0 / (fixed_voxels + moving_voxels), 1) AS speedup FROM t"""


@query("roi_plan", _roi_sql())
def roi_plan(spark: SparkSession, d: str) -> DataFrame:
    moving = organs(spark, d, "label2").where(F.col("volume_id") % 5 != 4)
    return regions.roi_plan(cases(spark, d), some_organs(spark, d), moving, ["volume_id"], GRID, GRID, ["spleen", "pancreas"], 6.0)


def _surface_sql(a: str, b: str, side: int) -> str:
    return f"SELECT {a}.volume_id, {a}.organ, {side} AS s, {a}.z, {a}.y, {a}.x, min(sqrt(pow((ca.x - cb.x) * 2, 2) + pow((ca.y - cb.y) * 2, 2) + pow((ca.z - cb.z) * 2.5e0, 2))) AS d FROM ca JOIN cb ON ca.volume_id = cb.volume_id AND ca.organ = cb.organ GROUP BY ALL"


EDGE = "SELECT m.volume_id, m.organ, m.z, m.y, m.x FROM {0} m LEFT JOIN {0} n ON n.volume_id = m.volume_id AND n.organ = m.organ AND abs(n.z - m.z) + abs(n.y - m.y) + abs(n.x - m.x) = 1 GROUP BY ALL HAVING count(n.volume_id) < 6"


@query("organ_report", f"""WITH {KEPT}, {SOME_SQL}, ca AS ({EDGE.format('org')}), cb AS ({EDGE.format('org2')}), d AS ({_surface_sql('ca', 'cb', 0)} UNION ALL {_surface_sql('cb', 'ca', 1)}),
q AS (SELECT volume_id, organ, s, quantile_cont(d, 0.95) AS p, avg(d) AS m FROM d GROUP BY ALL), u AS (SELECT volume_id, organ, round(max(p), 2) AS hd95_mm, round(sum(m) / 2, 2) AS msd_mm FROM q GROUP BY ALL),
na AS (SELECT volume_id, organ, count(*) AS n FROM org GROUP BY ALL), nb AS (SELECT volume_id, organ, count(*) AS n FROM org2 GROUP BY ALL),
nc AS (SELECT a.volume_id, a.organ, count(*) AS n FROM org a JOIN org2 b ON b.volume_id = a.volume_id AND b.organ = a.organ AND b.z = a.z AND b.y = a.y AND b.x = a.x GROUP BY ALL)
SELECT na.volume_id, na.organ, round(2e0 * coalesce(nc.n, 0) / (na.n + nb.n), 4) AS dice, hd95_mm, msd_mm, round(na.n * 0.01e0, 2) AS fixed_ml, round(nb.n * 0.01e0, 2) AS moving_ml
FROM na JOIN nb ON nb.volume_id = na.volume_id AND nb.organ = na.organ LEFT JOIN nc ON nc.volume_id = na.volume_id AND nc.organ = na.organ JOIN u ON u.volume_id = na.volume_id AND u.organ = na.organ""")
def organ_report(spark: SparkSession, d: str) -> DataFrame:
    moving = organs(spark, d, "label2").where(F.col("volume_id") % 5 != 4)
    return regions.organ_report(some_organs(spark, d), moving, ["volume_id"], GRID)


@query("qc_label_agreement", """WITH f AS (SELECT CAST(s_suppkey AS BIGINT) AS volume_id, CAST(l AS INT) AS label, ['liver', 'spleen', 'pancreas'][l] AS organ FROM supplier, range(1, 4) t(l)),
m AS (SELECT CAST(s_suppkey AS BIGINT) AS volume_id, CAST(l AS INT) AS label, ['liver', 'spleen', 'pancreas'][1 + (l - 1 + CASE WHEN l > 1 AND s_suppkey % 2 = 0 THEN 1 ELSE 0 END) % 3] AS organ FROM supplier, range(1, 4) t(l))
SELECT f.volume_id, f.label, f.organ, m.organ = f.organ AS agrees FROM f JOIN m ON m.volume_id = f.volume_id AND m.label = f.label""")
def qc_label_agreement(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*map(F.lit, ("liver", "spleen", "pancreas")))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("volume_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("label"))
    moved = F.when((F.col("label") > 1) & (F.col("volume_id") % 2 == 0), 1).otherwise(0)
    side = lambda at: rows.withColumn("organ", F.element_at(known, (1 + (F.col("label") - 1 + at) % 3).cast("int")))
    return regions.agreed_labels(side(F.lit(0)), side(moved))


@query("stage_checks", """WITH s AS (SELECT c_custkey AS run_id, CAST(k AS INT) AS k, CASE WHEN c_custkey % 7 = k THEN NULL WHEN c_custkey % 5 = k THEN 0 ELSE c_acctbal / 1000 END AS m FROM customer, range(2) t(k))
SELECT run_id, 'final_metric[' || ['rigid', 'affine'][k + 1] || ']' AS name, CASE WHEN m IS NULL THEN 'WARN' WHEN abs(m) < 1e-6 THEN 'FAIL' ELSE 'PASS' END AS status, m AS measured, 1e-6 AS threshold FROM s""")
def stage_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    each = [F.struct(F.lit(n).alias("stage"), F.when(k % 7 == i, None).when(k % 5 == i, 0.0).otherwise(F.col("c_acctbal") / 1000).alias("final_metric")) for i, n in enumerate(("rigid", "affine"))]
    rows = table(spark, d, "customer").select(k.alias("run_id"), F.array(*each).alias("stages"), F.lit(1.0).alias("determinant"))
    bare = gates.Gates(max_folding_fraction=None, max_translation_mm=None, max_scale_deviation=None)
    return gates.checks(rows, bare)


def _gaussian_sql(sigma: float) -> str:
    """One weighted join along each axis."""
    parts, before = [KEPT], "vox"
    for axis, n, spacing in zip(INDEX, (Z, Y, X), reversed(GRID.spacing), strict=True):
        s = sigma / spacing
        reach = -int(-3 * s // 1)
        parts.append(f"w{axis} AS (SELECT CAST(k AS INT) AS k, exp(-0.5e0 * pow(k / {s!r}e0, 2)) AS w FROM range(-{reach}, {reach + 1}) t(k))")
        at = ", ".join(f"t.{c}" for c in INDEX)
        on = " AND ".join(f"s.{c} = " + (f"greatest(0, least({n - 1}, t.{c} + k))" if c == axis else f"t.{c}") for c in INDEX)
        parts.append(f"g{axis} AS MATERIALIZED (SELECT t.volume_id, {at}, sum(w * s.v) / sum(w) AS v FROM {before} t CROSS JOIN w{axis} JOIN {before} s ON s.volume_id = t.volume_id AND {on} GROUP BY ALL)")
        before = f"g{axis}"
    return f"WITH {', '.join(parts)} SELECT volume_id, z, y, x, round(v, 5) AS v FROM {before}"


@query("gaussian_smooth", _gaussian_sql(2.0))
def gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    rows = neighbourhood.gaussian(volumes(spark, d).select("volume_id", *INDEX, "v"), ["volume_id"], ["v"], 2.0, GRID)
    return rows.withColumn("v", F.round("v", 5))


@query("pad_edges", f"""WITH {KEPT}, t AS (SELECT volume_id, CAST(a AS INT) AS z, CAST(b AS INT) AS y, CAST(c AS INT) AS x FROM cases, range(15) q(a), range(20) r(b), range(20) s(c))
SELECT t.volume_id, t.z, t.y, t.x, v.v FROM t JOIN vox v ON v.volume_id = t.volume_id AND v.z = least({Z - 1}, t.z) AND v.y = greatest(0, least({Y - 1}, t.y - 2)) AND v.x = greatest(0, least({X - 1}, t.x - 1))""")
def pad_edges(spark: SparkSession, d: str) -> DataFrame:
    return geometry.padded(volumes(spark, d).select("volume_id", *INDEX, "v"), GRID, 5)[0]


@query("coarse_spacing", f"WITH {VOXELS} SELECT volume_id, CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, v FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
def coarse_spacing(spark: SparkSession, d: str) -> DataFrame:
    return resample.to_spacing(volumes(spark, d).select("volume_id", *INDEX, "v"), ["volume_id"], GRID, (4.0, 4.0, 5.0))[0]


@query("transform_field", f"""WITH {VOXELS}, pos AS (SELECT volume_id, z, y, x, x * 2e0 - 40 AS px, y * 2e0 - 60 AS py, z * 2.5e0 + 30 AS pz, 1 + (volume_id % 5) / 10e0 AS s FROM g)
SELECT volume_id, z, y, x, round(s * px + volume_id - px, 6) AS dx, round(0.5e0 * pz - 3, 6) AS dy, round(pz * s - pz, 6) AS dz FROM pos""")
def transform_field(spark: SparkSession, d: str) -> DataFrame:
    s = 1 + F.col("volume_id") % 5 / 10
    m = [s, 0, 0, F.col("volume_id"), 0, 1, 0.5, -3, 0, 0, s, 0, 0, 0, 0, 1]
    rows = cases(spark, d).select("volume_id", F.array(*[(c if hasattr(c, "alias") else F.lit(float(c))).cast("double") for c in m]).alias("matrix"))
    field = resample.displacement_field(rows, ["volume_id"], GRID, "matrix")
    return field.select("volume_id", *INDEX, *[F.round(c, 6).alias(c) for c in ("dx", "dy", "dz")])


@query("principal_lengths", f"""WITH {MASK_SQL}, pos AS (SELECT volume_id, x * 2e0 - 40 AS px, y * 2e0 - 60 AS py, z * 2.5e0 + 30 AS pz FROM mask),
c AS (SELECT volume_id, count(*) AS n, covar_samp(px, px) AS a, covar_samp(px, py) AS b, covar_samp(px, pz) AS c, covar_samp(py, py) AS d, covar_samp(py, pz) AS e, covar_samp(pz, pz) AS f FROM pos GROUP BY volume_id)
SELECT volume_id, n, round(a + d + f, 5) AS trace, round(a * d + a * f + d * f - b * b - c * c - e * e, 4) AS minors, round(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d), 3) AS det FROM c""")
def principal_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The principal lengths by their elementary symmetric functions, which SQL has without eigenvalues."""
    rows = geometry.principal_axes(liver(spark, d), ["volume_id"], GRID)
    a, b, c = (F.pow(F.get("lengths", F.lit(i)), 2) for i in range(3))
    return rows.select("volume_id", "n", F.round(a + b + c, 5).alias("trace"), F.round(a * b + a * c + b * c, 4).alias("minors"), F.round(a * b * c, 3).alias("det"))


# Grids of cases, series, distances and fields

CASE_SQL = """k AS (SELECT CAST(s_suppkey AS BIGINT) AS volume_id, CAST(6 + s_suppkey % 3 AS INT) AS nx, CAST(4 + s_suppkey % 2 AS INT) AS nz, 1 + s_suppkey % 2 AS f FROM supplier),
vox AS (SELECT volume_id, nx, nz, f, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, ((x * 7 + y * 13 + z * 29 + volume_id * 3) % 11) - 5e0 AS v FROM k, range(5) a(z), range(5) b(y), range(8) c(x) WHERE z < nz AND x < nx)"""


def case_volumes(spark: SparkSession, d: str) -> tuple[DataFrame, Grids]:
    """Small volumes of every supplier, each on a grid of its own size and spacing."""
    k = F.col("volume_id")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("volume_id"))
    f = (1 + k % 2).cast("double")
    size = F.array((6 + k % 3).cast("int"), F.lit(5), (4 + k % 2).cast("int"))
    grid = F.struct(size.alias("size"), F.array(f, f, f * 1.25).alias("spacing"), F.array(k.cast("double"), F.lit(0.0), F.lit(-3.0)).alias("origin"), F.array(*map(F.lit, IDENTITY)).alias("direction"))
    grids = Grids(rows.withColumn("grid", grid), ("volume_id",))
    cells = morphology.grid_voxels(rows, ["volume_id"], grids)
    return cells.withColumn("v", (F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 29 + k * 3) % 11 - 5.0), grids


@query("case_grids_spacing", f"""WITH {CASE_SQL} SELECT volume_id, CAST(z // (3 - f) AS INT) AS z, CAST(y // (3 - f) AS INT) AS y, CAST(x // (3 - f) AS INT) AS x, v FROM vox
WHERE f = 2 OR (z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0 AND z // 2 < round_even(nz / 2.0, 0) AND y // 2 < 2 AND x // 2 < round_even(nx / 2.0, 0))""")
def case_grids_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of half the spacing keep every other voxel, the others all."""
    rows, grids = case_volumes(spark, d)
    return resample.to_spacing(rows, ["volume_id"], grids, (2.0, 2.0, 2.5))[0]


@query("case_grids_crop", f"""WITH {CASE_SQL}, b AS (SELECT volume_id, f, nx, greatest(0, min(z) - CASE f WHEN 1 THEN 1 ELSE 0 END) AS z0, min(y) AS y0, min(x) AS x0, least(nz - 1, max(z) + CASE f WHEN 1 THEN 1 ELSE 0 END) AS z1, max(y) AS y1, max(x) AS x1 FROM vox WHERE v = 5 GROUP BY volume_id, f, nx, nz),
c AS (SELECT volume_id, z0, z1, greatest(0, y0 - CASE f WHEN 1 THEN 1 ELSE 0 END) AS y0, least(4, y1 + CASE f WHEN 1 THEN 1 ELSE 0 END) AS y1, greatest(0, x0 - CASE f WHEN 1 THEN 1 ELSE 0 END) AS x0, least(nx - 1, x1 + CASE f WHEN 1 THEN 1 ELSE 0 END) AS x1, f FROM b)
SELECT c.volume_id, count(*) AS n, sum(v) AS total, any_value(c.volume_id + x0 * c.f) AS ox, any_value(y0 * c.f * 1e0) AS oy, any_value(z0 * c.f * 1.25e0 - 3) AS oz FROM c JOIN vox v ON v.volume_id = c.volume_id AND z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY c.volume_id""")
def case_grids_crop(spark: SparkSession, d: str) -> DataFrame:
    """Each volume cropped to the box around its voxels of value 5 with a margin of 0.9 mm, and where its grid begins then."""
    rows, grids = case_volumes(spark, d)
    by = ["volume_id"]
    boxes = geometry.bounding_box(rows.where("v = 5"), by, grids, 0.9)
    sums = geometry.cropped(rows, boxes, by).groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    begins = grids.cropped(boxes).table.select(*by, *[F.get("grid.origin", F.lit(k)).alias(f"o{c}") for k, c in enumerate("xyz")])
    return sums.join(begins, by)


@query("distance_map", f"""WITH {VOXELS}, m AS (SELECT volume_id, z, y, x FROM vox WHERE label = 3), d AS (SELECT v.volume_id, v.z, v.y, v.x, min(pow((v.x - m.x) * 2, 2) + pow((v.y - m.y) * 2, 2) + pow((v.z - m.z) * 2.5e0, 2)) AS d FROM vox v JOIN m ON m.volume_id = v.volume_id GROUP BY ALL)
SELECT volume_id, z, y, x, round(sqrt(d), 6) AS mm FROM d WHERE d <= 400""")
def distance_map(spark: SparkSession, d: str) -> DataFrame:
    """The distance to the kidney of all voxels within 20 mm."""
    mask = volumes(spark, d).where(F.col("label") == 3).select("volume_id", *INDEX)
    rows = planes.squared_distances(mask, ["volume_id"], GRID, planes.step_weights, most=400.0)
    return rows.select("volume_id", *INDEX, F.round(F.sqrt("d2"), 6).alias("mm"))


@query("series_geometry", """WITH s AS (SELECT o_custkey AS k, o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE (o_orderkey % 997) * 0.5e0 END AS d, 128 + CASE WHEN o_custkey % 11 = 0 THEN o_orderkey % 2 ELSE 0 END AS r FROM orders),
a AS (SELECT k, count(*) AS n_slices, count(d) AS n_d, count(DISTINCT d) AS n_places, count(DISTINCT r) AS n_sizes, (max(d) - min(d)) / nullif(count(*) - 1, 0) AS step, min(d) AS d0, any_value(r) AS r FROM s GROUP BY k),
p AS (SELECT *, CASE WHEN n_d < n_slices THEN 'a slice without position, orientation or size' WHEN n_sizes > 1 THEN 'slices of several sizes, spacings or orientations' WHEN n_places < n_slices THEN 'several slices at one place' END AS p1, CASE WHEN n_slices < 2 THEN 'fewer than two slices' END AS p2 FROM a)
SELECT CAST(k AS VARCHAR) AS series_uid, n_slices, concat_ws('; ', p1, p2) AS problems, CASE WHEN p1 IS NULL AND p2 IS NULL THEN CAST(r AS INT) END AS ny, CASE WHEN p1 IS NULL AND p2 IS NULL THEN round(step, 6) END AS dz, CASE WHEN p1 IS NULL AND p2 IS NULL THEN round(5 + d0 * 0.8e0, 6) END AS oz FROM p""")
def series_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Orders as slices of a series for each customer, tilted about x by a right triangle of 3, 4 and 5."""
    k, place = F.col("o_custkey"), (F.col("o_orderkey") % 997) * 0.5
    text = F.concat_ws("\\", F.lit("0"), (7 - place * 0.6).cast("string"), (5 + place * 0.8).cast("string"))
    headers = table(spark, d, "orders").select(k.cast("string").alias("series_uid"), F.col("o_orderkey").cast("string").alias("path"), F.when(k % 10 != 0, text).alias("position"), F.lit("1\\0\\0\\0\\0.8\\0.6").alias("orientation"), F.lit("0.5\\0.25").alias("pixel_spacing"), (128 + F.when(k % 11 == 0, F.col("o_orderkey") % 2).otherwise(0)).cast("string").alias("rows"), F.lit("64").alias("columns"))
    rows = series.series_geometry(series.ordered_slices(headers))
    return rows.select("series_uid", "n_slices", F.array_join("problems", "; ").alias("problems"), F.get("grid.size", F.lit(1)).alias("ny"), F.round(F.get("grid.spacing", F.lit(2)), 6).alias("dz"), F.round(F.get("grid.origin", F.lit(2)), 6).alias("oz"))


@query("composed_fields", f"""WITH {CASES}, g AS (SELECT volume_id, sx, sy, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM cases, range({Z}) a(z), range({Y}) b(y), range({X}) c(x))
SELECT volume_id, z, y, x, CASE WHEN ok THEN round(sx * 3e0 + 0.05e0 * (x * 2 - 40 + sx * 3), 6) + 0 END AS dx, CASE WHEN ok THEN round(sy * 1e0 + 0.5e0, 6) END AS dy, CASE WHEN ok THEN round(-0.02e0 * (x * 2 - 40 + sx * 3), 6) + 0 END AS dz
FROM (SELECT *, x + sx * 1.5e0 BETWEEN 0 AND {X - 1} AND y + sy * 0.5e0 BETWEEN 0 AND {Y - 1} AS ok FROM g)""")
def composed_fields(spark: SparkSession, d: str) -> DataFrame:
    """A shift of each case's own, then a field that grows along x."""
    c = cases(spark, d)
    cells = morphology.grid_voxels(c, ["volume_id"], GRID).join(F.broadcast(c), "volume_id")
    first = cells.select("volume_id", *INDEX, (F.col("sx") * 3.0).alias("dx"), (F.col("sy") * 1.0).alias("dy"), F.lit(0.0).alias("dz"))
    px = F.col("x") * 2.0 - 40
    then = cells.select("volume_id", *INDEX, (0.05 * px).alias("dx"), F.lit(0.5).alias("dy"), (-0.02 * px).alias("dz"))
    out = resample.composed_fields(first, then, ["volume_id"], GRID)
    return out.select("volume_id", *INDEX, *[(F.round(n, 6) + 0.0).alias(n) for n in ("dx", "dy", "dz")])


@query("volume_fingerprints", f"WITH {VOXELS} SELECT CAST(n_nationkey AS BIGINT) AS volume_id, CAST(n_nationkey % 6 AS BIGINT) AS same_as FROM nation")
def volume_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The least volume of equal content: shifts and texture repeat every six nations when the texture is taken by six."""
    k = F.col("volume_id")
    rows = volumes(spark, d).withColumn("v", F.col("v2") + k % 6 - (F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 29 + k * 5) % 11)
    found = cache.fingerprints(rows, ["volume_id"])
    return found.join(found.groupBy("fingerprint").agg(F.min("volume_id").alias("same_as")), "fingerprint").select("volume_id", "same_as")
