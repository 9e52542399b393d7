"""Queries for the operators of the blueprint over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import carry, clean, closest, cohort, evaluate, flags, grid, knn, models
from .plans import experiments, imputation
from .plans.experiments import Task
from .plans.trajectory import CONCEPTS, HOUR, Config, Trajectories
from .sources.tables import epoch, nan_to_null, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# SQL fragments shared by several queries
def _u(where: str = "true") -> str:
    """Usable numeric readings of both tables."""
    part = """SELECT c.row_id, c.stay_id, c.{t} AS t, c.itemid, i.concept, c.valuenum AS v, coalesce(c.storetime, -1) AS st, {lab} AS lab FROM {n} c JOIN d_items i ON c.itemid = i.itemid
    WHERE i.kind IN ('measured', 'setting') AND c.stay_id IS NOT NULL AND c.{t} IS NOT NULL AND c.valuenum IS NOT NULL AND NOT isnan(c.valuenum) AND {w}"""
    return f"u AS ({part.format(n='chartevents', t='charttime', lab=0, w=where)} UNION ALL {part.format(n='labs_le', t='timestp', lab=1, w=where)})"


U = _u()
WIDE = (
    U
    + f""", k AS (SELECT *, row_number() OVER (ORDER BY lab, itemid, st, row_id) AS pr FROM u WHERE concept IN ({", ".join(f"'{c}'" for c in CONCEPTS)})),
w AS (SELECT stay_id, t, {", ".join(f"arg_max(v, pr) FILTER (WHERE concept = '{c}') AS {c}" for c in CONCEPTS)} FROM k GROUP BY 1, 2)"""
)
ONSET = """near AS (SELECT a.abx_id, a.stay_id, a.starttime AS ta, b.charttime AS tb,
    row_number() OVER (PARTITION BY a.abx_id ORDER BY abs(a.starttime - b.charttime), b.charttime, b.bact_id) AS r
  FROM abx a JOIN bacterio b ON a.stay_id = b.stay_id WHERE a.starttime IS NOT NULL AND b.charttime IS NOT NULL),
q AS (SELECT stay_id, abx_id, ta, CASE WHEN ta <= tb AND tb - ta <= 86400 THEN ta WHEN ta >= tb AND ta - tb <= 259200 THEN tb END AS onset_time FROM near WHERE r = 1),
onset AS (SELECT stay_id, arg_min(onset_time, r2) AS onset_time FROM (SELECT *, row_number() OVER (ORDER BY ta, abx_id) AS r2 FROM q WHERE onset_time IS NOT NULL) GROUP BY 1)"""
B = """near_ev AS (SELECT u.stay_id, u.t, u.concept, u.v, onset_time FROM u JOIN onset USING (stay_id) WHERE t >= onset_time - 86400 AND t < onset_time + 259200),
b0 AS (SELECT stay_id, greatest(min(t), min(onset_time) - 86400) AS first, least(max(t), min(onset_time) + 259200) AS last FROM near_ev GROUP BY 1),
b AS (SELECT stay_id, first, CAST(ceil((last - first) / 14400.0) AS BIGINT) AS n FROM b0 WHERE last > first)"""
# the concepts of the trajectories only
UC = _u(f"i.concept IN ({', '.join(repr(c) for c in CONCEPTS)})")
GRID = f"{UC}, {ONSET}, {B}"
MAPHR = """g AS (SELECT near_ev.stay_id, CAST(floor((t - first) / 14400.0) AS BIGINT) + 1 AS timestep, avg(v) FILTER (WHERE concept = 'map') AS map, avg(v) FILTER (WHERE concept = 'heart_rate') AS heart_rate,
    avg(v) FILTER (WHERE concept = 'sbp') AS sbp, avg(v) FILTER (WHERE concept = 'temp_c') AS temp_c, avg(v) FILTER (WHERE concept = 'respiratory_rate') AS respiratory_rate
  FROM near_ev JOIN b USING (stay_id) WHERE (t - first) / 14400.0 < n GROUP BY 1, 2)"""
G4 = f"{GRID}, {MAPHR}"


def _t(spark: SparkSession, d: str) -> Trajectories:
    return Trajectories(spark, d)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Plain cell means (without cleaning and holding) of five concepts, as the fragment G4."""
    t = _t(spark, d)
    c = t.config
    near = grid.around_anchor(t.readings().where(F.col("concept").isin(c.concepts)), t.anchors(), "stay_id", "t", "onset_time", 24 * HOUR, 72 * HOUR)
    b = t.bounds()
    k = F.floor((F.col("t") - F.col("first")) / (4 * HOUR))
    five = ["map", "heart_rate", "sbp", "temp_c", "respiratory_rate"]
    return near.join(b, "stay_id").withColumn("timestep", k + 1).where("timestep <= n").groupBy("stay_id", "timestep").pivot("concept", five).agg(F.avg("v"))


def _r(*names: str, places: int = 4) -> list:
    return [F.round(n, places).alias(n) for n in names]


# --- scans, projections, rules


@query("SELECT row_id, stay_id, itemid, valuenum FROM chartevents WHERE itemid IN (700101, 700108, 700109, 700117, 700126) AND valuenum IS NOT NULL AND NOT isnan(valuenum) AND value <> 'ERROR'")
def scan_inlist_filter(spark, d):
    return table(spark, d, "chartevents").where(F.col("itemid").isin(700101, 700108, 700109, 700117, 700126) & F.col("valuenum").isNotNull() & ~F.isnan("valuenum") & (F.col("value") != "ERROR")).select("row_id", "stay_id", "itemid", "valuenum")


@query("SELECT stay_id, epoch(intime) AS in_s, epoch(outtime) AS out_s, CAST(year(intime) AS INT) AS in_year, CAST(epoch(outtime) - epoch(intime) <= 86400 AS INT) AS short_stay FROM icustays")
def epoch_extract(spark, d):
    i = table(spark, d, "icustays")
    return i.select("stay_id", epoch("intime").alias("in_s"), epoch("outtime").alias("out_s"), F.year("intime").alias("in_year"), (epoch("outtime") - epoch("intime") <= 86400).cast("int").alias("short_stay"))


@query("""SELECT abx_id, CASE WHEN lower(trim(dose_unit_rx)) = 'g' THEN CAST(round(CAST(TRY_CAST(dose_val_rx AS DOUBLE) * 1000 AS DECIMAL(38,10)), 3) AS DOUBLE)
  WHEN lower(trim(dose_unit_rx)) = 'mg' THEN CAST(round(CAST(TRY_CAST(dose_val_rx AS DOUBLE) AS DECIMAL(38,10)), 3) AS DOUBLE) END AS dose_mg FROM abx""")
def case_unit_standardise(spark, d):
    unit, dose = F.lower(F.trim("dose_unit_rx")), F.expr("try_cast(dose_val_rx AS DOUBLE)")
    return table(spark, d, "abx").select("abx_id", clean.first_match([(unit == "g", clean.half_up(dose * 1000)), (unit == "mg", clean.half_up(dose))]).alias("dose_mg"))


@query("""SELECT row_id, CASE WHEN value LIKE 'Wide awake%' THEN 0 WHEN value LIKE 'Calm%' THEN -1 WHEN value LIKE 'Drowsy%' THEN -2 WHEN value LIKE 'Roused%' THEN -3 WHEN value LIKE 'No resp%' THEN -5 END AS score
  FROM chartevents WHERE itemid = 700305 AND value IS NOT NULL""")
def like_pattern_map(spark, d):
    rules = [("Wide awake%", 0), ("Calm%", -1), ("Drowsy%", -2), ("Roused%", -3), ("No resp%", -5)]
    return table(spark, d, "chartevents").where("itemid = 700305 AND value IS NOT NULL").select("row_id", clean.first_match([(F.col("value").like(p), F.lit(s)) for p, s in rules]).alias("score"))


# the form of a drug stands for the code system here: some rules hold in one of them only
RULES = {"group_a": [(None, 3, "000", "001"), ("CAP", 4, "0022", "0022")], "group_b": [("VIAL", 3, "002", "003"), ("BAG", 3, "002", "002")], "group_c": [(None, 3, "004", "009"), ("TAB", 2, "01", "02")]}


def _rule(v: str | None, k: int, lo: str, hi: str) -> str:
    return f"(substr(gsn, 1, {k}) BETWEEN '{lo}' AND '{hi}'" + (f" AND form_unit_disp = '{v}')" if v else ")")


_FLAGS = ", ".join(f"coalesce(max(CASE WHEN {' OR '.join(_rule(*t) for t in ts)} THEN 1 ELSE 0 END), 0) AS {n}" for n, ts in RULES.items())


def _flags(spark, d):
    return cohort.prefix_flags(table(spark, d, "abx").where("hadm_id IS NOT NULL"), "hadm_id", "gsn", RULES, table(spark, d, "admissions"), "form_unit_disp")


@query("SELECT abx_id, CASE upper(trim(route)) WHEN 'IV' THEN 1 WHEN 'IV DRIP' THEN 2 WHEN 'PO' THEN 3 WHEN 'PO/NG' THEN 4 ELSE 0 END AS code FROM abx")
def enum_codes(spark, d):
    r = F.upper(F.trim("route"))
    return table(spark, d, "abx").select("abx_id", clean.first_match([(r == name, F.lit(k)) for k, name in enumerate(("IV", "IV DRIP", "PO", "PO/NG"), 1)], F.lit(0)).alias("code"))


@query(f"SELECT a.hadm_id, {_FLAGS} FROM (SELECT DISTINCT hadm_id FROM admissions) a LEFT JOIN abx USING (hadm_id) GROUP BY 1")
def prefix_rules_flags(spark, d):
    return _flags(spark, d)


@query(f"WITH f AS (SELECT a.hadm_id, {_FLAGS} FROM (SELECT DISTINCT hadm_id FROM admissions) a LEFT JOIN abx USING (hadm_id) GROUP BY 1) SELECT hadm_id, CAST(greatest(group_a, 3 * group_b) + 2 * group_c AS INT) AS score FROM f")
def weighted_greatest_score(spark, d):
    return _flags(spark, d).select("hadm_id", (F.greatest("group_a", 3 * F.col("group_b")) + 2 * F.col("group_c")).cast("int").alias("score"))


@query("""SELECT s.stay_id, round(sum(f.amount), 4) AS amount FROM (SELECT DISTINCT stay_id FROM icustays) s
  LEFT JOIN (SELECT * FROM fluid WHERE itemid IN (730000, 730014, 730042)) f ON s.stay_id = f.stay_id GROUP BY 1""")
def left_sum(spark, d):
    f = table(spark, d, "fluid").where(F.col("itemid").isin(730000, 730014, 730042)).groupBy("stay_id").agg(F.sum("amount").alias("amount"))
    return table(spark, d, "icustays").select("stay_id").distinct().join(f, "stay_id", "left").select("stay_id", *_r("amount"))


@query("""SELECT stay_id, charttime, max(CASE WHEN value = 'Tube in place' THEN 1 ELSE 0 END) AS tube FROM chartevents
  WHERE itemid IN (700301, 700205, 700140) AND stay_id IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""")
def maxcase_by_time(spark, d):
    c = table(spark, d, "chartevents").where(F.col("itemid").isin(700301, 700205, 700140) & F.col("stay_id").isNotNull() & F.col("value").isNotNull())
    return c.groupBy("stay_id", "charttime").agg(F.max(F.when(F.col("value") == "Tube in place", 1).otherwise(0)).alias("tube"))


@query("""SELECT DISTINCT s.stay_id, b.bact_id, b.charttime FROM bacterio b JOIN icustays s ON b.hadm_id = s.hadm_id
  AND b.charttime >= epoch(s.intime) - 86400 AND b.charttime <= epoch(s.outtime) + 86400""")
def range_join_pad(spark, d):
    s = table(spark, d, "icustays").select(F.col("stay_id").alias("s"), F.col("hadm_id").alias("h"), epoch("intime").alias("a"), epoch("outtime").alias("z"))
    b = table(spark, d, "bacterio")
    return b.join(s, (F.col("hadm_id") == F.col("h")) & (F.col("charttime") >= F.col("a") - 86400) & (F.col("charttime") <= F.col("z") + 86400)).select(F.col("s").alias("stay_id"), "bact_id", "charttime").distinct()


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate - INTERVAL 1 DAY AND l_shipdate <= o_orderdate + INTERVAL 30 DAY")
def range_join_orders(spark, d):
    o, li = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.expr("o_orderdate - INTERVAL 1 DAY"), F.expr("o_orderdate + INTERVAL 30 DAY"))
    return li.join(o, on).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT DISTINCT stay_id, itemid, charttime FROM chartevents WHERE stay_id IS NOT NULL")
def distinct_rows(spark, d):
    return table(spark, d, "chartevents").where("stay_id IS NOT NULL").select("stay_id", "itemid", "charttime").distinct()


@query("""SELECT stay_id, charttime AS t, itemid, value FROM chartevents UNION ALL SELECT stay_id, timestp, itemid, NULL FROM labs_le""")
def union_align(spark, d):
    a = table(spark, d, "chartevents").select("stay_id", F.col("charttime").alias("t"), "itemid", "value")
    return a.unionByName(table(spark, d, "labs_le").select("stay_id", F.col("timestp").alias("t"), "itemid"), allowMissingColumns=True)


@query("SELECT stay_id, array_to_string(list_sort(list(DISTINCT itemid)), ',') AS items FROM chartevents WHERE stay_id IS NOT NULL AND itemid IS NOT NULL GROUP BY 1")
def sorted_unique(spark, d):
    return table(spark, d, "chartevents").where("stay_id IS NOT NULL").groupBy("stay_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("itemid")).cast("array<string>")).alias("items"))


@query()
def seeded_sample(spark, d):
    """A fixed number of stays, drawn by hash: the limit is the operator."""
    return table(spark, d, "icustays").select("stay_id").distinct().orderBy(F.xxhash64("stay_id", F.lit(42))).limit(50)


# --- entities


@query("SELECT subject_id, hadm_id, a, z FROM (SELECT subject_id, hadm_id, epoch(admittime) AS a, epoch(dischtime) AS z, row_number() OVER (PARTITION BY admittime, dischtime ORDER BY subject_id, hadm_id, loadtime, deletedtime) AS r FROM admissions) WHERE r = 1")
def dedup_keep_first(spark, d):
    a = table(spark, d, "admissions").select("subject_id", "hadm_id", epoch("admittime").alias("a"), epoch("dischtime").alias("z"))
    return cohort.keep_first(a, ["a", "z"], ["subject_id", "hadm_id"]).select("subject_id", "hadm_id", "a", "z")


@query("SELECT stay_id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY i, stay_id) AS ord FROM (SELECT DISTINCT subject_id, stay_id, epoch(intime) AS i FROM icustays)")
def ordinal_rownum(spark, d):
    s = table(spark, d, "icustays").select("subject_id", "stay_id", epoch("intime").alias("i")).distinct()
    return cohort.ordinal(s, ["subject_id"], [F.col("i").asc_nulls_last(), F.col("stay_id")]).select("stay_id", "subject_id", F.col("ord").cast("bigint").alias("ord"))


@query("""WITH a AS (SELECT DISTINCT subject_id, hadm_id, epoch(admittime) AS s, epoch(dischtime) AS e FROM admissions),
  x AS (SELECT subject_id, e, lag(e) OVER (PARTITION BY subject_id ORDER BY e) AS p FROM (SELECT DISTINCT subject_id, e FROM a WHERE e IS NOT NULL AND subject_id IS NOT NULL))
  SELECT a.hadm_id, a.s, CAST(coalesce(a.s - x.p <= 2592000, false) AS INT) AS re_admission FROM a LEFT JOIN x ON a.subject_id = x.subject_id AND a.e = x.e""")
def readmit_30d(spark, d):
    a = table(spark, d, "admissions").select("subject_id", "hadm_id", epoch("admittime").alias("s"), epoch("dischtime").alias("e")).distinct()
    return cohort.readmissions(a, "subject_id", "s", "e", 30 * 86400.0).select("hadm_id", "s", "re_admission")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS s FROM orders), x AS (SELECT o_custkey, s, lag(s) OVER (PARTITION BY o_custkey ORDER BY s) AS p FROM (SELECT DISTINCT o_custkey, s FROM o))
  SELECT o_orderkey, CAST(coalesce(o.s - x.p <= 2592000, false) AS INT) AS re_admission FROM o JOIN x ON o.o_custkey = x.o_custkey AND o.s = x.s""")
def reorder_30d(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", epoch("o_orderdate").alias("s")).withColumn("e", F.col("s"))
    return cohort.readmissions(o, "o_custkey", "s", "e", 30 * 86400.0).select("o_orderkey", "re_admission")


@query("""WITH s AS (SELECT subject_id, stay_id, i, z, row_number() OVER (PARTITION BY subject_id ORDER BY i, stay_id, z) AS o, count(*) OVER (PARTITION BY subject_id) AS n
    FROM (SELECT DISTINCT subject_id, stay_id, epoch(intime) AS i, epoch(outtime) AS z FROM icustays))
  SELECT b.bact_id, arg_max(s.stay_id, s.o) FILTER (WHERE (b.charttime >= s.i - 172800 AND b.charttime <= s.z + 172800) OR s.n = 1) AS stay_id
  FROM (SELECT bact_id, subject_id, charttime FROM bacterio WHERE stay_id IS NULL) b LEFT JOIN s ON b.subject_id = s.subject_id GROUP BY 1""")
def key_resolution_last_match(spark, d):
    s = table(spark, d, "icustays").select("subject_id", "stay_id", epoch("intime").alias("i"), epoch("outtime").alias("z")).distinct()
    s = cohort.ordinal(s, ["subject_id"], [F.col("i").asc_nulls_last(), F.col("stay_id"), F.col("z").asc_nulls_last()])
    b = table(spark, d, "bacterio").where("stay_id IS NULL")
    return cohort.resolve_keys(b, s, "bact_id", "subject_id", "charttime", "stay_id", "i", "z", "ord", 48 * HOUR)


@query("""WITH s AS (SELECT hadm_id, stay_id, i, z, row_number() OVER (PARTITION BY hadm_id ORDER BY i, stay_id, z) AS o, count(*) OVER (PARTITION BY hadm_id) AS n
    FROM (SELECT DISTINCT hadm_id, stay_id, epoch(intime) AS i, epoch(outtime) AS z FROM icustays))
  SELECT a.abx_id, coalesce(arg_max(s.stay_id, s.o) FILTER (WHERE (a.starttime >= s.i - 172800 AND a.starttime <= s.z + 172800) OR s.n = 1), any_value(a.stay_id)) AS stay_id
  FROM abx a LEFT JOIN s ON a.hadm_id = s.hadm_id GROUP BY 1""")
def key_resolution_every_row(spark, d):
    """Every record takes the key that its second link and time give, and keeps its own only where those give none."""
    s = table(spark, d, "icustays").select("hadm_id", "stay_id", epoch("intime").alias("i"), epoch("outtime").alias("z")).distinct()
    s = cohort.ordinal(s, ["hadm_id"], [F.col("i").asc_nulls_last(), F.col("stay_id"), F.col("z").asc_nulls_last()])
    a = table(spark, d, "abx")
    found = cohort.resolve_keys(a, s, "abx_id", "hadm_id", "starttime", "stay_id", "i", "z", "ord", 48 * HOUR).withColumnRenamed("stay_id", "found")
    return a.select("abx_id", "stay_id").join(found, "abx_id").select("abx_id", F.coalesce("found", "stay_id").alias("stay_id"))


@query("""WITH p AS (SELECT event_id AS a_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS c_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'error')
  SELECT a_id, c_id FROM (SELECT a_id, c_id, row_number() OVER (PARTITION BY a_id ORDER BY abs(p.t - c.t), c.t, c_id) AS r FROM p JOIN c USING (user_id) WHERE abs(p.t - c.t) <= 259200) WHERE r = 1""")
def nearest_event_pair(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", epoch("ts").alias("t"))
    p, c = e.where("event_type = 'purchase'"), e.where("event_type = 'error'")
    return closest.closest_event(p.withColumnRenamed("event_id", "a_id"), c.withColumnRenamed("event_id", "c_id"), "user_id", "a_id", "t", "c_id", "t", 72 * HOUR).select("a_id", "c_id")


@query(f"WITH {ONSET} SELECT stay_id, onset_time FROM onset")
def infection_onset(spark, d):
    return _t(spark, d).anchors()


@query(f"WITH {U}, {ONSET} SELECT u.row_id, u.stay_id FROM u JOIN onset USING (stay_id) WHERE t >= onset_time - 86400 AND t < onset_time + 259200")
def window_filter_anchor(spark, d):
    t = _t(spark, d)
    return grid.around_anchor(t.readings(), t.anchors(), "stay_id", "t", "onset_time", 24 * HOUR, 72 * HOUR).select("row_id", "stay_id")


@query(f"""WITH {G4}, n AS (SELECT DISTINCT s.stay_id, a.abx_id FROM (SELECT DISTINCT stay_id, subject_id, hadm_id FROM icustays) s JOIN abx a ON s.subject_id = a.subject_id AND s.hadm_id = a.hadm_id)
  SELECT g.stay_id, g.timestep, n.abx_id FROM g LEFT JOIN n USING (stay_id)""")
def notes_to_stays(spark, d):
    """Records known by subject and admission, attached to the rows of the stays they belong to."""
    rows = _cells(spark, d).select("stay_id", "timestep")
    return cohort.attach_notes(rows, table(spark, d, "icustays"), table(spark, d, "abx"), "stay_id", ["subject_id", "hadm_id"], "abx_id")


@query("""SELECT stay_id, CAST(charttime AS DOUBLE) AS t FROM chartevents WHERE stay_id IS NOT NULL AND charttime IS NOT NULL UNION SELECT stay_id, timestp FROM labs_le WHERE stay_id IS NOT NULL AND timestp IS NOT NULL
  UNION SELECT stay_id, starttime FROM fluid WHERE stay_id IS NOT NULL AND starttime IS NOT NULL""")
def distinct_times(spark, d):
    return grid.distinct_times("stay_id", *[(table(spark, d, n), c) for n, c in (("chartevents", "charttime"), ("labs_le", "timestp"), ("fluid", "starttime"))])


# --- irregular rows


@query(f"WITH {WIDE} SELECT * FROM w")
def eav_pivot_last(spark, d):
    return _t(spark, d).wide()


@query(f"""WITH {WIDE} SELECT stay_id, t, CASE WHEN heart_rate <= 250 THEN heart_rate END AS heart_rate, CASE WHEN map >= 0 AND map <= 200 THEN map END AS map,
  CASE WHEN spo2 > 150 THEN NULL WHEN spo2 > 100 THEN 100 ELSE spo2 END AS spo2,
  CASE WHEN (CASE WHEN fio2 > 100 THEN NULL WHEN fio2 < 1 THEN fio2 * 100 ELSE fio2 END) >= 20 THEN (CASE WHEN fio2 > 100 THEN NULL WHEN fio2 < 1 THEN fio2 * 100 ELSE fio2 END) END AS fio2 FROM w""")
def outlier_null_clamp(spark, d):
    w = clean.out_of_bounds_to_null(_t(spark, d).wide(), {"heart_rate": (None, 250.0), "map": (0.0, 200.0)})
    return w.select("stay_id", "t", "heart_rate", "map", clean.clamp(F.col("spo2"), 150.0, 100.0).alias("spo2"), clean.fraction_to_percent(F.col("fio2")).alias("fio2"))


@query(f"""WITH {WIDE}, m AS (SELECT stay_id, t, CASE WHEN temp_c > 38.5 THEN NULL ELSE temp_c END AS temp_c, CASE WHEN temp_c > 38.5 THEN temp_c END AS temp_f FROM w)
  SELECT stay_id, t, round(coalesce(temp_c, (coalesce(temp_f, temp_c * 1.8 + 32) - 32) / 1.8), 4) AS temp_c, round(coalesce(temp_f, temp_c * 1.8 + 32), 4) AS temp_f FROM m""")
def unit_conversion_mutual(spark, d):
    w = _t(spark, d).wide().select("stay_id", "t", "temp_c", F.lit(None).cast("double").alias("temp_f"))
    return clean.mutual_linear(clean.move_misplaced(w, "temp_c", "temp_f", 38.5), "temp_c", "temp_f", 1.8, 32.0).select("stay_id", "t", *_r("temp_c", "temp_f"))


@query("""WITH r AS (SELECT row_id, valuenum AS v, CASE WHEN value LIKE 'Nose%' THEN 1 WHEN value LIKE 'Simple%' THEN 2 ELSE 0 END AS dev FROM chartevents WHERE itemid = 700201 AND valuenum IS NOT NULL AND NOT isnan(valuenum))
  SELECT row_id, CASE WHEN v <= 24 THEN 1.0 WHEN v <= 32 THEN 3.0 WHEN v <= 44 THEN 6.0 WHEN v <= 70 THEN 15.0 END AS flow FROM r""")
def flow_lookup_smallest_threshold(spark, d):
    r = table(spark, d, "chartevents").where("itemid = 700201 AND valuenum IS NOT NULL AND NOT isnan(valuenum)")
    return r.select("row_id", clean.by_threshold(F.col("valuenum"), [(24, 1.0), (32, 3.0), (44, 6.0), (70, 15.0)]).alias("flow"))


@query(f"WITH {WIDE} SELECT stay_id, t, coalesce(map, dbp, sbp) AS first_known FROM w")
def horizontal_coalesce(spark, d):
    return _t(spark, d).wide().select("stay_id", "t", F.coalesce("map", "dbp", "sbp").alias("first_known"))


@query(f"WITH {WIDE} SELECT stay_id, t, round(coalesce(spo2 / nullif(CASE WHEN fio2 < 1 THEN fio2 * 100 ELSE fio2 END, 0), spo2 / nullif(peep, 0), spo2), 4) AS ratio FROM w")
def nested_ratio(spark, d):
    """A ratio whose denominator falls back from one column to the next."""
    f = F.when(F.col("fio2") < 1, F.col("fio2") * 100).otherwise(F.col("fio2"))
    return _t(spark, d).wide().select("stay_id", "t", F.round(F.coalesce(F.try_divide("spo2", f), F.try_divide("spo2", "peep"), F.col("spo2")), 4).alias("ratio"))


_HOLD = {"heart_rate": 2.0, "temp_c": 6.0, "fio2": 12.0}
_HELD = ", ".join(
    f"coalesce({c}, CASE WHEN t - last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER w1 <= {h * 3600} THEN last_value({c} IGNORE NULLS) OVER w1 END) AS {c}" for c, h in _HOLD.items()
)


@query(f"WITH {WIDE} SELECT stay_id, t, {_HELD} FROM w WINDOW w1 AS (PARTITION BY stay_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def locf_ttl(spark, d):
    return carry.hold_values(_t(spark, d).wide().select("stay_id", "t", *_HOLD), "stay_id", "t", {c: h * HOUR for c, h in _HOLD.items()})


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM w" for c in CONCEPTS))
def missingness_profile(spark, d):
    return cohort.missing_profile(_t(spark, d).wide(), CONCEPTS).select("column_name", F.round("missing", 6).alias("missing"))


# --- grids


@query(f"WITH {GRID} SELECT stay_id, first, n FROM b")
def grid_bounds(spark, d):
    return _t(spark, d).bounds()


@query(f"WITH {G4} SELECT stay_id, timestep, round(map, 4) AS map, round(heart_rate, 4) AS heart_rate, round(sbp, 4) AS sbp, round(temp_c, 4) AS temp_c, round(respiratory_rate, 4) AS respiratory_rate FROM g")
def grid_window_mean(spark, d):
    return _cells(spark, d).select("stay_id", "timestep", *_r("map", "heart_rate", "sbp", "temp_c", "respiratory_rate"))


CELL = "cells AS (SELECT stay_id, first, CAST(unnest(range(n)) AS BIGINT) AS k FROM b), cell AS (SELECT stay_id, k + 1 AS timestep, first + k * 14400 AS ws, first + (k + 1) * 14400 AS we FROM cells)"


@query(f"""WITH {GRID}, {CELL}, f AS (SELECT stay_id, starttime, endtime, amount FROM fluid WHERE stay_id IS NOT NULL AND starttime IS NOT NULL AND endtime IS NOT NULL)
  SELECT c.stay_id, c.timestep, round(coalesce(sum(amount) FILTER (WHERE starttime < we AND endtime >= ws AND endtime >= starttime), 0), 3) AS fluid_step, round(coalesce(sum(amount) FILTER (WHERE endtime < we), 0), 3) AS fluid_total
  FROM cell c LEFT JOIN f ON f.stay_id = c.stay_id GROUP BY 1, 2""")
def interval_overlap_sum_total(spark, d):
    b = _t(spark, d).bounds()
    f = table(spark, d, "fluid").where("stay_id IS NOT NULL AND starttime IS NOT NULL AND endtime IS NOT NULL").select("stay_id", "starttime", "endtime", "amount")
    each = grid.overlapped_cells(f.where("endtime >= starttime"), b, "stay_id", "starttime", "endtime", 4 * HOUR, False).groupBy("stay_id", "timestep").agg(F.sum("amount").alias("fluid_step"))
    total = grid.running_before(f, b, "stay_id", "endtime", "amount", 4 * HOUR)
    return grid.grid_cells(b, "stay_id", 4 * HOUR).join(each, ["stay_id", "timestep"], "left").join(total, ["stay_id", "timestep"], "left").select(
        "stay_id", "timestep", F.round(F.coalesce("fluid_step", F.lit(0.0)), 3).alias("fluid_step"), F.round("total", 3).alias("fluid_total")
    )


@query(f"""WITH {GRID}, {CELL}, f AS (SELECT stay_id, starttime, endtime, rate FROM fluid WHERE stay_id IS NOT NULL AND endtime >= starttime AND rate IS NOT NULL AND NOT isnan(rate))
  SELECT c.stay_id, c.timestep, round(coalesce(median(rate), 0), 4) AS rate_median, round(coalesce(max(rate), 0), 4) AS rate_max
  FROM cell c LEFT JOIN f ON f.stay_id = c.stay_id AND starttime <= we AND endtime >= ws GROUP BY 1, 2""")
def overlap_median_max(spark, d):
    b = _t(spark, d).bounds()
    f = table(spark, d, "fluid").where("stay_id IS NOT NULL AND endtime >= starttime AND rate IS NOT NULL AND NOT isnan(rate)").select("stay_id", "starttime", "endtime", "rate")
    g = grid.overlapped_cells(f, b, "stay_id", "starttime", "endtime", 4 * HOUR, True).groupBy("stay_id", "timestep").agg(F.median("rate").alias("m"), F.max("rate").alias("x"))
    return grid.grid_cells(b, "stay_id", 4 * HOUR).join(g, ["stay_id", "timestep"], "left").select("stay_id", "timestep", F.round(F.coalesce("m", F.lit(0.0)), 4).alias("rate_median"), F.round(F.coalesce("x", F.lit(0.0)), 4).alias("rate_max"))


@query(f"""WITH {GRID}, {CELL}, a AS (SELECT stay_id, starttime, stoptime, lower(trim(drug)) AS drug FROM abx WHERE stay_id IS NOT NULL AND stoptime >= starttime), f AS (SELECT stay_id, min(starttime) AS f0 FROM a GROUP BY 1)
  SELECT c.stay_id, c.timestep, CAST(count(a.starttime) > 0 AS INT) AS given, count(DISTINCT drug) AS n_drugs, round((any_value(ws) - any_value(f0)) / 3600, 4) AS hours_since_first
  FROM cell c LEFT JOIN a ON a.stay_id = c.stay_id AND starttime <= we AND stoptime >= ws LEFT JOIN f ON f.stay_id = c.stay_id GROUP BY 1, 2""")
def active_distinct(spark, d):
    b = _t(spark, d).bounds()
    a = table(spark, d, "abx").where("stay_id IS NOT NULL AND stoptime >= starttime").select("stay_id", "starttime", "stoptime", F.lower(F.trim("drug")).alias("drug"))
    g = grid.overlapped_cells(a, b, "stay_id", "starttime", "stoptime", 4 * HOUR, True).groupBy("stay_id", "timestep").agg(F.count("*").alias("n"), F.count_distinct("drug").alias("n_drugs"))
    first = a.groupBy("stay_id").agg(F.min("starttime").alias("f0"))
    return grid.grid_cells(b, "stay_id", 4 * HOUR).join(g, ["stay_id", "timestep"], "left").join(first, "stay_id", "left").select(
        "stay_id", "timestep", F.coalesce(F.col("n") > 0, F.lit(False)).cast("int").alias("given"), F.coalesce("n_drugs", F.lit(0)).alias("n_drugs"), F.round((F.col("timestamp") - F.col("f0")) / 3600, 4).alias("hours_since_first")
    )


@query(f"""WITH {GRID}, {CELL}, p AS (SELECT stay_id, starttime AS t, amount FROM fluid WHERE stay_id IS NOT NULL AND starttime IS NOT NULL)
  SELECT c.stay_id, c.timestep, round(coalesce(sum(amount) FILTER (WHERE t >= ws AND t < we), 0), 3) AS step_sum, round(coalesce(sum(amount) FILTER (WHERE t < we), 0), 3) AS total FROM cell c LEFT JOIN p ON p.stay_id = c.stay_id GROUP BY 1, 2""")
def point_sum_cumulative(spark, d):
    b = _t(spark, d).bounds()
    p = table(spark, d, "fluid").where("stay_id IS NOT NULL AND starttime IS NOT NULL").select("stay_id", F.col("starttime").alias("t"), "amount")
    k = F.floor((F.col("t") - F.col("first")) / (4 * HOUR)) + 1
    each = p.join(b, "stay_id").withColumn("timestep", k).where("timestep >= 1 AND timestep <= n").groupBy("stay_id", "timestep").agg(F.sum("amount").alias("s"))
    total = grid.running_before(p, b, "stay_id", "t", "amount", 4 * HOUR)
    return total.join(each, ["stay_id", "timestep"], "left").select("stay_id", "timestep", F.round(F.coalesce("s", F.lit(0.0)), 3).alias("step_sum"), F.round("total", 3).alias("total"))


_C = Config()
_LIMITS = {"below": 75.0, "fluid": 500.0}  # of this project's own choice


def _trajectory_sql() -> str:
    """The whole pipeline: cleaned, held for their hours, cell means, streams, rolling sum and first event."""

    def cleaned(c: str) -> str:
        lo, hi = _C.bounds.get(c, (None, None))
        if c == "spo2":
            return "CASE WHEN spo2 > 150 THEN NULL WHEN spo2 > 100 THEN 100 ELSE spo2 END AS spo2"
        if c == "fio2":
            pct = "(CASE WHEN fio2 > 100 THEN NULL WHEN fio2 < 1 THEN fio2 * 100 ELSE fio2 END)"
            return f"CASE WHEN {pct} >= 20 THEN {pct} END AS fio2"
        return f"CASE WHEN true{'' if lo is None else f' AND {c} >= {lo}'}{'' if hi is None else f' AND {c} <= {hi}'} THEN {c} END AS {c}"

    at = "last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER w1"
    held = ", ".join(f"coalesce({c}, CASE WHEN t - {at.format(c=c)} <= {_C.hold_h[c] * 3600} THEN last_value({c} IGNORE NULLS) OVER w1 END) AS {c}" for c in CONCEPTS)
    return f"""WITH {GRID}, {CELL},
  k AS (SELECT u.*, row_number() OVER (ORDER BY lab, itemid, st, row_id) AS pr FROM u JOIN onset USING (stay_id) WHERE t >= onset_time - 86400 AND t < onset_time + 259200),
  w AS (SELECT stay_id, t, {", ".join(f"arg_max(v, pr) FILTER (WHERE concept = '{c}') AS {c}" for c in CONCEPTS)} FROM k GROUP BY 1, 2),
  c0 AS (SELECT stay_id, t, {", ".join(cleaned(c) for c in CONCEPTS)} FROM w),
  h AS (SELECT stay_id, t, {held} FROM c0 WINDOW w1 AS (PARTITION BY stay_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  m AS (SELECT h.stay_id, CAST(floor((t - first) / 14400.0) AS BIGINT) + 1 AS timestep, {", ".join(f"avg({c}) AS {c}" for c in CONCEPTS)} FROM h JOIN b USING (stay_id) WHERE (t - first) / 14400.0 < n GROUP BY 1, 2),
  f AS (SELECT stay_id, starttime, endtime, amount, CASE WHEN NOT isnan(rate) THEN rate END AS rate FROM fluid WHERE stay_id IS NOT NULL AND starttime IS NOT NULL AND endtime IS NOT NULL),
  fs AS (SELECT c.stay_id, c.timestep, coalesce(sum(amount) FILTER (WHERE starttime < we AND endtime >= ws AND endtime >= starttime), 0) AS fluid_step, coalesce(sum(amount) FILTER (WHERE endtime < we), 0) AS fluid_total,
    coalesce(median(rate) FILTER (WHERE starttime < we AND endtime >= ws AND endtime >= starttime), 0) AS rate_median, coalesce(max(rate) FILTER (WHERE starttime < we AND endtime >= ws AND endtime >= starttime), 0) AS rate_max
    FROM cell c LEFT JOIN f ON f.stay_id = c.stay_id GROUP BY 1, 2),
  a AS (SELECT stay_id, starttime, stoptime, lower(trim(drug)) AS drug FROM abx WHERE stay_id IS NOT NULL AND stoptime >= starttime),
  ds AS (SELECT c.stay_id, c.timestep, count(DISTINCT drug) AS n_drugs FROM cell c LEFT JOIN a ON a.stay_id = c.stay_id AND starttime <= we AND stoptime >= ws GROUP BY 1, 2),
  s AS (SELECT stay_id, min(epoch(intime)) AS i FROM icustays GROUP BY 1),
  t AS (SELECT c.stay_id, c.timestep, ws AS timestamp, (ws - i) / 3600 AS hours_in, {", ".join(CONCEPTS)}, fluid_step, fluid_total, rate_median, rate_max, n_drugs FROM cell c LEFT JOIN m USING (stay_id, timestep)
    JOIN fs USING (stay_id, timestep) JOIN ds USING (stay_id, timestep) LEFT JOIN s USING (stay_id)),
  r AS (SELECT *, sum(fluid_step) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll FROM t),
  e AS (SELECT *, max(CAST(coalesce(roll >= {_LIMITS["fluid"]} AND map < {_LIMITS["below"]}, false) AS INT)) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM r)
  SELECT stay_id, timestep, timestamp, {", ".join(f"round({c}, 4) AS {c}" for c in [*CONCEPTS, "fluid_step", "fluid_total", "rate_median", "rate_max", "hours_in"])}, round(roll, 4) AS fluid_rolling, n_drugs,
    CASE WHEN past = 1 THEN 2 WHEN roll >= {_LIMITS["fluid"]} AND map < {_LIMITS["below"]} THEN 1 ELSE 0 END AS event_flag FROM e"""


@query(_trajectory_sql())
def trajectory_grid(spark, d):
    """The whole pipeline: cleaned, held, gridded, joined with its streams and flagged."""
    t = _t(spark, d).flagged(**_LIMITS)
    places = [*CONCEPTS, "fluid_step", "fluid_total", "rate_median", "rate_max", "hours_in", "fluid_rolling"]
    return t.withColumns({c: F.round(c, 4) for c in places})


@query(f"""WITH {G4}, n AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY timestep) AS i FROM g),
  p AS (SELECT stay_id, timestep, i, map, max(CASE WHEN map IS NOT NULL THEN i END) OVER (PARTITION BY stay_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi,
    min(CASE WHEN map IS NOT NULL THEN i END) OVER (PARTITION BY stay_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi FROM n)
  SELECT p.stay_id, p.timestep, round(coalesce(p.map, a.map + (z.map - a.map) * (p.i - p.pi) / (p.qi - p.pi)), 4) AS map
  FROM p LEFT JOIN n a ON a.stay_id = p.stay_id AND a.i = p.pi LEFT JOIN n z ON z.stay_id = p.stay_id AND z.i = p.qi""")
def linear_interp_gaps(spark, d):
    return carry.interpolate_rows(_cells(spark, d).select("stay_id", "timestep", "map"), "stay_id", "timestep", ["map"]).select("stay_id", "timestep", *_r("map"))


@query()
def knn1_impute(spark, d):
    return knn.nearest_neighbour_fill(_cells(spark, d), ["stay_id", "timestep"], ["map", "heart_rate", "sbp", "temp_c", "respiratory_rate"])


@query()
def impute_dispatch(spark, d):
    return imputation.fill_missing(_cells(spark, d), "stay_id", "timestep", ["map", "heart_rate", "sbp", "temp_c", "respiratory_rate"])


# --- derived values, flags, exclusions


@query(f"""WITH {G4}, r AS (SELECT stay_id, timestep, CASE WHEN sbp <> 0 THEN heart_rate / sbp END AS x, map FROM g)
  SELECT stay_id, timestep, round(coalesce(x, (SELECT avg(x) FROM r)), 4) AS ratio, round(coalesce(map, (SELECT median(map) FROM r)), 4) AS map FROM r""")
def ratio_fill_mean_median(spark, d):
    r = _cells(spark, d).select("stay_id", "timestep", F.try_divide("heart_rate", "sbp").alias("x"), "map")
    s = r.agg(F.avg("x").alias("ax")).join(F.broadcast(evaluate.exact_median(r, "map", "mm")), F.lit(True))  # one row each
    return r.join(F.broadcast(s), F.lit(True)).select("stay_id", "timestep", F.round(F.coalesce("x", "ax"), 4).alias("ratio"), F.round(F.coalesce("map", "mm"), 4).alias("map"))


@query(f"WITH {G4} SELECT stay_id, timestep, CASE WHEN map IS NULL THEN 0 WHEN map >= 90 THEN 0 WHEN map >= 80 THEN 1 ELSE 2 END AS score FROM g")
def ordinal_score_map(spark, d):
    return _cells(spark, d).select("stay_id", "timestep", clean.ordinal_score(F.col("map"), [(90, 0), (80, 1)], 2).alias("score"))


def _composite(c: DataFrame) -> DataFrame:
    met = [(F.col("temp_c") >= 38) | (F.col("temp_c") <= 36), F.col("heart_rate") > 90, F.col("respiratory_rate") >= 20]
    return c.withColumn("score", sum((F.coalesce(m, F.lit(False)).cast("int") for m in met), F.lit(0)))


SCORE = "s AS (SELECT *, CAST(coalesce(temp_c >= 38 OR temp_c <= 36, false) AS INT) + CAST(coalesce(heart_rate > 90, false) AS INT) + CAST(coalesce(respiratory_rate >= 20, false) AS INT) AS score FROM g)"


@query(f"WITH {G4}, {SCORE} SELECT stay_id, timestep, score FROM s")
def composite_score(spark, d):
    return _composite(_cells(spark, d)).select("stay_id", "timestep", "score")


@query(f"WITH {G4}, {SCORE} SELECT stay_id, timestep FROM s WHERE stay_id NOT IN (SELECT stay_id FROM s WHERE map > 130) AND stay_id IN (SELECT stay_id FROM s WHERE score >= 2)")
def group_exclusions(spark, d):
    s = _composite(_cells(spark, d))
    return cohort.require_any(cohort.exclude_any(s, "stay_id", F.col("map") > 130), "stay_id", F.col("score") >= 2).select("stay_id", "timestep")


@query(f"WITH {G4}, {SCORE} SELECT score, count(*) AS n, count(DISTINCT stay_id) AS stays FROM s GROUP BY 1")
def value_counts(spark, d):
    return _composite(_cells(spark, d)).groupBy("score").agg(F.count("*").alias("n"), F.count_distinct("stay_id").alias("stays"))


@query(f"""WITH {G4}, {SCORE}, x AS (SELECT stay_id FROM s GROUP BY 1 HAVING arg_min(score, timestep) >= 2 AND max(timestep) - min(timestep) <= 8) SELECT stay_id, timestep FROM s WHERE stay_id NOT IN (SELECT stay_id FROM x)""")
def early_exclusion(spark, d):
    """Without the stays that begin with the condition and span at most eight steps."""
    return cohort.exclude_early(_composite(_cells(spark, d)), "stay_id", "timestep", "timestep", F.col("score") >= 2, 8).select("stay_id", "timestep")


EVENT = """e AS (SELECT *, max(CAST(coalesce(score >= 2, false) AS INT)) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s),
  ev AS (SELECT *, CASE WHEN past = 1 THEN 2 WHEN score >= 2 THEN 1 ELSE 0 END AS event_flag FROM e)"""


@query(f"WITH {G4}, {SCORE}, {EVENT} SELECT stay_id, timestep, event_flag FROM ev")
def first_event_censor(spark, d):
    return flags.first_event(_composite(_cells(spark, d)), "stay_id", "timestep", F.col("score") >= 2, "event_flag").select("stay_id", "timestep", "event_flag")


@query(f"""WITH {G4}, {SCORE}, r AS (SELECT *, sum(score) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll FROM s),
  e AS (SELECT *, max(CAST(coalesce(roll >= 4 AND map < 90, false) AS INT)) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM r)
  SELECT stay_id, timestep, CAST(roll AS BIGINT) AS roll, CASE WHEN past = 1 THEN 2 WHEN roll >= 4 AND map < 90 THEN 1 ELSE 0 END AS event_flag FROM e""")
def rolling_sum_first_flag(spark, d):
    s = _composite(_cells(spark, d)).withColumn("roll", flags.rolling_sum("stay_id", "timestep", "score", 3))
    return flags.first_event(s, "stay_id", "timestep", (F.col("roll") >= 4) & (F.col("map") < 90), "event_flag").select("stay_id", "timestep", "roll", "event_flag")


# --- windows, models, metrics


def _windows(spark, d, horizon: int = 3) -> DataFrame:
    s = _composite(_cells(spark, d))
    return flags.sliding_windows(s, "stay_id", "timestep", ["map", "heart_rate", "sbp"], (F.col("score") >= 2).cast("int"), 3, horizon)


@query(f"""WITH {G4}, {SCORE}, w AS (SELECT stay_id, timestep, sum(heart_rate) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS hr,
    max(CAST(score >= 2 AS INT)) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING) AS m, count(*) OVER (PARTITION BY stay_id ORDER BY timestep ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM s)
  SELECT stay_id, timestep, round(hr, 3) AS hr_sum, CAST(coalesce(m > 0, false) AS INT) AS y FROM w WHERE n = 6""")
def sliding_windows_target(spark, d):
    hr = F.aggregate(F.filter(F.transform("x", lambda r: r[1]), lambda v: v.isNotNull()), F.lit(0.0), lambda a, b: a + b)
    known = F.exists("x", lambda r: r[1].isNotNull())
    return _windows(spark, d).select("stay_id", "timestep", F.round(F.when(known, hr), 3).alias("hr_sum"), "y")


@query(f"""WITH {G4}, {SCORE}, h AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY timestep) AS i, count(*) OVER (PARTITION BY stay_id) AS n FROM s)
  SELECT stay_id, round(sum(map) FILTER (WHERE i <= 4), 3) AS map_sum, arg_max(score, timestep) AS y FROM h WHERE n >= 4 GROUP BY 1""")
def head_window_last_target(spark, d):
    w = flags.head_windows(_composite(_cells(spark, d)), "stay_id", "timestep", ["map"], "score", 4)
    known = F.filter(F.flatten("x"), lambda v: v.isNotNull())
    return w.select("stay_id", F.round(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b)), 3).alias("map_sum"), "y")


@query()
def patient_split(spark, d):
    return table(spark, d, "icustays").select("stay_id").distinct().select("stay_id", evaluate.hash_split(F.col("stay_id")).alias("train"))


@query(f"""WITH {G4}, m AS (SELECT avg(map) AS mm, stddev_pop(map) AS sm, avg(heart_rate) AS mh, stddev_pop(heart_rate) AS sh FROM g WHERE timestep <= 6)
  SELECT stay_id, timestep, round((map - mm) / sm, 4) AS map, round((heart_rate - mh) / sh, 4) AS heart_rate FROM g, m""")
def standardise_pop(spark, d):
    return evaluate.standardise(_cells(spark, d).select("stay_id", "timestep", "map", "heart_rate"), ["map", "heart_rate"], F.col("timestep") <= 6).select("stay_id", "timestep", *_r("map", "heart_rate"))


def _scored(spark, d) -> DataFrame:
    e = table(spark, d, "lineitem")
    return e.select((F.col("l_discount") * 5 + F.col("l_tax") * 5).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


SC = "sc AS (SELECT l_discount * 5 + l_tax * 5 AS p, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem), per AS (SELECT p, sum(y) AS pp, count(*) AS c FROM sc GROUP BY 1), cu AS (SELECT *, sum(pp) OVER (ORDER BY p DESC) AS tp, sum(c) OVER (ORDER BY p DESC) AS n, sum(pp) OVER () AS pos, sum(c) OVER () AS al FROM per)"


@query(f"""WITH {SC} SELECT round(sum((c - pp) * (tp - pp / 2.0)) / any_value((al - pos) * pos), 6) AS auroc, round(sum(pp * tp / n) / any_value(pos), 6) AS average_precision,
  round(sum(CASE WHEN p >= 0.5 THEN pp ELSE c - pp END) / any_value(al), 6) AS accuracy FROM cu""")
def ranking_metrics(spark, d):
    return evaluate.ranking_metrics(_scored(spark, d), "p", "y").select(*_r("auroc", "average_precision", "accuracy", places=6))


@query(f"""WITH {SC}, f AS (SELECT *, 2.0 * tp / (n + pos) AS f1 FROM cu) SELECT round(p, 6) AS threshold, round(f1, 6) AS f1, round(tp / pos, 6) AS sensitivity, round((al - pos - n + tp) / (al - pos), 6) AS specificity, round(tp / n, 6) AS ppv
  FROM f ORDER BY f1 DESC, p LIMIT 1""")
def f1_optimal_threshold(spark, d):
    return evaluate.best_f1(_scored(spark, d), "p", "y").select(*_r("threshold", "f1", "sensitivity", "specificity", "ppv", places=6))


@query("""WITH e AS (SELECT valuenum AS y, avg(valuenum) OVER (PARTITION BY itemid) AS p FROM labs_le WHERE valuenum IS NOT NULL AND NOT isnan(valuenum))
  SELECT round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM e""")
def regression_metrics(spark, d):
    le = nan_to_null(table(spark, d, "labs_le").select("itemid", F.col("valuenum").alias("y"))).dropna()
    e = le.join(le.groupBy("itemid").agg(F.avg("y").alias("p")), "itemid")
    return evaluate.regression_metrics(e, "y", "p").select(*_r("mse", "rmse", "mae"), F.round("r2", 6).alias("r2"))


@query("SELECT round(avg(x), 6) AS mean_target, arg_min(x, o) AS majority FROM (SELECT x, row_number() OVER (ORDER BY n DESC, x) AS o, n FROM (SELECT x, count(*) OVER (PARTITION BY x) AS n FROM (SELECT CAST(l_quantity AS DOUBLE) AS x FROM lineitem)))")
def baseline_metrics(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))
    return evaluate.baselines(x, "x").select(F.round("mean_target", 6).alias("mean_target"), "majority")


@query()
def logistic_fit(spark, d):
    w = models.flatten_windows(_windows(spark, d)).withColumn("train", evaluate.hash_split(F.col("stay_id"))).persist()
    m = models.logistic(w.where("train"))
    return evaluate.ranking_metrics(models.scores(m, w.where("NOT train")), "score", "y")


@query()
def ridge_fit(spark, d):
    s = _composite(_cells(spark, d))
    w = flags.head_windows(s, "stay_id", "timestep", ["map", "heart_rate", "sbp"], "map", 4).where("y IS NOT NULL")
    w = models.flatten_windows(w).withColumn("train", evaluate.hash_split(F.col("stay_id"))).persist()
    m = models.linear(w.where("train"), "ridge", 1.0)
    return evaluate.regression_metrics(models.scores(m, w.where("NOT train"), classification=False), "y", "score")


@query()
def experiment_grid(spark, d):
    """Tasks x models x treatments over the trajectories: one result row each."""
    t = _t(spark, d)
    los = table(spark, d, "icustays").groupBy("stay_id").agg(F.min("los").alias("los"))
    traj = _composite(t.fixed()).join(los, "stay_id", "left").drop("timestamp", "hours_in")
    tasks = {
        "event_ahead": Task("temporal", (F.col("score") >= 2).cast("int")),
        "event_at_end": Task("static", (F.col("score") >= 2).cast("int")),
        "length_of_stay": Task("static", "los", numeric=True),
    }
    return experiments.run_grid(traj, tasks, "stay_id", "timestep", treatments=("fluid_step", "fluid_total", "rate_median", "rate_max", "n_drugs"), never=("score", "los"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS n, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def text_ws_normalise(spark, d):
    x = text.squeeze(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length(x).cast("bigint").alias("n"), F.md5(x).alias("h"))


@query()
def note_json(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.document_json(doc_id=F.col("doc_id"), source=F.col("source"), text=text.squeeze(F.col("text"))).alias("json"))


@query("SELECT user_id, event_type, epoch(time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01')) AS window_start, round(avg(value), 4) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_window_mean(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type", F.window("ts", "4 hours")).agg(F.avg("value").alias("m"), F.count("*").alias("n")).select("user_id", "event_type", F.col("window.start").cast("double").alias("window_start"), F.round("m", 4).alias("mean_value"), "n")


@query(f"WITH {U}, o AS (SELECT stay_id, concept, v, row_number() OVER (PARTITION BY stay_id, concept ORDER BY t DESC, lab DESC, row_id DESC) AS r FROM u) SELECT stay_id, concept, v FROM o WHERE r <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("stay_id", "concept").orderBy(F.desc("t"), F.desc("lab"), F.desc("row_id"))
    return _t(spark, d).readings().withColumn("r", F.row_number().over(w)).where("r <= 3").select("stay_id", "concept", "v")
