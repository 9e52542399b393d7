"""The numbered problems of the core over the given tables: pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grid_fill, impute, intervals, orphans, spikes, wide
from .sources.tables import table

def readings(spark: SparkSession, d: str) -> DataFrame:
    """chartevents and labs_le as attribute-value rows, the attribute being the concept."""
    items = table(spark, d, "d_items").select("itemid", "concept", "kind")
    ce = table(spark, d, "chartevents").select("stay_id", F.col("charttime").alias("t"), "itemid", F.col("valuenum").alias("num"), F.col("value").alias("raw"), F.col("storetime").alias("stored"), F.col("row_id").alias("rid"))
    le = table(spark, d, "labs_le").select("stay_id", F.col("timestp").alias("t"), "itemid", F.col("valuenum").alias("num"), F.lit(None).cast("string").alias("raw"), F.col("storetime").alias("stored"), F.col("row_id").alias("rid"))
    text = F.col("kind") == "text"
    return (
        ce.unionByName(le)
        .join(items, "itemid")
        .select("stay_id", "t", F.col("concept").alias("attribute"), F.when(~text, F.col("num")).alias("num"), F.when(text, F.trim("raw")).alias("txt"), "stored", "rid")
    )


def attributes(spark: SparkSession, d: str) -> list[wide.Attribute]:
    """The dictionary's concepts of the two tables; the dictionary is small and fixed."""
    rows = table(spark, d, "d_items").where(F.col("linksto").isin("chartevents", "labs_le")).groupBy("concept").agg(F.max(F.col("kind") == "text").alias("text")).orderBy("concept").collect()
    return [wide.Attribute(r.concept, "string" if r.text else "double") for r in rows]


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table(readings(spark, d), attributes(spark, d), "stay_id", "t").withColumnRenamed("t", "charttime_s")


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return p1_wide(spark, d).drop("conflicts")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_wide(spark, d).where(F.size("conflicts") > 0).select("stay_id", "charttime_s", F.explode("conflicts").alias("concept"))


SOURCES = ("chartevents", "labs_le")


def p2_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Every flagged row of measured items with its reasons."""
    items = table(spark, d, "d_items").where("kind = 'measured'").select("itemid", "step", "period_s")
    rows = [
        table(spark, d, name).select(F.lit(k).alias("src"), F.col("row_id").alias("rid"), F.col("stay_id").alias("e"), "itemid", F.col(t).alias("t"), F.col("valuenum").alias("v"))
        .join(items, "itemid")
        .select("src", "rid", "e", F.col("itemid").alias("i"), "t", "v", "step", F.col("period_s").alias("period"))
        for k, (name, t) in enumerate(zip(SOURCES, ("charttime", "timestp"), strict=True))
    ]
    return spikes.flag_readings(rows[0].unionByName(rows[1])).withColumn("src_table", F.element_at(F.array(*map(F.lit, SOURCES)), F.col("src") + 1))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flagged(spark, d).where("spike OR stuck").select("src_table", F.col("rid").alias("row_id"))


def p2_stuck(spark: SparkSession, d: str) -> DataFrame:
    return p2_flagged(spark, d).where("stuck").select("src_table", F.col("rid").alias("row_id"))


def _graph(spark: SparkSession, d: str) -> orphans.Graph:
    sec = lambda c: F.col(c).cast("double")
    node = lambda name, rec: orphans.Node(table(spark, d, name), rec, F.col("storetime"))
    return orphans.Graph(
        {
            "admissions": orphans.Node(table(spark, d, "admissions"), "hadm_id", sec("loadtime"), "hadm_id", sec("loadtime"), sec("deletedtime")),
            "icustays": orphans.Node(table(spark, d, "icustays"), "stay_id", sec("loadtime"), "stay_id", sec("loadtime"), sec("deletedtime")),
            "abx": node("abx", "abx_id"),
            "bacterio": node("bacterio", "bact_id"),
        },
        [
            orphans.Edge("icustays", "hadm_id", "admissions"),
            orphans.Edge("abx", "stay_id", "icustays"),
            orphans.Edge("bacterio", "stay_id", "icustays"),
            orphans.Edge("bacterio", "hadm_id", "admissions"),
        ],
    )


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_cascade(_graph(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_orphans(spark, d).where("kind = 'direct' AND src_table IN ('abx', 'bacterio')").select("src_table", "ref_col", "rec_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p3_orphans(spark, d))


def _fluid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return intervals.periods_and_pauses(table(spark, d, "fluid"), "stay_id", "starttime", "endtime")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _fluid(spark, d)[1].select("stay_id", F.col("gap_start").cast("bigint").alias("gap_start"), F.col("gap_end").cast("bigint").alias("gap_end"))


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    return _fluid(spark, d)[0]


def _to_fill(spark: SparkSession, d: str) -> DataFrame:
    """chartevents with y: the number of measured and setting items, the category's position of text items, NULL where missing."""
    items = table(spark, d, "d_items").where("kind IN ('measured', 'setting', 'text')").select("itemid", "kind", "period_s", "categories")
    word = F.lower(F.regexp_replace("value", r"^\s+|\s+$", ""))
    at = F.array_position(F.transform("categories", lambda c: F.lower(c)), word)
    y = F.when(F.col("kind") == "text", F.when(at > 0, at.cast("double"))).otherwise(F.when(~F.isnan("valuenum"), F.col("valuenum")))
    return table(spark, d, "chartevents").join(items, "itemid").select(
        F.col("row_id").alias("rid"), F.col("stay_id").alias("entity"), F.col("itemid").alias("grp"), F.col("charttime").alias("t"), F.col("period_s").cast("double").alias("period"), y.alias("y")
    )


def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    """All filled rows, with the number or the word copied and the donor."""
    rows = _to_fill(spark, d)
    items = table(spark, d, "d_items").select(F.col("itemid").alias("grp"), "kind", "categories")
    text = F.col("kind") == "text"
    return impute.mean_matching(rows).join(items, "grp").select(
        F.col("rid").alias("row_id"), F.col("grp").alias("itemid"), F.when(~text, F.col("fill")).alias("valuenum"),
        F.when(text, F.try_element_at("categories", F.col("fill").cast("int"))).alias("value"), F.col("donor_rid").alias("donor_row_id"), F.col("donor_rid").isNotNull().alias("filled"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Missing rows that a donor fills."""
    return p4_filled(spark, d).where("filled").select("row_id")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "d_items").where("kind = 'measured'").select("itemid", "period_s")
    rows = table(spark, d, "chartevents").select("stay_id", "itemid", "charttime", "valuenum").join(items, "itemid")
    return grid_fill.regular_grid(rows, "stay_id", "itemid", "charttime", "valuenum", "period_s")


def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    """The observed part of the grid."""
    return p6_grid(spark, d).where("NOT filled").select("stay_id", "itemid", "slot", F.round("value", 4).alias("value"), "n_readings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Empty slots that the regression fills: a slot without a finite prediction is no case."""
    return p6_grid(spark, d).where("filled AND value IS NOT NULL AND NOT isnan(value)").select("stay_id", "itemid", "slot")


QUERIES = {
    "p1_found": p1_found,
    "p1_wide": p1_wide,
    "p1_values": p1_values,
    "p2_found": p2_found,
    "p2_flagged": p2_flagged,
    "p2_stuck": p2_stuck,
    "p3_found": p3_found,
    "p3_orphans": p3_orphans,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_filled": p4_filled,
    "p6_found": p6_found,
    "p6_grid": p6_grid,
    "p6_cells": p6_cells,
    "p7_found": p7_found,
    "p7_periods": p7_periods,
}

_NUMBERS = ["arterial_co2_pressure", "creatinine", "dbp", "fio2", "glucose", "heart_rate", "hemoglobin", "lactate", "map", "peep", "ph_arterial", "platelets", "potassium", "respiratory_rate", "sbp", "sodium", "spo2", "temp_c", "tidal_volume", "wbc"]
_WORDS = ["heart_rhythm", "oxygen_device", "sedation_level"]

_CASCADE = """
        i AS (SELECT DISTINCT stay_id, hadm_id, epoch(loadtime) AS a, epoch(deletedtime) AS z FROM icustays),
        d AS (SELECT DISTINCT hadm_id, epoch(loadtime) AS a, epoch(deletedtime) AS z FROM admissions),
        v AS (SELECT *, hadm_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.hadm_id = i.hadm_id AND coalesce(d.a, '-infinity'::DOUBLE) <= i.a AND coalesce(d.z, 'infinity'::DOUBLE) > i.a) AS bad FROM i),
        r AS (
          SELECT 'abx' AS src_table, abx_id AS rec_id, stay_id, storetime AS seen_at FROM abx WHERE stay_id IS NOT NULL
          UNION ALL SELECT 'bacterio', bact_id, stay_id, storetime FROM bacterio WHERE stay_id IS NOT NULL),
        n AS (SELECT r.src_table, r.rec_id, r.seen_at, count(v.stay_id) AS alive, count(v.stay_id) FILTER (WHERE NOT bad) AS sound FROM r
          LEFT JOIN v ON v.stay_id = r.stay_id AND coalesce(v.a, '-infinity'::DOUBLE) <= r.seen_at AND coalesce(v.z, 'infinity'::DOUBLE) > r.seen_at GROUP BY 1, 2, 3),
        o AS (
          SELECT src_table, 'stay_id' AS ref_col, rec_id, 'icustays' AS parent_table, CASE WHEN alive = 0 THEN 'direct' ELSE 'inherited' END AS kind, CASE WHEN alive = 0 THEN 0 ELSE 1 END AS depth, seen_at FROM n WHERE sound = 0
          UNION SELECT 'icustays', 'hadm_id', stay_id, 'admissions', 'direct', 0, a FROM v WHERE bad
          UNION SELECT 'bacterio', 'hadm_id', bact_id, 'admissions', 'direct', 0, storetime FROM bacterio b WHERE hadm_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM d WHERE d.hadm_id = b.hadm_id AND coalesce(d.a, '-infinity'::DOUBLE) <= b.storetime AND coalesce(d.z, 'infinity'::DOUBLE) > b.storetime))"""

ORACLE = {
    "p3_orphans": f"WITH {_CASCADE} SELECT * FROM o",
    "p3_report": f"WITH {_CASCADE} SELECT src_table, ref_col, kind, strftime(make_timestamp(CAST(seen_at * 1000000 AS BIGINT)), '%Y-%m') AS month, count(*) AS n FROM o GROUP BY 1, 2, 3, 4",
    "p1_values": f"""
        WITH r AS (
          SELECT stay_id, CAST(charttime AS BIGINT) AS s, itemid, valuenum, value, storetime, row_id FROM chartevents
          UNION ALL SELECT stay_id, CAST(timestp AS BIGINT), itemid, valuenum, NULL, storetime, row_id FROM labs_le),
        x AS (SELECT stay_id, s, concept, CASE WHEN kind <> 'text' AND NOT isnan(valuenum) THEN valuenum END AS num, CASE WHEN kind = 'text' THEN trim(value, ' ') END AS txt,
          row_number() OVER (ORDER BY coalesce(storetime, -1e300), row_id, coalesce(valuenum, -1e300)) AS pr FROM r JOIN d_items USING (itemid) WHERE stay_id IS NOT NULL AND s IS NOT NULL AND linksto IN ('chartevents', 'labs_le'))
        SELECT stay_id, s AS charttime_s, {", ".join(f"arg_max(num, pr) FILTER (WHERE concept = '{c}' AND num IS NOT NULL) AS {c}" for c in _NUMBERS)},
          {", ".join(f"arg_max(txt, pr) FILTER (WHERE concept = '{c}' AND txt IS NOT NULL) AS {c}" for c in _WORDS)} FROM x GROUP BY 1, 2""",
    "p2_stuck": """
        WITH m AS (
          SELECT 'chartevents' AS src_table, row_id, stay_id, itemid, charttime AS t, valuenum AS v FROM chartevents UNION ALL SELECT 'labs_le', row_id, stay_id, itemid, timestp, valuenum FROM labs_le),
        u AS (SELECT m.* FROM m JOIN d_items USING (itemid) WHERE kind = 'measured' AND stay_id IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)),
        o AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS c, count(*) OVER (PARTITION BY src_table, stay_id, itemid) AS n
          FROM (SELECT DISTINCT src_table, stay_id, itemid, t, v FROM u) WINDOW w AS (PARTITION BY src_table, stay_id, itemid ORDER BY t, v)),
        g AS (SELECT *, sum(c) OVER (PARTITION BY src_table, stay_id, itemid ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS k FROM o),
        z AS (SELECT *, count(*) OVER (PARTITION BY src_table, stay_id, itemid, k) AS l FROM g)
        SELECT u.src_table, u.row_id FROM u JOIN z USING (src_table, stay_id, itemid, t, v) WHERE l >= 10 AND n >= 9""",
    "p6_cells": """
        SELECT stay_id, itemid, CAST(floor(charttime / period_s) AS BIGINT) AS slot, round(avg(valuenum), 4) AS value, count(*) AS n_readings FROM chartevents JOIN d_items USING (itemid)
        WHERE kind = 'measured' AND stay_id IS NOT NULL AND charttime IS NOT NULL AND valuenum IS NOT NULL AND NOT isnan(valuenum) GROUP BY 1, 2, 3""",
    "p1_found": """
        WITH r AS (
          SELECT stay_id, CAST(charttime AS BIGINT) AS s, itemid, valuenum FROM chartevents
          UNION ALL SELECT stay_id, CAST(timestp AS BIGINT), itemid, valuenum FROM labs_le)
        SELECT stay_id, s AS charttime_s, concept FROM r JOIN d_items USING (itemid)
        WHERE stay_id IS NOT NULL AND s IS NOT NULL AND valuenum IS NOT NULL AND NOT isnan(valuenum) AND kind <> 'text'
        GROUP BY 1, 2, 3 HAVING count(DISTINCT valuenum) > 1""",
    "p3_found": """
        SELECT 'abx' AS src_table, 'stay_id' AS ref_col, abx_id AS rec_id FROM abx a WHERE stay_id IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM icustays i WHERE i.stay_id = a.stay_id AND epoch(i.loadtime) <= a.storetime AND (i.deletedtime IS NULL OR epoch(i.deletedtime) > a.storetime))
        UNION ALL
        SELECT 'bacterio', 'stay_id', bact_id FROM bacterio a WHERE stay_id IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM icustays i WHERE i.stay_id = a.stay_id AND epoch(i.loadtime) <= a.storetime AND (i.deletedtime IS NULL OR epoch(i.deletedtime) > a.storetime))
        UNION ALL
        SELECT 'bacterio', 'hadm_id', bact_id FROM bacterio a WHERE hadm_id IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM admissions i WHERE i.hadm_id = a.hadm_id AND epoch(i.loadtime) <= a.storetime AND (i.deletedtime IS NULL OR epoch(i.deletedtime) > a.storetime))""",
    "p4_found": r"""
        SELECT row_id FROM chartevents JOIN d_items USING (itemid)
        WHERE (kind IN ('measured', 'setting') AND (valuenum IS NULL OR isnan(valuenum)))
           OR (kind = 'text' AND (value IS NULL OR NOT list_contains(list_transform(categories, lambda c: lower(c)), lower(regexp_replace(value, '^\s+|\s+$', '', 'g')))))""",
    "p6_found": """
        WITH s AS (
          SELECT DISTINCT stay_id, itemid, period_s, CAST(floor(charttime / period_s) AS BIGINT) AS slot FROM chartevents JOIN d_items USING (itemid)
          WHERE kind = 'measured' AND stay_id IS NOT NULL AND charttime IS NOT NULL AND valuenum IS NOT NULL AND NOT isnan(valuenum)),
        n AS (SELECT *, lead(slot) OVER (PARTITION BY stay_id, itemid ORDER BY slot) AS nxt FROM s)
        SELECT stay_id, itemid, CAST(unnest(range(slot + 1, nxt)) AS BIGINT) AS slot FROM n WHERE nxt - slot > 1 AND (nxt - slot) * period_s <= 8640000""",
    "p7_found": """
        WITH f AS (SELECT DISTINCT stay_id, starttime, endtime FROM fluid WHERE stay_id IS NOT NULL AND endtime > starttime),
        g AS (SELECT stay_id, starttime, max(endtime) OVER (PARTITION BY stay_id ORDER BY starttime, endtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
        SELECT stay_id, CAST(reach AS BIGINT) AS gap_start, CAST(starttime AS BIGINT) AS gap_end FROM g WHERE starttime > reach""",
    "p7_periods": """
        WITH f AS (SELECT DISTINCT stay_id, starttime, endtime FROM fluid WHERE stay_id IS NOT NULL AND endtime > starttime),
        g AS (SELECT *, max(endtime) OVER (PARTITION BY stay_id ORDER BY starttime, endtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
        h AS (SELECT *, sum(CASE WHEN reach IS NULL OR starttime > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stay_id ORDER BY starttime, endtime ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT stay_id, min(starttime) AS period_start, max(endtime) AS period_end FROM h GROUP BY stay_id, k""",
}
