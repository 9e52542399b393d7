"""Numbered problems on training text over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import leakage, mixing, nearest, shared_spans

TOLERANCE_S = 259_200.0


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_in_time(table(spark, d, "abx"), table(spark, d, "bacterio"), "stay_id", "abx_id", "starttime", "bact_id", "charttime", TOLERANCE_S).select("abx_id", "bact_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("item_id", "doc_id")


def tokenizer(spark: SparkSession) -> str:
    """The rank file of the public tokenizer: spark.tidegrid.tokenizer, or where this box has it."""
    return spark.conf.get("spark.tidegrid.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=tokenizer(spark))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=tokenizer(spark))[1]


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shared(spark, d).where("shared_chars > 0").select("doc_id")


QUERIES = {
    "p5_found": p5_found,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shared": p10_shared,
}

ORACLE = {
    "p5_found": """
        SELECT abx_id, bact_id FROM (
          SELECT a.abx_id, b.bact_id, row_number() OVER (PARTITION BY a.abx_id ORDER BY abs(a.starttime - b.charttime), b.charttime, b.bact_id) AS r
          FROM abx a JOIN bacterio b ON a.stay_id = b.stay_id AND abs(a.starttime - b.charttime) <= 259200) WHERE r = 1""",
    "p10_found": """
        WITH w AS (SELECT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
        SELECT DISTINCT doc_id FROM w JOIN s USING (h)""",
}
