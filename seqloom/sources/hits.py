"""Search results: twelve-column text and nested XML."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import HITS

_COLUMNS = [tuple(c.split()) for c in HITS.split(", ")]


def parse_tabular(lines: DataFrame, value_col: str = "value", strict: bool = True) -> DataFrame:
    """Whitespace-separated lines as HITS rows; fewer than twelve fields or a bad number is an error if ``strict``,
    else the line is passed over. Blank lines are always passed over."""
    part = F.split(F.trim(F.col(value_col)), r"\s+")
    rows = lines.where(F.trim(F.col(value_col)) != "").select(F.col(value_col).alias("line"), part.alias("p"))
    cells = [F.try_element_at("p", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(_COLUMNS)]
    rows = rows.select("line", F.size("p").alias("n"), *cells)
    good = F.col("n") >= 12
    for name, _ in _COLUMNS:
        good = good & F.col(name).isNotNull()
    if not strict:
        return rows.where(good).select(*(n for n, _ in _COLUMNS))
    first, *rest = (n for n, _ in _COLUMNS)
    checked = F.when(good, F.col(first)).otherwise(F.raise_error(F.concat(F.lit("bad hit line: "), F.col("line"))))
    return rows.select(checked.alias(first), *rest)


def read_tabular(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_tabular(spark.read.text(path), strict=strict)


def write_tabular(hits: DataFrame, path: str, mode: str = "errorifexists") -> None:
    hits.select(*(n for n, _ in _COLUMNS)).write.mode(mode).option("sep", "\t").csv(path)


_ITERATION = "`Iteration_query-def` string, Iteration_hits struct<Hit: array<struct<Hit_num: int, Hit_accession: string, Hit_hsps: struct<Hsp: array<struct<Hsp_num: int, Hsp_evalue: double, `Hsp_query-from`: int, `Hsp_query-to`: int, `Hsp_hit-from`: int, `Hsp_hit-to`: int>>>>>>"
XML_SCHEMA = "BlastOutput_iterations struct<Iteration: array<struct<" + _ITERATION.replace("` string", "`: string").replace("hits struct", "hits: struct") + ">>>"


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, hit_num, accession, hsp_num, evalue, q_start, q_end, hit_start, hit_end``: one row an alignment.

    An iteration (one query) is a row, so a file is read by many tasks.
    """
    return flatten_iterations(spark.read.format("xml").option("rowTag", "Iteration").schema(_ITERATION).load(path).select(F.struct("*").alias("i")))


def parse_xml(df: DataFrame, value_col: str) -> DataFrame:
    """The same from a column of XML texts."""
    return flatten_xml(df.select(F.from_xml(F.col(value_col), XML_SCHEMA).alias("x")).select("x.*"))


def flatten_xml(df: DataFrame) -> DataFrame:
    return flatten_iterations(df.select(F.explode("BlastOutput_iterations.Iteration").alias("i")))


def flatten_iterations(rows: DataFrame) -> DataFrame:
    rows = rows.select(F.col("i.`Iteration_query-def`").alias("query_id"), F.explode("i.Iteration_hits.Hit").alias("h"))
    rows = rows.select("query_id", F.col("h.Hit_num").alias("hit_num"), F.col("h.Hit_accession").alias("accession"), F.explode("h.Hit_hsps.Hsp").alias("s"))
    return rows.select("query_id", "hit_num", "accession", F.col("s.Hsp_num").alias("hsp_num"), F.col("s.Hsp_evalue").alias("evalue"), F.col("s.`Hsp_query-from`").alias("q_start"), F.col("s.`Hsp_query-to`").alias("q_end"), F.col("s.`Hsp_hit-from`").alias("hit_start"), F.col("s.`Hsp_hit-to`").alias("hit_end"))
