"""The table of queries, and the frames and SQL that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.sources.lines import lines_from_column

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents."""
    return lines_from_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def order_records(spark: SparkSession, sf_dir: str, delimiter: str = "\t") -> DataFrame:
    """A delimited line for each order, fifty orders a source."""
    parts = [F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")]
    return table(spark, sf_dir, "orders").select((F.floor(F.col("o_orderkey") / 50)).alias("src"), (F.col("o_orderkey") % 50 + 1).alias("line_no"), F.concat_ws(delimiter, *parts).alias("line"))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank-padded line for each part."""
    line = F.concat(F.lit("  "), F.col("p_name"), F.lit("\t "), F.col("p_brand"), F.lit("   "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 50)).alias("src"), (F.col("p_partkey") % 50 + 1).alias("line_no"), line.alias("line"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each event as a line, by user in order of event number."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))


#: The frames above in DuckDB; a query's SQL goes on from here.
LINES = """WITH lines AS (SELECT doc_id AS src, i AS line_no, string_split(text, chr(10))[i] AS line FROM documents,
LATERAL unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)) """
ORDERS = """WITH lines AS (SELECT CAST(floor(o_orderkey / 50.0) AS BIGINT) AS src, CAST(o_orderkey % 50 + 1 AS BIGINT) AS line_no,
concat_ws({d}, CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)) AS line FROM orders) """
TABBED, COMMAED = ORDERS.format(d="chr(9)"), ORDERS.format(d="','")
PARTS = """WITH lines AS (SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS src, CAST(p_partkey % 50 + 1 AS BIGINT) AS line_no,
'  ' || p_name || chr(9) || ' ' || p_brand || '   ' || CAST(p_size AS VARCHAR) AS line FROM part) """
EVENTS = "WITH lines AS (SELECT user_id AS src, event_id AS line_no, event_type AS line FROM events) "
