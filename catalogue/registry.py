"""Register of the queries, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables hold no nulls, so both engines make the same gaps.
LINEITEM_COLUMNS = {
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
    "l_linenumber": "l_linenumber",
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END",
    "l_tax": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax END",
    "l_returnflag": "l_returnflag",
    "l_linestatus": "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_linestatus END",
}
LINEITEM_GAPS = ", ".join(f"{e} AS {c}" for c, e in LINEITEM_COLUMNS.items())
LINEITEM_SQL = f"(SELECT {LINEITEM_GAPS} FROM lineitem)"
LINEITEM_NUMBERS = [c for c in LINEITEM_COLUMNS if c not in ("l_returnflag", "l_linestatus")]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in LINEITEM_COLUMNS.items()])


EVENT_GAPS = "event_id, user_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, event_type"
EVENTS_SQL = f"(SELECT {EVENT_GAPS} FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value", "event_type"
    )
