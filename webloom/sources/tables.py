"""The engine's tables: created where they are missing, never replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom import schemas

TABLES = {
    "frontier": (schemas.FRONTIER, "status"),
    "points": (schemas.POINT, None),
    "snapshots": ("url string, fetch_time bigint, is_current boolean, pages array<struct<page:bigint,text:string>>, links array<string>, domain string", "domain"),
    "link_edges": ("source string, target string", None),
    "robots": ("domain string, txt string", None),
}


def ensure(spark: SparkSession, name: str, table: str | None = None) -> DataFrame:
    """The table ``table`` (``name`` unless given) with the schema of ``name``, made if it does not exist."""
    schema, partition = TABLES[name]
    by = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table or name} ({schema}) USING parquet{by}")
    return spark.table(table or name)
