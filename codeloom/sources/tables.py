"""Append-only logs, the stored queue and keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import ACTION, TABLES


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table; columns added over time appear as null in older files."""
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")


def append_log(rows: DataFrame, folder: str, table: str) -> None:
    """Append rows, keeping only the table's columns and filling absent ones with null."""
    shaped = rows.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in TABLES[table].fields
        ]
    )
    shaped.write.mode("append").parquet(f"{folder}/{table}")


def only_columns(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Patch rows reduced to the columns that may be changed."""
    return rows.select(*[c for c in rows.columns if c in allowed])


def optional_eq(df: DataFrame, column: str, value=None) -> DataFrame:
    """Filter only when a value is given, so that the scan still sees a plain predicate."""
    return df if value is None else df.filter(F.col(column) == value)


def flag_filter(df: DataFrame, flag: bool, condition: Column) -> DataFrame:
    return df.filter(condition) if flag else df


def read_queue(reviews: DataFrame, action_schema: T.StructType = ACTION) -> tuple[DataFrame, DataFrame]:
    """(pending reviews with a typed action, oldest first; rows that did not parse)."""
    shape = T.StructType([*action_schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = reviews.filter(F.col("status") == "pending").withColumn(
        "action",
        F.from_json("action_data", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    bad = F.col("action").isNull() | F.col("action._corrupt").isNotNull() | F.col("action.target").isNull()
    good = (
        parsed.filter(~bad)
        .withColumn("action", F.col("action").dropFields("_corrupt"))
        .drop("action_data")
        .orderBy("created_at", "id")
    )
    return good, parsed.filter(bad).select("id", "action_data")


def lookup_rows(table: DataFrame, key: str, value=None, keys: DataFrame | None = None) -> DataFrame:
    """One row by key, or all rows whose key is in another table."""
    if keys is not None:
        return table.join(keys.select(key).distinct(), key, "left_semi")
    return table.filter(F.col(key) == value)


def with_json(table: DataFrame, columns: dict[str, T.DataType | str]) -> DataFrame:
    """Parse JSON text columns to typed ones."""
    return table.withColumns({name: F.from_json(F.col(name), kind) for name, kind in columns.items()})


def latest_backup(log: DataFrame) -> DataFrame:
    """Newest backup of every original path."""
    return log.groupBy("original").agg(
        F.max_by("backup", F.struct("timestamp", "backup")).alias("backup"),
        F.max("timestamp").alias("timestamp"),
        F.count(F.lit(1)).alias("versions"),
    )
