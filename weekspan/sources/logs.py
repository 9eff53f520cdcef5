"""Reading and writing learner logs and derived tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("canton", T.StringType()),
        T.StructField("class_level", T.StringType()),
        T.StructField("class_id", T.StringType()),
        T.StructField("study", T.StringType()),
    ]
)
# Timestamps are read as text: cleaning turns unreadable ones into null.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("topic_id", T.LongType()),
    ]
)
TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("commit_time", T.StringType()),
        T.StructField("evaluation", T.StringType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("topic_id", T.LongType()),
        T.StructField("challenge_id", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Logs:
    """Users, events and transactions, raw or cleaned."""

    users: DataFrame
    events: DataFrame
    transactions: DataFrame


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns are matched by header name, so files may order them differently or carry more of them."""
    header = spark.read.option("header", True).csv(path).columns
    typed = {f.name: f for f in schema}
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(as_text).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in typed.values()])


def read_raw_logs(spark: SparkSession, folder: str, suffix: str = ".csv.gz") -> Logs:
    """The three raw files of ``folder``. Gzip files cannot be split: ingest them once with ``save_table``."""
    return Logs(
        users=_read_csv(spark, f"{folder}/users{suffix}", USERS),
        events=_read_csv(spark, f"{folder}/events{suffix}", EVENTS),
        transactions=_read_csv(spark, f"{folder}/transactions{suffix}", TRANSACTIONS),
    )


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table; the suffix picks the format: .csv, .csv.gz, .json, otherwise Parquet."""
    writer = df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv.gz"):
        writer.option("header", True).option("compression", "gzip").csv(path)
    elif path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.parquet(path)


def load_table(spark: SparkSession, path: str, required: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """Read a saved table and fail early when required columns are absent."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith((".csv", ".csv.gz")):
        df = reader.option("header", True).csv(path)
    elif path.endswith(".json"):
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return require_columns(df, required)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"table lacks required columns: {absent}")
    return df


ASSIGNMENT_COLUMNS = (
    "user_id",
    "end_week",
    "is_dropout_point",
    "spectral_eucl",
    "spectral_agg",
    "kmeans_flat",
    "kmeans_eucl",
)


def select_assignments(df: DataFrame, reference: str = "spectral_eucl", cluster_col: str = "cluster_spectral_eucl",
                       outcome_col: str = "stage2_outcome") -> DataFrame:
    """Saved cluster assignments with the reference method renamed and the outcome coerced to a number."""
    kept = [c for c in ASSIGNMENT_COLUMNS if c in df.columns]
    require_columns(df, ["user_id", "is_dropout_point", reference])
    return (
        df.select(*kept)
        .withColumnRenamed(reference, cluster_col)
        .withColumn(outcome_col, F.col("is_dropout_point").try_cast("double"))
    )


def export_tables(tables: dict[str, DataFrame], folder: str, suffix: str = ".parquet") -> dict[str, str]:
    """Write each table to ``folder/<name><suffix>`` and return the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}{suffix}"
        save_table(df, paths[name])
    return paths


def save_feature_lists(spark: SparkSession, lists: dict[str, Sequence[str]], path: str) -> None:
    """Ordered feature-column lists as one small JSON table (list, position, name)."""
    rows = [(name, i, c) for name, cols in lists.items() for i, c in enumerate(cols)]
    save_table(spark.createDataFrame(rows, "list string, position int, name string").coalesce(1), path)


def load_feature_lists(spark: SparkSession, path: str) -> dict[str, list[str]]:
    schema = "list string, position int, name string"
    out: dict[str, list[str]] = {}
    for r in spark.read.schema(schema).json(path).orderBy("list", "position").collect():
        out.setdefault(r["list"], []).append(r["name"])
    return out
