"""Learner logs derived from a star schema with an event stream.

The short view reads the event stream (dense, one month), the long view reads orders and line items (sparse, seven
years). Both give the same three raw tables as ``sources.logs.read_raw_logs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekspan.functions.scalars import DAY_MICROS, micros_between
from weekspan.functions.skew import ROWS_PER_TASK
from weekspan.session import durable
from weekspan.sources.logs import Logs

SESSION_GAP_MICROS = DAY_MICROS // 4
HOUR_MICROS = DAY_MICROS // 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("*", "cast(get_json_object(props, '$.k') as bigint) as k")


def short_transactions(spark: SparkSession, folder: str) -> DataFrame:
    purchases = _stream(spark, folder).filter("event_type = 'purchase'")
    return purchases.selectExpr(
        "event_id as transaction_id",
        "user_id",
        "ts as start_time",
        "timestampadd(MICROSECOND, cast(round((value * 30 - 60) * 1000000) as bigint), ts) as commit_time",
        "element_at(array('CORRECT', 'PARTIAL', 'WRONG', 'CORRECT', null), cast(k % 5 + 1 as int)) as evaluation",
        "k as document_id",
        "k % 7 as topic_id",
        "k % 3 as challenge_id",
    )


def time_slices(df: DataFrame, ts: str, rows_a_slice: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``_hour``: the start in microseconds of the row's hour, or of an equal part of it where the user has more than
    ``rows_a_slice`` rows in that hour; the list of such hours has at most rows / ``rows_a_slice`` entries."""
    at = F.col(ts).cast("timestamp")
    micros, hour = F.unix_micros(at), F.unix_micros(F.date_trunc("hour", at))
    hours = df.withColumn("_start", hour)
    sizes = hours.groupBy("user_id", "_start").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_a_slice)
    parts = sizes.select("user_id", "_start", F.ceil(F.col("_n") / rows_a_slice).alias("_parts"))
    width = F.floor(F.lit(HOUR_MICROS) / F.coalesce("_parts", F.lit(1))).cast("long")
    cut = hours.join(F.broadcast(parts), ["user_id", "_start"], "left")
    return cut.withColumn("_hour", F.col("_start") + F.floor((micros - F.col("_start")) / width) * width).drop("_start", "_parts")


def number_sessions(df: DataFrame, ts: str, tie: str, gap_micros: int, rows_a_slice: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``sid``: 1 for a user's first row, one more after every pause longer than ``gap_micros``.

    Rows are ordered inside user-hours, or parts of them (``time_slices``); the slices of a user are then chained by
    their first and last time and their number of pauses, so a very active user is spread over as many tasks as they have
    slices. Rows of one user at the same microsecond stay together.
    """
    hours = time_slices(df, ts, rows_a_slice)
    inside = Window.partitionBy("user_id", "_hour").orderBy(ts, tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    pause = (micros_between("_before", ts) > gap_micros).cast("int")
    rows = hours.withColumn("_before", F.lag(ts).over(inside)).withColumn("_new", F.coalesce(pause, F.lit(0)))
    rows = durable(rows.withColumn("_sum", F.sum("_new").over(upto)), "hours")  # read by the chain and by the result
    per_hour = rows.groupBy("user_id", "_hour").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_new").alias("_inner")
    )
    by_hour = Window.partitionBy("user_id").orderBy("_hour")
    opens = F.when(micros_between(F.lag("_last").over(by_hour), "_first") <= gap_micros, 0).otherwise(1)
    before = F.sum(F.col("_opens") + F.col("_inner")).over(by_hour.rowsBetween(Window.unboundedPreceding, -1))
    chained = per_hour.withColumn("_opens", opens).select(
        "user_id", "_hour", (F.col("_opens") + F.coalesce(before, F.lit(0))).alias("_offset")
    )
    return (
        rows.join(chained, ["user_id", "_hour"])
        .withColumn("sid", F.col("_sum") + F.col("_offset"))
        .drop("_hour", "_before", "_new", "_sum", "_offset")
    )


def short_events(spark: SparkSession, folder: str) -> DataFrame:
    """Everything but purchases, with sessions cut at pauses of more than six hours."""
    stream = _stream(spark, folder).filter("event_type <> 'purchase'").drop("props", "value")
    return number_sessions(stream, "ts", "event_id", SESSION_GAP_MICROS).selectExpr(
        "event_id",
        "user_id",
        "ts as event_date",
        "upper(event_type) as event_type",
        "case event_type when 'view' then 'REVIEW_TASK' when 'click' then 'SUBMIT_ANSWER' when 'signup' then 'OPEN_TOPIC' end as action",
        "case when event_type <> 'error' then concat(user_id, '-', sid) end as session_id",
        "case when k % 10 <> 0 then k % 13 end as topic_id",
    )


def star_users(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").selectExpr("n_nationkey as c_nationkey", "n_name")
    school = "element_at(array('Gymnasium', 'WMS', 'BM', 'KME Passerelle'), cast(c_custkey % 4 + 1 as int))"
    return (
        table(spark, folder, "customer")
        .join(nation, "c_nationkey", "left")
        .selectExpr(
            "c_custkey as user_id",
            "case c_mktsegment when 'BUILDING' then 'FEMALE' when 'AUTOMOBILE' then 'MALE' when 'HOUSEHOLD' then 'STAR' "
            "when 'FURNITURE' then '*' end as gender",
            "case when c_acctbal >= 0 then n_name end as canton",
            f"case when c_custkey % 11 <> 0 then concat({school}, ' - ', c_custkey % 5 + 1, '. Jahr') end as class_level",
            "case when c_custkey % 6 <> 0 then concat('c', c_custkey % 40) end as class_id",
            "case c_custkey % 3 when 0 then 'True' when 1 then 'False' end as study",
        )
    )


def long_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as event_id",
        "o_custkey as user_id",
        "o_orderdate as event_date",
        "case o_orderstatus when 'O' then 'CLICK' when 'F' then 'VIEW' else 'OTHER' end as event_type",
        "case o_orderpriority when '1-URGENT' then 'REVIEW_TASK' when '5-LOW' then null else 'SUBMIT_ANSWER' end as action",
        "cast(o_orderkey % 997 as string) as session_id",
        "o_orderkey % 17 as topic_id",
    )


def long_transactions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey", "o_orderdate")
    return (
        table(spark, folder, "lineitem")
        .join(orders, "l_orderkey")
        .selectExpr(
            "l_orderkey * 10 + l_linenumber as transaction_id",
            "o_custkey as user_id",
            "o_orderdate as start_time",
            "timestampadd(SECOND, cast(round(l_quantity * 100) as bigint), o_orderdate) as commit_time",
            "case when l_linestatus = 'O' and l_returnflag = 'A' then null when l_returnflag = 'N' then 'CORRECT' "
            "when l_returnflag = 'A' then 'PARTIAL' else 'WRONG' end as evaluation",
            "l_partkey as document_id",
            "l_suppkey % 23 as topic_id",
            "l_orderkey as challenge_id",
        )
    )


def short_view(spark: SparkSession, folder: str) -> Logs:
    return Logs(star_users(spark, folder), short_events(spark, folder), short_transactions(spark, folder))


def long_view(spark: SparkSession, folder: str) -> Logs:
    return Logs(star_users(spark, folder), long_events(spark, folder), long_transactions(spark, folder))


def scored_view(spark: SparkSession, folder: str) -> DataFrame:
    """One scored row per labelled document: true label, probability, prediction and group columns."""
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "lang", "source", "round(n_chars / (n_chars + 500D), 6) as y_prob"
    )
    return documents.join(table(spark, folder, "labels"), "doc_id").selectExpr(
        "doc_id as user_id",
        "quality as y_true",
        "y_prob",
        "cast(y_prob > 0.5D as int) as y_pred",
        "lang as gender",
        "source as canton",
        "toxic",
    )


def clusters_view(spark: SparkSession, folder: str) -> DataFrame:
    """One assigned row per order with three partitions, two attributes and an outcome."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as row_index",
        "o_custkey as user_id",
        "o_custkey % 4 as spectral_eucl",
        "o_orderkey % 4 as kmeans_flat",
        "(o_custkey % 4 + if(o_orderkey % 5 = 0, 1, 0)) % 4 as kmeans_eucl",
        "o_orderpriority as gender",
        "o_orderstatus as school_type",
        "cast(o_totalprice > 200000 as int) as is_dropout_point",
    )


def vectors_view(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as vector", "label")
