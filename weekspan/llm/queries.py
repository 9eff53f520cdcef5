"""The registered queries of this subpackage: each applies one operator to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekspan.llm import filters, lm, negatives, pii, quality, sql
from weekspan.llm.decontaminate import scan
from weekspan.llm.embeddings import near_duplicates
from weekspan.llm.jaccard import link
from weekspan.llm.language import identify, learn
from weekspan.llm.packing import pack
from weekspan.llm.sharding import interleave
from weekspan.llm.substrings import remove_repeats
from weekspan.llm.textbatch import key_remainder, table
from weekspan.llm.warc import read_archives, write_archives
from weekspan.session import scratch_path


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = F.coalesce(key_remainder("doc_id", 4) == 2, F.lit(False))
    model = learn(documents.filter(~held_out))
    found = identify(documents.select("doc_id", "text"), model, kept=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    remainder = key_remainder("doc_id", 5)
    field = quality.learn(documents, table(spark, folder, "labels").filter(remainder != 0))
    found = quality.score_documents(documents.select("doc_id", "text"), field, kept=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return link(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    records = read_archives(spark, path, with_payload=False)
    number = lambda c: F.expr(f"try_cast({c} as long)")  # noqa: E731  the key of a null page id is no number
    return records.select(number("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), kept=["doc_id"])
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op7_attention(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), key_remainder("doc_id", 10) == 0)


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), digest=True)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return interleave(table(spark, folder, "documents"))


def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_filters(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    marks = labels.select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filters.audit(filters.fail_masks(table(spark, folder, "documents")), marks, ["good", "toxic"])


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.learn(documents), kept=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("pii").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_attention": op7_attention,
    "op8_substrings": op8_substrings,
    "op9_sharding": op9_sharding,
    "op10_embeddings": op10_embeddings,
    "op11_negatives": op11_negatives,
    "op12_filters": op12_filters,
    "op13_pii": op13_pii,
}


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(sql.ORACLES)
