"""A corpus made ready for training: language, near duplicates, repeated passages, benchmark passages, packing.

Each stage is a function of (spark, documents, folder of tables) that applies one operator to all it is given; all but
the last return the columns of ``documents``. ``run`` writes what a stage returns as Parquet below the shared folder and
reads it again for the next, so lost executors cost one stage at most.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns are handled as the operators define: texts
without a letter have no language and go; a null key is larger than all others; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekspan.llm import decontaminate, jaccard, language, packing, substrings
from weekspan.llm.textbatch import fresh, key_remainder, table
from weekspan.session import scratch_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is identified; the language is learned as for the registered query."""
    held_out = F.coalesce(key_remainder("doc_id", 4) == 2, F.lit(False))
    return language.keep_known(docs, language.learn(docs.filter(~held_out)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, without the passages that one with a smaller doc_id holds; n_chars follows the text."""
    own = [c for c in docs.columns if c.lower() in ("n_words", "n_removed")]
    spare = dict(zip(own, fresh(docs, *own, "n_words", "n_removed"), strict=False))
    cut = substrings.remove_repeats(docs.withColumnsRenamed(spare))
    length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    cut = cut.withColumn("n_chars", length)
    return cut.select(*[F.col(f"`{spare.get(c, c)}`").alias(c) for c in docs.columns])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"), remove=decontaminate.DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language identification", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring deduplication", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack_sequences),
]

#: Language identification is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
