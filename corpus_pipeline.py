"""A training corpus in four stages: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.

A null text counts as empty: it has a quality score like any other, is rejected as having no language, and so isn't
packed. A null doc_id is a number of its own. Repeated rows are one document after the near-duplicate stage. An empty
table stays empty. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_table
from quarry.llm.jaccard import NO_ID, digest, link_classes
from quarry.llm.languages import fit_languages, predict_languages
from quarry.llm.packing import pack_pieces, token_pieces
from quarry.llm.quality import fit_quality, score_quality
from quarry.shipping import ship

#: A document stays with at least this probability of label 1, with this share of its letters in one language (two
#: equal parts have 0.5), and with this evidence that its letters are of the languages learned at all.
LEAST_QUALITY, LEAST_LANGUAGE, LEAST_EVIDENCE = 0.3, 0.6, 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``LEAST_QUALITY``."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs, labels, F.lit(True))
    named = docs.withColumnsRenamed({c: f"_{k}" for k, c in enumerate(docs.columns)}).withColumn("text", F.col(f"_{docs.columns.index('text')}"))
    scored = score_quality(named, model, [f"_{k}" for k in range(len(docs.columns))])
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one language and like that language's texts; the model learns from the rows with a lang."""
    ship(spark)
    model = fit_languages(docs, F.lit(True))
    named = docs.withColumnsRenamed({c: f"_{k}" for k, c in enumerate(docs.columns)}).withColumn("text", F.col(f"_{docs.columns.index('text')}"))
    found = predict_languages(named, model, keep=[f"_{k}" for k in range(len(docs.columns))], with_evidence=True)
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE) & (F.col("evidence") >= LEAST_EVIDENCE)
    return found.filter(sure).select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near-duplicate links connect: the one with the smallest doc_id, then the least digest.

    Copies are a group, repeated rows too. A text without words links with nothing and stays, once a doc_id.
    """
    ship(spark)
    classes = shared_table(link_classes(docs, with_class=True), "classes")
    first = classes.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.min(F.struct("doc_id", "digest")).alias("row")).select("row.*")
    kept = first.union(classes.filter("class_id IS NULL").select("doc_id", "digest")).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct()
    named = docs.withColumnsRenamed({c: f"_{k}" for k, c in enumerate(docs.columns)}).withColumn("text", F.col(f"_{docs.columns.index('text')}"))
    rows = named.withColumns({"_doc": F.col(f"_{docs.columns.index('doc_id')}").cast("long"), "_digest": digest()}).drop("text")
    same = (F.coalesce(rows["_doc"], F.lit(NO_ID)) == F.coalesce(kept["_doc"], F.lit(NO_ID))) & (rows["_digest"] == kept["_digest"])
    out = rows.join(kept, same, "left_semi").dropDuplicates(["_doc", "_digest"])
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, with sequence and offset."""
    import public_tokenizers

    ship(spark)
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Classifiers and packing can't be expressed in SQL; tests hold each stage against a plain version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, f"stage-{name}")
    return docs
