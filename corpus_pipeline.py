"""The document pipeline: quality, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenframe.llm import decontaminate, packing, quality, secret_scan, similar_texts
from lumenframe.llm.queries import remainder
from lumenframe.llm.shared import drop, keep, read_table, scratch, shared_path
from lumenframe.llm.tokens import default_tokenizer

SHINGLE, SIMILARITY = 5, 0.8  # texts whose sets of five-word shingles agree so far are near-duplicates here
NEAR_BITS = 6  # fingerprints that differ in so many bits at most are proposed by the trees of op1_simhash

#: Trees, sketches and packing have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def _plain_names(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """Other columns than those used under names that clash with nothing, and the columns that give the table back."""
    names = {c: c if c in used else f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns as the query of its operator does.

    Null and empty texts are judged as texts without words; repeated rows alike; all columns come back as they are.
    Without any labelled row nothing can be learnt, which is an error.
    """
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    plain, back = _plain_names(docs, "doc_id", "text")
    trees = quality.train(plain, labels, usable=remainder(5) != 0)
    return quality.score(plain, trees).where(F.col("quality_score") >= quality.THRESHOLD).select(*back)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows are told apart by doc_id and text, repeated rows count as one.

    The one of smallest doc_id stays (null first; under one doc_id, that of smallest text digest). Texts without words,
    null ones too, are one group; all columns come back as they are. The BK-trees over SimHash fingerprints propose, the true
    similarity decides; pairs that fingerprints cannot show are found by MinHash and rare shingles among what is left apart.
    """
    plain, back = _plain_names(docs, "doc_id", "text")
    single = keep(plain.dropDuplicates(["doc_id", "text"]).withColumn("key", F.monotonically_increasing_id()), "numbered")
    groups = similar_texts.similar_texts(
        single.select(F.col("key").alias("doc_id"), "text"), SHINGLE, SIMILARITY, NEAR_BITS)
    order = F.struct("doc_id", F.xxhash64("text"), "key")
    chosen = single.select("key", order.alias("order")).join(
        groups.withColumnRenamed("doc_id", "key"), "key").groupBy("component_id").agg(F.min("order")["key"].alias("key"))
    return single.join(chosen, "key", "left_semi").select(*back)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, repeated rows are treated alike."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials that look live replaced; their lengths follow.

    Owners are told by ``source``, which must be there; a null one is an owner of its own. Null texts stay null.
    """
    clean = secret_scan.redact(docs, secret_scan.copied_examples(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; a null or empty text is one end token, every row is packed."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("benchmarks", free_of_benchmarks),
          ("secrets", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder, which the next one reads.

    What a stage keeps for itself goes when its result is written, and a result when the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
