"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

quality       documents that the co-trained classifier rejects go
near_copies   of each group of documents linked by 5-word shingles at 80 % one stays, the one with the smallest doc_id
secrets       secrets and linked credential parts are masked in place
mixture       sources are mixed to their target weights; documents repeat or pause as the weights ask; rows come shard by shard, shuffled inside
packing       the mixture is cut and packed into sequences of 2048 tokens; the rows hold the token ids and their places
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import free_name, query, table, work_path
from cubeloom.llm.credentials import mask_secrets
from cubeloom.llm.jaccard import similar_documents
from cubeloom.llm.mixing import mix
from cubeloom.llm.packing import pack
from cubeloom.llm.quality import keep_good
from cubeloom.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


#: The pipeline's own rule for near copies; the query op4_jaccard has another.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an id cannot be named as a copy and stay; equal rows of one id stay once."""
    ship_package(spark)
    found = similar_documents(docs, words=SHINGLE_WORDS, percent=NEAR_PERCENT)
    # the smaller side: the ids that go
    lost, mark = free_name("_gone", docs.columns), free_name("_text", docs.columns)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(lost)).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(lost), "left_anti")
    again = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        return kept.select(*docs.columns)
    named = kept.filter("doc_id IS NOT NULL").withColumn(mark, F.md5("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return named.unionByName(kept.filter("doc_id IS NULL")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mask_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows keep the order of mix(): whole shards in a partition, each by its places."""
    ship_package(spark)
    return mix(docs).select(*docs.columns)


#: Words a worker keeps; fewer than when packing runs alone, as the stages before leave their memory in use.
WORDS = 100_000


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship_package(spark)
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), entries=WORDS, frugal=True)
    return packed.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]
#: The classifier has no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
