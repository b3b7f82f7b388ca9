"""A training corpus from raw documents, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir), keeps the columns of documents (the last one gives token ids) and works on all
that its predecessor kept. Ids identify documents. Defined results: documents with a null id are scored and encoded as others are and never taken as
duplicates; null texts count as empty; of rows that repeat an id the deduplication keeps one of each group of near duplicates; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm import bpe, mixing, quality, secret_scan, shingle_join
from basalt.llm.common import cut, table

#: Near duplicates: shingles of five words, a Jaccard similarity of 0.8.
WORDS, PERCENT = 5, 80
BROADCAST_IDS = 500_000


def drop_low_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, gives at least 0.5."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    kept = scored.where("score >= 0.5")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; where rows of that id are in the group, that with the least set key."""
    found = shingle_join.shingle_labels(docs, words=WORDS, percent=PERCENT).where("id is not null")
    groups = found.groupBy("id", "component").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("key"), F.min("component_id").alias("least"))
    sets = F.collect_list(F.when(F.col("id") == F.col("least"), F.coalesce("key", F.lit(b""))))
    of = groups.groupBy(F.col("id").alias("k")).agg(F.sum("rows").alias("rows"), sets.alias("sets")).where(F.size("sets") > 0)
    stay = cut(of.select("k", "rows", F.when(F.col("rows") > 1, F.col("sets")).alias("sets")))
    small = stay.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(stay) if small else stay, F.col("doc_id") == F.col("k"))
    once = kept.where("rows = 1").select(docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id", "set_key").orderBy(F.xxhash64("text")))
    several = shingle_join.with_set_key(kept.where("rows > 1"), words=WORDS).where(F.array_contains("sets", F.col("set_key")))
    repeated = several.withColumn("nth", nth).where("nth = 1").select(docs.columns)
    return once.unionByName(repeated).unionByName(docs.where("doc_id is null"))


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row."""
    import public_tokenizers

    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: No stage can be told in SQL: tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """documents through all stages; what the last but one keeps is computed once for each stage that reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
