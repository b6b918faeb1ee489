"""A training corpus from raw documents in five stages; each works on all rows that the stage before it kept.

Every stage but the last returns the columns of documents, whatever they are. A stage's table is written to the shared
folder and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.decontaminate import decontaminate
from basketlens.llm.mixing import training_order
from basketlens.llm.near_dedup import near_duplicates
from basketlens.llm.quality import remainder, score_udf, train
from basketlens.llm.shared import BROADCAST_ROWS, free_name, prefix_sums, semi_join, sent_if_few, stored
from basketlens.llm.sharding import shards


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects (score under 0.5) go; rows held out of op2's training stay out of this one's.

    Every row is judged by its text alone, so rows with a null id are judged as others and repeated rows agree; a null or
    empty text has the score of no lines. Other columns pass through, whatever their names. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    score = free_name(docs, "_score")
    return docs.withColumn(score, score_udf(docs, model)(F.col("text").cast("binary"))).where(F.col(score) >= 0.5).select(*_columns(docs))


def _by_text(docs: DataFrame, repeated: DataFrame, n: int, key: str) -> DataFrame:
    """The rows with an id, and a key for each pair of id and text: of an id's texts the first by SHA-256 has the id itself,
    each further one a number beyond all ids. `repeated` holds the n ids of several rows; only their texts are hashed."""
    digest, one = free_name(docs, "_digest"), free_name(docs, "_one")
    known = docs.where("doc_id is not null").withColumn(key, F.col("doc_id").cast("long"))
    many = semi_join(known, repeated, "doc_id", n).withColumn(digest, F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    texts = many.select("doc_id", digest).distinct()
    first = texts.groupBy("doc_id").agg(F.min(digest).alias("first"))
    further = texts.join(first, "doc_id").where(F.col(digest) != F.col("first")).select("doc_id", digest, F.lit(1).cast("long").alias(one))
    base = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0] + 1
    numbered = stored(prefix_sums(further, [], ["doc_id", digest], {key: one}).select("doc_id", digest, (F.col(key) + base).alias(key)), "texts")
    if numbered.isEmpty():
        return known
    again = many.drop(key).join(sent_if_few(numbered), ["doc_id", digest], "left").withColumn(key, F.coalesce(F.col(key), F.col("doc_id").cast("long")))
    rest = known.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, "doc_id", "left_anti")
    return rest.unionByName(again.select(*_columns(known)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8): the one of the least doc_id.

    Rows without an id stay. Rows that repeat an id with one text are one document: the first by a hash of its columns stays.
    Rows that repeat an id with different texts are documents of their own, so each text stays unless it is near another;
    of such a pair the one that has the id itself (the id's first text by SHA-256) goes before the others. Null and empty
    texts are near nothing. Other columns pass through, whatever their names. An empty table stays empty.
    """
    key = free_name(docs, "_key")
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = repeated.count()
    keyed = _by_text(docs, repeated, n, key) if n else docs.where("doc_id is not null").withColumn(key, F.col("doc_id").cast("long"))
    found = near_duplicates(keyed, id_col=key)
    keep = stored(found.where("kept").select(F.col("doc_id").alias(key)).distinct(), "kept")
    kept = semi_join(keyed, keep, key, keep.count())
    if n:  # equal rows of one id
        rank = free_name(keyed, "_rank")
        first = Window.partitionBy(key).orderBy(F.xxhash64(*_columns(docs)))
        kept = kept.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return kept.select(*_columns(docs)).unionByName(docs.where("doc_id is null"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Every row is judged by its text alone, so rows with a null id are judged as others and repeated rows agree; a null or
    empty text holds none and stays. Other columns pass through, whatever their names. An empty table stays empty.
    """
    found, hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~hits["contaminated"]).select(*_columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order.

    Rows with a null id, text or source count like others (see `mix`); rows without words, and sources of such rows only,
    are taken as their place in the order says or not at all; rows that repeat an id are taken one by one. Other columns
    of any name pass through. An empty table stays empty.
    """
    return training_order(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot in it of every row.

    Rows with a null id or text, empty texts, ties and repeated rows are rows like any other and get slots of their own;
    other columns are not read, whatever their names. An empty table gives an empty result.
    """
    return shards(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Model scores, MinHash and hash orders have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
