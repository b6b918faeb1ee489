"""Two-stage search: posting lists of two and three letters choose the rows, the exact score ranks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.text import fold


class TrigramIndex:
    """Which rows hold which two and three letters of their folded text, as a table bucketed by the letters: a search reads
    the buckets of its letters only. Terms of one letter score nothing, so they have no posting list."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    def build(self, rows: DataFrame, id_: str, text: str) -> None:
        folded = rows.select(F.col(id_).alias("id"), fold(F.col(text), final_sigma=True).alias("t"))
        at = F.sequence(F.lit(1), F.length("t") - 1)
        grams = F.array_distinct(F.concat(F.transform(at, lambda i: F.substring(F.col("t"), i, F.lit(2))), F.transform(at, lambda i: F.substring(F.col("t"), i, F.lit(3)))))
        postings = folded.where(F.length("t") >= 2).select(F.explode(grams).alias("gram"), "id")
        # one writer a bucket, so that a bucket is one sorted file
        postings.repartition(self.buckets, "gram").write.bucketBy(self.buckets, "gram").sortBy("gram", "id").mode("overwrite").saveAsTable(self.name)

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """Ids of rows that hold all letters of a term: every row that holds a term is among them."""
        terms = [t for t in terms if len(t) > 1]
        if not terms:
            raise ValueError("a term needs two letters")
        wanted = {t: sorted({t[i : i + 3] for i in range(max(1, len(t) - 2))}) for t in terms}
        pairs = self.spark.createDataFrame([(t, g, len(gs)) for t, gs in wanted.items() for g in gs], "term string, gram string, n int")
        lists = self.spark.table(self.name).where(F.col("gram").isin(sorted({g for gs in wanted.values() for g in gs})))
        hits = lists.join(F.broadcast(pairs), "gram").groupBy("term", "id").agg(F.count("*").alias("k"), F.first("n").alias("n"))
        return hits.where("k = n").select("id").distinct()
