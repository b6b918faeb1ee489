"""A table that streams write to: change rows by batch and bucket, merged on read, compacted now and then.

Layout under a folder that all executors share: `log/batch=N/bucket=B` holds the rows of micro-batch N, the newest of each
key; `base/upto=N/bucket=B` the merged rows of all batches up to N. A folder counts once it holds the mark that Spark writes
last, so a failed write is not read. A batch that runs again writes its own folder anew and sees the batches before it
only: replay changes nothing. Writing costs as much as the batch; each row is rewritten once every `every` batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.operators.ingest import snapshot_on_change
from basketlens.operators.ranking import best_per_key


class MergeLog:
    """Rows by key; of a key's rows that of the greatest version stays, of equal versions that of the latest batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], version: str, buckets: int = 16, every: int = 10):
        self.spark, self.path, self.schema, self.keys, self.version, self.buckets, self.every = spark, path.rstrip("/"), schema, list(keys), version, buckets, every

    def _complete(self, kind: str, name: str) -> list[int]:
        """Numbers of the folders that are complete."""
        jvm = self.spark.sparkContext._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{name}=*/_SUCCESS")
        found = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
        return sorted(int(re.search(rf"/{name}=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found)

    def _read(self, kind: str, name: str, number: int) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/{kind}/{name}={number}")
        return rows.withColumn("_batch", F.lit(number).cast("long"))

    def _write(self, rows: DataFrame, to: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{to}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _merged(self, rows: DataFrame) -> DataFrame:
        return best_per_key(rows, self.keys, [F.desc_nulls_last(self.version), F.desc("_batch")])

    def _parts(self, before: int | None, least: int = 0) -> DataFrame:
        """Rows of the newest base and of the batches behind it."""
        bases = [n for n in self._complete("base", "upto") if before is None or n < before]
        parts = [self._read("base", "upto", bases[-1])] if bases else []
        parts += [self._read("log", "batch", n) for n in self._complete("log", "batch") if (not bases or n > bases[-1]) and n >= least and (before is None or n < before)]
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int, _batch long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """The merged rows, of the batches before a number if one is given; with `near` only of the keys it holds.

        The buckets that `near` touches reach the scan, so a small batch does not read the whole table.
        """
        rows = self._parts(before)
        if near is not None:
            touched = [r.bucket for r in self._bucketed(near.select(*self.keys)).select("bucket").distinct().collect()]  # as many as there are buckets
            rows = rows.where(F.col("bucket").isin(touched)).join(near.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._merged(rows).drop("bucket", "_batch")

    def append(self, rows: DataFrame, number: int) -> None:
        """The rows of one batch; again the same rows, or others instead, if its number has been written before."""
        newest = best_per_key(self._bucketed(rows), self.keys, [F.desc_nulls_last(self.version)])
        self._write(newest, f"log/batch={number}")
        if (number + 1) % self.every == 0:
            self.compact(number)

    def compact(self, upto: int) -> None:
        """Merge the newest base and the batches behind it, up to a number, into a new base. What it replaces can be removed once no reader needs it."""
        self._write(self._merged(self._parts(upto + 1)).drop("_batch"), f"base/upto={upto}")


def upsert_stream(rows: DataFrame, log: MergeLog):
    """A writer that merges each micro-batch into the log."""
    return rows.writeStream.foreachBatch(lambda batch, number: log.append(batch, number))


def change_stream(rows: DataFrame, log: MergeLog, value: str, changes: MergeLog):
    """A writer that stores the rows whose value is not the one in the log, with `before`, and keeps the log up to date.

    Within a batch only the newest row of a key counts. `changes` has the keys and the version as its key, and a column `before`.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = best_per_key(batch, log.keys, [F.desc_nulls_last(log.version)])
        current = log.read(before=number, near=newest)
        fresh = newest.join(current.select(*log.keys, F.col(log.version).alias("_held")), log.keys, "left").where(f"_held IS NULL OR _held < {log.version}").drop("_held")
        changes.append(snapshot_on_change(current, fresh, log.keys, value), number)
        log.append(newest, number)

    return rows.writeStream.foreachBatch(write)


def gated_stream(rows: DataFrame, log: MergeLog, seen: MergeLog, group: str, run: str, least: float = 0.5, small: int = 20):
    """A writer that deactivates what a whole healthy run no longer has.

    Rows are (keys, `group`, `run`, `kind`): `row` for what a run has seen, `end` for its end, `partial` for the end of a run
    that was cut short. `log` has `active`, with `run` as its version; `seen` has a row for each key and run. At a run's end,
    in whatever batch its rows came, the gate compares what it has seen with what is active in its group: of more than
    `small` active rows it must have seen the share `least`; an empty or partial run deactivates nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = batch.where("kind = 'row'")
        seen.append(found.select(*seen.keys, F.lit(number).cast("long").alias(seen.version)), number)
        active = found.select(*log.keys, run, F.lit(True).alias("active"))
        ends = batch.where("kind = 'end'").join(batch.where("kind = 'partial'").select(group, run), [group, run], "left_anti").select(group, run).distinct()
        known = log.read(before=number).where("active").drop("active", run)
        scraped = seen.read().join(ends, [group, run], "left_semi")
        n = known.groupBy(group).agg(F.count("*").alias("n"))
        m = scraped.groupBy(group, run).agg(F.count("*").alias("m"))
        healthy = ends.join(m, [group, run]).join(n, group, "left").where(f"coalesce(n, 0) <= {small} OR m >= {least} * n").select(group, run)
        gone = known.join(healthy, group).join(scraped.select(*log.keys, run), [*log.keys, run], "left_anti")
        log.append(active.unionByName(gone.select(*log.keys, run, F.lit(False).alias("active"))), number)

    return rows.writeStream.foreachBatch(write)


def send_once(alerts: DataFrame, path: str, send: Callable[[DataFrame], None]):
    """A writer that marks alerts before it sends them: a batch that has been marked is not sent again, so none goes out twice."""

    def write(batch: DataFrame, number: int) -> None:
        marks = MergeLog(batch.sparkSession, path, batch.schema.simpleString()[7:-1].replace(":", " "), batch.columns, batch.columns[0])
        if number not in marks._complete("log", "batch"):
            marks.append(batch, number)
            send(marks._read("log", "batch", number).drop("bucket", "_batch"))

    return alerts.writeStream.foreachBatch(write)
