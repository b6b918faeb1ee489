"""Session factory with the settings that the engine expects; a cluster's own settings win over these."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "basketlens", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, build the session there and pass it on instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder where all executors can write and read; one of this machine only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='shared-')}/{tag}-{uuid.uuid4().hex}"
