"""Session settings and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "tesselar", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and the settings the engine is written for; conf overrides."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views; only names that the query uses need be given."""
    for n in names:
        read(spark, sf_dir, n).createOrReplaceTempView(n)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set, a local one on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not got.isDefined():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesselar-shared-"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
    return got.get().rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tesselar-{label}-{uuid.uuid4().hex}"


_made: dict[tuple, str] = {}


def made_once(spark: SparkSession, sf_dir: str, label: str, make) -> str:
    """A folder that make(path) fills, once per session and source."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _made:
        path = fresh_folder(spark, label)
        make(path)
        _made[key] = path
    return _made[key]
