"""Sessions, tables and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on one machine, for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("webloom")
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_made: dict[str, str] = {}
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where a session has none (tests on one
    machine) a temporary folder is made for the session, which is refused on a cluster."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if context.applicationId not in _made:
            _made[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="webloom-")
        found = _made[context.applicationId]
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors, and costly parts
    that several branches read are computed once."""
    path = new_folder(df.sparkSession, what)
    _stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that `stored` has written in this process, and returns their number. Call it when the results of
    the queries that read them have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_stored)
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
