"""What the operators share: the cluster's shared folder, written intermediates, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Joins of a few rows with texts or bags: Spark's runtime Bloom filter drops the others in the
#: scan, before they are shuffled. It needs a predicate on the small side.
BLOOM = {
    "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1g",
}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder is set in local mode (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def session_conf(spark: SparkSession, **pairs: str):
    """Set session settings (dots written as __) and put the old values back."""
    names = {k.replace("__", "."): v for k, v in pairs.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(spark: SparkSession, df: DataFrame, tag: str, dictionary: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, lost executors
    do not force upstream work to run again, and the shuffle files of the write can go.
    dictionary=False: for columns of hashes, which dictionaries only delay."""
    path = fresh_path(spark, tag)
    with session_conf(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what materialize() wrote for the frames, or for a frame they were selected from unchanged; nothing may read them afterwards."""
    for df in frames:
        path = getattr(df, "_tallyloom_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): every further column, whatever its name, is left behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def free_name(docs: DataFrame, base: str) -> str:
    """A column name that docs does not have (Spark compares names without case)."""
    taken = {c.lower() for c in docs.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keyed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", name: str = "_row_key") -> tuple[DataFrame, str]:
    """docs with a column (its name is returned) of longs that identify the rows and stay the
    same when docs is read again.

    It is the id itself where that is unique and never null (one aggregation over the ids
    decides). Otherwise the rows are numbered once and written, and the written rows are used.
    """
    name, key = free_name(docs, name), docs[id_col].cast("long")
    ids = docs.groupBy(key.alias("id")).count()
    if ids.where(F.col("id").isNull() | (F.col("count") > 1)).isEmpty():
        return docs.withColumn(name, key), name
    return materialize(spark, docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def with_uid(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows with such a key, uid."""
    return keyed(spark, docs, name="uid")[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
