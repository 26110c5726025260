"""Stores of rows that expire: laid out by the time of expiry, purged by dropping folders.

Whatever a purge leaves half done, its next run finishes; a run that finds nothing changes no file.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tallyloom.sources.shared import file_system

START = "expires_in"
_NONE = "__HIVE_DEFAULT_PARTITION__"


def with_report(evidence: DataFrame, reports: DataFrame, report_key: str, expires: str) -> DataFrame:
    """evidence whose expiry is no later than its report's, so that it goes with it; evidence without a report keeps its own.

    reports: one row per report_key, with its expires. A missing expiry does not bind.
    """
    ends = reports.select(F.col(report_key).alias("_report"), F.col(expires).alias("_ends"))
    joined = evidence.join(ends, F.col(report_key) == F.col("_report"), "left")
    return joined.withColumn(expires, F.least(expires, "_ends")).drop("_report", "_ends")


def store(rows: DataFrame, path: str, expires: str, unit: str = "day", spread: int = 8) -> None:
    """Write rows to a store, in a folder per unit of time (day, month, year) in which they expire.

    The folders that rows has are replaced, the others stay. A folder is written by up to `spread` tasks. A store keeps
    to one unit.
    """
    out = rows.withColumn(START, F.to_date(F.date_trunc(unit, F.col(expires))))
    out.repartition(START, F.pmod(F.xxhash64(*rows.columns), F.lit(spread))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(START).parquet(path)


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a store, of the schema they were written with; an emptied one has none."""
    full = StructType([*schema.fields, StructField(START, DateType())])
    at, files = file_system(spark, path)
    if not files.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(full).parquet(path).drop(START)


def starts_of(spark: SparkSession, path: str) -> list[dt.date]:
    """First days of the units that a store has a folder for, from their names alone."""
    at, files = file_system(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    starts = [n.split("=", 1)[1] for n in names if n.startswith(f"{START}=")]
    return sorted(dt.date.fromisoformat(d) for d in starts if d != _NONE)


def purge(spark: SparkSession, path: str, schema: StructType, expires: str, as_of: dt.datetime, unit: str = "day", spread: int = 8) -> dict[str, list[dt.date]]:
    """Delete the rows of a store that expired before as_of (expires < as_of); rows without an expiry stay.

    Whole units before as_of go as folders, no row of them is read. Of as_of's own unit the rows that are left replace it
    by a dynamic overwrite, if it has an expired row, or the folder goes if none is left. Later ones are not touched.
    Returned: the units dropped and those rewritten; on a second run there is nothing to drop and nothing to rewrite.
    """
    at, files = file_system(spark, path)
    found = starts_of(spark, path)
    now = {"day": as_of.date(), "month": as_of.date().replace(day=1), "year": as_of.date().replace(month=1, day=1)}[unit]
    drop = [d for d in found if d < now]
    rewrite = []
    if now in found:
        part = spark.read.schema(StructType([*schema.fields, StructField(START, DateType())])).parquet(path).where(F.col(START) == F.lit(now)).drop(START)
        moment = F.lit(as_of).cast(schema[expires].dataType)
        gone, left = part.agg(F.count_if(F.col(expires) < moment), F.count_if(F.col(expires) >= moment)).first()
        if gone and left:
            store(part.where(F.col(expires) >= moment), path, expires, unit, spread)
            rewrite.append(now)
        elif gone:
            drop.append(now)
    for d in drop:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"{START}={d.isoformat()}"), True)
    return {"dropped": drop, "rewritten": rewrite}
