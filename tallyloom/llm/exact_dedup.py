"""Exact deduplication as a stateful stream (operator 9), DataFrame operations only.

1. A digest log (digest, doc_id, content locator) is written from the documents.
2. A Structured Streaming query reads the log. Its RocksDB state has one entry for each
   digest and no expiry: the smallest identifier, that row's content locator, the group size.
   Partial aggregation before the exchange leaves one row per digest and task, so a
   group of copies with a third of all rows does not load one task.
3. Every hit (a digest with several rows) is checked on full bytes: the members' texts are
   grouped by digest AND text. A digest shared by different texts is split by text.

Where the caller names a state folder, log and checkpoint stay there: the documents of a later call
meet the digests of all earlier ones, and an earlier text is read by its locator to be compared.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, free_name, fresh_path, materialize, session_conf

#: A digest of over one row in HOT is hot (and of over HOT rows); tasks that a hot digest's rows are dealt over.
HOT, SALTS = 1000, 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalized(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _located(spark: SparkSession, docs: DataFrame, rewrite: bool = True) -> tuple[DataFrame, str, str]:
    """Rows with their content locator, the Parquet file and the row in it, and its columns' names.

    Rows that do not come straight from files are written first."""
    file, row = free_name(docs, "_file"), free_name(docs, "_row")
    try:
        meta = docs.metadataColumn("_metadata")  # the files' own, even if a column has that name
        located = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(row))
        located.schema  # noqa: B018  resolves the columns
    except AnalysisException:
        if not rewrite:
            raise
        return _located(spark, materialize(spark, docs, "dedup-docs"), rewrite=False)
    return located, file, row


def first_seen(spark: SparkSession, log: str, checkpoint: str) -> DataFrame:
    """Run the stream over the digest log until it has no more files; return its state:
    (digest, keep: struct(batch, no_id, doc_id, file, row), n). Files that the checkpoint knows are not read again."""
    with session_conf(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="200",
    ):
        stream = spark.readStream.schema(LOG).parquet(log)
        query = (
            stream.groupBy("digest").agg(F.min(_order()).alias("keep"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    least, count = (state.schema["value"].dataType[i].name for i in (0, 1))
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.`{least}`").alias("keep"), F.col(f"value.`{count}`").alias("n")
    )


LOG = "digest binary, batch int, doc_id long, file string, row long, text_sha256 string"


def _order() -> Column:
    """What stays has the least of this: earlier calls before later ones, then the smallest id, nulls last."""
    return F.struct("batch", F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def exact_dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, state: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as
    empty; texts of any length are read whole. The smallest doc_id of a group stays; of rows
    that tie in id exactly one stays (the first by file and row); a null id stays only where the
    whole group has null ids (keep_id is then null). An empty table gives an empty result. Other
    columns, whatever their names, are not read. digest_bits shortens the state's key, for tests of the
    full-byte check.

    state: a folder, shared by the cluster, that retains the stream's state from call to call. Documents of
    earlier calls come first: a later copy of one is dropped, its keep_id is the earlier document's and
    group_size counts both. The files of earlier documents have to be readable still. A call that failed after its
    log was written must not be repeated on the same folder: its rows would count as earlier ones.
    """
    return _judged(spark, *_located(spark, docs), id_col, text_col, digest_bits, state).drop("file", "row")


def _judged(
    spark: SparkSession, located: DataFrame, file: str, row: str, id_col: str, text_col: str, digest_bits: int = 256, state: str | None = None
) -> DataFrame:
    """exact_dedup with each row's locator."""
    folder = state.rstrip("/") if state else fresh_path(spark, "dedup-state")
    log_path, batch = f"{folder}/log", 0
    at = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if known:
        batch = (spark.read.schema(LOG).parquet(log_path).agg(F.max("batch")).first()[0] or 0) + 1
    rows = located.select(
        located[id_col].cast("long").alias("doc_id"), normalized(located[text_col].cast("string")).alias("text"),
        located[file].alias("file"), located[row].alias("row"), F.lit(batch).alias("batch"),
    )
    hexed = F.sha2("text", 256)
    keyed = rows.withColumn("text_sha256", hexed).withColumn("digest", F.unhex(F.substring("text_sha256", 1, digest_bits // 4)))
    names = ["digest", "batch", "doc_id", "file", "row", "text_sha256"]
    keyed.select(names).write.mode("append").parquet(log_path)
    log = spark.read.schema(LOG).parquet(log_path)
    seen = materialize(spark, first_seen(spark, log_path, f"{folder}/checkpoint"), "dedup-seen")
    # Full bytes are read for hits only; where few digests have hits, Spark's runtime Bloom
    # filter drops the other rows in the scan stage, before the text is shuffled.
    hot = _hot(seen)
    texts = ["digest", "text", "text_sha256"]
    with session_conf(
        spark,
        spark__sql__optimizer__runtime__bloomFilter__enabled="true",
        spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0",
    ):
        hit = _spread(keyed, seen.where("n > 1").select("digest"), hot)
        members = hit.select(*texts, _order().alias("keep"), F.lit(1).cast("long").alias("n"))
        if batch:
            old = log.where(F.col("batch") < batch).join(keyed.select("digest").distinct(), "digest", "left_semi")
            members = members.unionAll(_texts_of(spark, old, text_col).select(*texts, "keep", "n"))
        members = members.groupBy(texts).agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        members = materialize(spark, members, "dedup-hits")
    several = members.groupBy("digest").count().where("count > 1").select("digest")

    def judged(joined: DataFrame) -> DataFrame:
        return joined.select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.col("keep").eqNullSafe(_order()).alias("kept"),
            "text_sha256", "file", "row",
        )

    # A digest of one text: the state's answer stands.
    slim = log.where(F.col("batch") == batch)
    if several.isEmpty():
        forget(spark, members)
        return judged(_spread(slim, seen, hot))
    several = materialize(spark, several, "dedup-collisions")
    plain = _spread(slim.join(several, "digest", "left_anti"), seen, hot)
    mixed = keyed.join(several, "digest", "left_semi").join(members.drop("text_sha256"), ["digest", "text"])
    return judged(plain).unionAll(judged(mixed))


def _hot(seen: DataFrame) -> DataFrame | None:
    """Digests of over one row in HOT: by that fewer than HOT, so they may be broadcast. None if there are none."""
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = seen.where(F.col("n") > max(total / HOT, HOT)).select("digest", F.lit(True).alias("hot"))
    return None if hot.isEmpty() else F.broadcast(hot)


def _spread(rows: DataFrame, answers: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Inner join by digest; the rows of a hot digest are dealt over SALTS tasks, to each of which its answer goes."""
    if hot is None:
        return rows.join(answers, "digest")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("file", "row"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")).alias("salt")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = rows.join(hot, "digest", "left").select("*", salt).drop("hot")
    copies = answers.join(hot, "digest", "left").select("*", F.explode(salts).alias("salt")).drop("hot")
    return dealt.join(copies, ["digest", "salt"]).drop("salt")


def _texts_of(spark: SparkSession, log: DataFrame, text_col: str) -> DataFrame:
    """(digest, text, text_sha256, keep, n) of logged rows, their texts read again by locator: one text for each whole digest."""
    one = log.groupBy("digest", "text_sha256").agg(F.min(_order()).alias("keep"), F.count(F.lit(1)).alias("n"))
    one = materialize(spark, one.withColumns({"file": F.col("keep.file"), "row": F.col("keep.row")}), "dedup-earlier")
    files = [r.file for r in one.select("file").distinct().collect()]  # files, not documents
    if not files:
        return one.withColumn("text", F.lit(None).cast("string"))
    read = spark.read.parquet(*files)
    meta = read.metadataColumn("_metadata")
    read = read.select(normalized(read[text_col].cast("string")).alias("text"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    return one.join(read, ["file", "row"])


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, of the documents that stay."""
    located, file, row = _located(spark, docs)
    kept = _judged(spark, located, file, row, id_col, text_col).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return located.join(kept, [file, row], "left_semi").drop(file, row)
