"""Token ids in ORC files (operator 1): run-length encoded integers, row indexes, Bloom filters on ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh_path, materialize, narrow, session_conf
from tallyloom.llm.tokens import default_tokenizer, encoder

#: Rows after which the writer looks whether a stripe is full; few, as documents may be long.
CHECK_ROWS = 256


def _encode(path: str, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, ids, ends in enc.encode_chunks(batch.column("text"), end_id):
                n = len(ends)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)),
                     pa.ListArray.from_arrays(offsets, pa.array(ids.view("<i4")))],
                    names=["doc_id", "part", "seq", "ids"],
                )
                seq += n

    return run


def write_token_orc(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 16, row_stride: int = 1000,
) -> None:
    """Encode every whole text, append end_id, write (doc_id, part, seq, ids) in ascending doc_id order.

    part and seq are the file's place and the row's place in it. Null texts count as empty
    (one id, end_id); very long texts are one row each. Null ids come first; rows that tie in id lie
    together, in the order of a hash of their text, which also deals one id's rows over tasks. An empty table gives readable files without rows. Other columns are not read. The text is
    shuffled once, by ranges of the id; encoding and writing follow in the same stage.
    Readers take stripes in parallel and skip stripes and row groups by the id's statistics
    and Bloom filter.
    """
    run = _encode(tokenizer or default_tokenizer(), end_id)
    tie = F.xxhash64("text")
    ranged = narrow(docs, id_col, text_col).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        (
            ranged.mapInArrow(run, "doc_id long, part int, seq long, ids array<int>")
            .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
            .option("orc.create.index", "true").option("orc.row.index.stride", row_stride)
            .option("orc.stripe.size", stripe_mb << 20).option("orc.rows.between.memory.checks", CHECK_ROWS).option("compression", "zstd").orc(path)
        )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, seq long, ids array<int>").orc(path)


def _digest(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        flat, ends = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("seq"),
             pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"],
        )


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file gets the sum of the files before it (one row a file); inside a file a window
    adds up, so no task sees more than a file's rows.
    """
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        read = read_token_orc(spark, path).mapInArrow(
            _digest, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"
        )
        read = materialize(spark, read, "token-digests")
    files = read.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    files = files.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return read.withColumn("before", before).join(files, "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = fresh_path(spark, "token-orc")
    write_token_orc(spark, docs, path)
    return token_positions(spark, path)
