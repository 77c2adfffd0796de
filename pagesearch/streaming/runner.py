"""Helpers to run a file-source stream to completion (``availableNow``)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files: int | None = 1) -> DataFrame:
    """Stream of the files appearing in ``path`` (explicit schema)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def drain(writer: DataStreamWriter, checkpoint: str, timeout_s: int | None = None) -> None:
    """Process everything available now, then stop; the checkpoint makes a
    restart continue where it stopped (no repeated micro-batch).  A backlog
    takes as long as it needs unless a limit is given."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def write_parts(parts: list[DataFrame], path: str) -> None:
    """Write each DataFrame as one file of ``path`` in order (a stream's input
    arriving one file at a time).  The file source orders files by
    modification time, so each file is stamped one second after the last."""
    import time
    base_ms = int(time.time() * 1000)
    for i, part in enumerate(parts):
        tmp = os.path.join(path, f"_staging_{i}")
        part.coalesce(1).write.mode("overwrite").parquet(tmp)
        jvm = part.sparkSession._jvm
        conf = part.sparkSession._jsc.hadoopConfiguration()
        src_dir = jvm.org.apache.hadoop.fs.Path(tmp)
        fs = src_dir.getFileSystem(conf)
        for st in fs.listStatus(src_dir):
            name = st.getPath().getName()
            if name.endswith(".parquet"):
                dest = jvm.org.apache.hadoop.fs.Path(path, f"part-{i:05d}.parquet")
                fs.rename(st.getPath(), dest)
                fs.setTimes(dest, base_ms + 1000 * i, -1)
        fs.delete(src_dir, True)
