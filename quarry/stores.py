"""Files and tables in folders that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop(spark: SparkSession, path: str):
    """A path's file system and the path, as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None)
        if not folder:
            folder = shared_folder.own = tempfile.mkdtemp(prefix="quarry-tables-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage and outlives executors. It goes when the driver ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = hadoop(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none if it does not exist."""
    files, p = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(p)) if files.exists(p) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    files, p = hadoop(spark, path)
    return files.getContentSummary(p).getLength()


def is_folder(spark: SparkSession, path: str) -> bool:
    files, p = hadoop(spark, path)
    return files.exists(p) and files.getFileStatus(p).isDirectory()


def read_range(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    """Up to size bytes of a file from start on; of a file packed by a codec (.gz, .bz2 and so on) of what is packed."""
    jvm, (files, p) = spark.sparkContext._jvm, hadoop(spark, path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    opened = files.open(p)
    try:
        stream = opened
        if codec is not None:
            stream = codec.createInputStream(opened)
            jvm.org.apache.commons.io.IOUtils.skip(stream, start)
        else:
            opened.seek(start)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        opened.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file unless it exists, in one step; whether it was created."""
    files, p = hadoop(spark, path)
    try:
        stream = files.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
