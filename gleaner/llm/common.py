"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = LETTERS_UPPER.lower()

#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; all other bytes become spaces.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    """The lower-cased alphanumeric words of UTF-8 bytes; null has none."""
    return raw.translate(WORD_BYTES).split() if raw else []


def as_binary(column: pa.Array) -> list:
    """The cells of a text column as bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs on one
    machine, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def materialized(df: DataFrame, **options) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: it is smaller than an RDD checkpoint, and columns are
    pruned on reading. The table outlives lost executors and goes with the folder. options: of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.gleaner_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialized` that nothing reads any more; what was made of them must be written by now."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.gleaner_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
