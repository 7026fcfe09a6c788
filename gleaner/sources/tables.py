"""Reading and writing tables, with the contracts of immutable results."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = (
    "filepath string, metadata struct<width:int,height:int>, weather struct<label:string>, timeofday struct<label:string>,"
    " scene struct<label:string>, detections struct<detections:array<struct<label:string,bounding_box:array<double>,"
    "occluded:boolean,truncated:boolean>>>"
)

#: The file that marks a frozen root.
FROZEN = "frozen.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """The samples of an annotation index: one JSON document with an array `samples`."""
    index = spark.read.schema(f"samples array<struct<{_fields(ANNOTATION)}>>").json(path, multiLine=True)
    return index.select(F.inline("samples"))


def _fields(ddl: str) -> str:
    schema = T.StructType.fromDDL(ddl)
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema)


def json_records(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one record each, with their path."""
    return spark.read.schema(schema).json(glob, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def image_bytes(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size and content hash of binary files."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, repeats included."""
    return sorted(a.columns) == sorted(b.columns) and not a.exceptAll(b.select(a.columns)).take(1) and not b.select(a.columns).exceptAll(a).take(1)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless it is there; an equal table is left untouched, another raises. Whether it wrote."""
    return write_all_once({path: df})[path]


def write_all_once(tables: dict[str, DataFrame]) -> dict[str, bool]:
    """`write_once` for tables that belong together: all are compared before the first one is written. Nothing below a
    frozen root."""
    for path, df in tables.items():
        refuse_frozen(df.sparkSession, path)
    there = {path: exists(df.sparkSession, path) for path, df in tables.items()}
    for path, df in tables.items():
        if there[path] and not same_rows(df.sparkSession.read.parquet(path), df):
            raise ValueError(f"Existing result differs: {path}")
    for path, df in tables.items():
        if not there[path]:
            df.write.mode("errorifexists").parquet(path)
    return {path: not was for path, was in there.items()}


def refuse_frozen(spark: SparkSession, path: str, marker: str = FROZEN) -> None:
    """An error if the path or a folder above it is frozen: if it holds the marker. Sinks ask before they change anything."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    while place is not None:
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(place, marker)):
            raise ValueError(f"Frozen: {place.toString()}")
        place = place.getParent()


def freeze(spark: SparkSession, root: str, marker: str = FROZEN) -> None:
    """Nothing below the root is written any more by the sinks here."""
    write_json({"frozen": True}, f"{root}/{marker}", spark)


def write_all_or_nothing(checked: DataFrame, path: str, errors: str) -> None:
    """checked: rows with a column `error`. Rows with errors are written apart and stop the publication."""
    refuse_frozen(checked.sparkSession, path)
    bad = checked.where("error is not null")
    if bad.take(1):
        bad.write.mode("overwrite").parquet(errors)
        raise ValueError(f"Rows with errors: {errors}")
    checked.drop("error").write.mode("errorifexists").parquet(path)


def write_json(value: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small report, replaced atomically; numbers must be finite. With a session, to any file system that Spark writes to;
    else to a local path."""
    text = json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False)
    if spark is None:
        handle, partial = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(partial, path)
        return
    refuse_frozen(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    partial = hadoop.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    system = target.getFileSystem(conf)
    stream = system.create(partial, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(system.getUri(), conf).rename(partial, target, overwrite)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small report from any file system."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def config(spark: SparkSession, path: str, schema: str) -> dict:
    """A configuration of one JSON object, by its schema: an error if a field is missing or isn't of its type. Fields that
    the schema doesn't name are left out."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        given = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path} is no JSON: {e}") from None
    kind = T.StructType.fromDDL(schema)
    if missing := [f.name for f in kind if not isinstance(given, dict) or f.name not in given]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    row = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", kind).alias("c")).first()["c"].asDict(recursive=True)
    if wrong := [name for name, value in row.items() if value is None and given[name] is not None]:
        raise ValueError(f"{path}: not of their type: {', '.join(wrong)}")
    return row
