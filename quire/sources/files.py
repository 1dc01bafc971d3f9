"""Files as rows: name, mime, size, content, and the error of those an operator does not take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import accepts, mime_type

BINARY = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def _files(raw: DataFrame) -> DataFrame:
    name = F.url_decode(F.substring_index("path", "/", -1))
    return raw.select(
        F.col("path").alias("file_id"), name.alias("name"), mime_type(name).alias("mime"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), "content",
    )


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file_id, name, mime, size, modified and content. Filters on size and modified reach the scan; content is read only if used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _files((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"), F.col("value").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image structs of the files that Java can decode; others are null."""
    return spark.read.format("image").option("dropInvalid", "false").load(path)


def stream_files(spark: SparkSession, path: str, pattern: str | None = None, per_batch: int = 1000) -> DataFrame:
    """Like read_files(), as a stream of the files that arrive."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_batch)
    return _files((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def error(code: Column | str, recoverable: bool = False, technical: Column | None = None) -> Column:
    """struct<code, recoverable, technical>."""
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(
        code.alias("code"), F.lit(recoverable).alias("recoverable"),
        (technical if technical is not None else F.lit(None).cast("string")).alias("technical"),
    )


def gate(files: DataFrame, types: list[str], extensions: list[str] = ()) -> DataFrame:
    """files with error set where an operator of those types does not take them: bad rows stay, the job goes on."""
    fine = accepts(F.col("mime"), F.col("name"), types, list(extensions))
    refused = error("UNSUPPORTED_INPUT", technical=F.concat(F.lit("received "), F.coalesce("mime", F.lit("unknown type"))))
    return files.withColumn("error", F.when(~fine, refused))
