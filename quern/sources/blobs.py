"""Blobs as tables of chunks, clear or encrypted with AES-GCM and the chunk's place as additional data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objects import CHUNK


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Public objects: path, length and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def split(objects: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """object_id, chunk_no, data of objects (object_id, content); the content is cut before it is exploded, so it is not copied for each chunk."""
    n = F.greatest(F.ceil(F.length("content") / chunk), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("substring", F.col("content"), i * chunk + 1, F.lit(chunk)))
    return objects.select("object_id", F.posexplode(parts).alias("chunk_no", "data"))


def _place(total):
    return F.concat_ws("|", "object_id", "chunk_no", total)


def encrypt(chunks: DataFrame, totals: DataFrame, key: bytes) -> DataFrame:
    """Chunks sealed with their object, number and the object's chunk count: none can be moved, dropped or cut off."""
    x = chunks.select("object_id", "chunk_no", "data").join(totals.select("object_id", "chunks"), "object_id")
    x = x.withColumn("__key", F.lit(key)).withColumn("__place", _place("chunks"))
    return x.selectExpr("object_id", "chunk_no", "chunks", "aes_encrypt(data, __key, 'GCM', 'DEFAULT', cast('' as binary), __place) as sealed")


def decrypt(sealed: DataFrame, key: bytes) -> DataFrame:
    """The inverse; a chunk out of its place is an error."""
    x = sealed.withColumn("__key", F.lit(key)).withColumn("__place", _place("chunks"))
    return x.selectExpr("object_id", "chunk_no", "chunks", "aes_decrypt(sealed, __key, 'GCM', 'DEFAULT', __place) as data")


def complete(chunks: DataFrame) -> DataFrame:
    """Objects all of whose chunks are there, with their number and size."""
    got = chunks.groupBy("object_id").agg(F.count("*").alias("n"), F.max("chunks").alias("chunks"), F.sum(F.length("data")).alias("size"))
    return got.where("n = chunks").select("object_id", "chunks", "size")
