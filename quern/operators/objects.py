"""The object catalogue and its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64 * 1024


def owned(objects: DataFrame, owner: str) -> DataFrame:
    return objects.where(F.col("owner") == owner)


def by_exact_name(objects: DataFrame, name_is: Column, owner: str) -> DataFrame:
    return objects.where(name_is & (F.col("owner") == owner))


def public_by_slug(objects: DataFrame, slug_is: Column) -> DataFrame:
    return objects.where(slug_is & (F.col("visibility") == "public"))


def readable(objects: DataFrame, principal: str, admin: bool = False) -> DataFrame:
    """What a principal may read: public objects and its own; an admin reads all."""
    return objects if admin else objects.where((F.col("visibility") == "public") | (F.col("owner") == principal))


def stats(objects: DataFrame) -> DataFrame:
    """Objects and bytes of each owner."""
    return objects.groupBy("owner").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def chunk_layout(objects: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """object_id, chunk_no, offset, length; an empty object has one empty chunk."""
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("int")
    out = objects.select("object_id", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    offset = F.col("chunk_no").cast("long") * chunk
    return out.select("object_id", "chunk_no", offset.alias("offset"), F.least(F.lit(chunk).cast("long"), F.col("size") - offset).alias("length"))


def totals(chunks: DataFrame) -> DataFrame:
    """Size and chunk count of each object, for a check against its header."""
    return chunks.groupBy("object_id").agg(F.sum("length").alias("size"), F.count("*").alias("chunks"))


def expiring(pairs: DataFrame, now_ms: int, within_ms: int) -> DataFrame:
    """Latest live version per name that expires within a time: retired and compromised ones are left out."""
    last = pairs.groupBy("name").agg(F.max_by(F.struct("version", "state", "expires_ms"), "version").alias("v"))
    return last.select("name", "v.*").where((F.col("state") == "current") & (F.col("expires_ms") <= now_ms + within_ms))


def put(objects: DataFrame, now_ms: int) -> DataFrame:
    """Catalogue rows of objects to be stored (object_id, owner, name, content; content_type and visibility may be null); public ones get their id as slug."""
    public = F.coalesce(F.col("visibility"), F.lit("private")) == "public"
    return objects.select(
        "object_id", "owner", "name", F.when(public, "public").otherwise("private").alias("visibility"),
        F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"),
        F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"), F.lit(now_ms).alias("created_ms"),
        F.when(public, F.col("object_id").cast("string")).otherwise("").alias("slug"),
    )


def delete_verdicts(objects: DataFrame, ids: DataFrame, principal: str, admin: bool = False) -> DataFrame:
    """object_id and verdict of each id: `missing`, `denied` (the principal is neither owner nor admin) or `ok`."""
    held = objects.select("object_id", "owner")
    out = ids.select("object_id").distinct().join(held, "object_id", "left")
    allowed = F.lit(admin) | F.coalesce(F.col("owner") == principal, F.lit(False))
    return out.select("object_id", F.when(F.col("owner").isNull(), "missing").when(~allowed, "denied").otherwise("ok").alias("verdict"))


def with_chunks(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Catalogue rows with the chunks of their content."""
    return objects.join(chunks, "object_id")
