"""The fold from mutations to state, and mutations as set operations.

A log has a key, a total order (one or more columns) and a deletion flag. Folds group by
key with max_by, which combines before the shuffle, so a key with any share of the log
sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame, key: str, order: Sequence[str], deleted: Column, *, version: str | None = "version") -> DataFrame:
    """Latest row per key, without keys whose latest row is a deletion; version counts a key's rows."""
    payload = F.struct(*[F.col(c) for c in log.columns if c != key], deleted.alias("__deleted"))
    last = log.groupBy(key).agg(F.max_by(payload, F.struct(*order)).alias("__last"), F.count("*").alias("__version"))
    live = last.where(~F.col("__last.__deleted"))
    cols = [key, *[F.col(f"__last.`{c}`").alias(c) for c in log.columns if c != key]]
    return live.select(*cols, *([F.col("__version").alias(version)] if version else []))


def versions(log: DataFrame, key: str, order: Sequence[str], name: str = "version") -> DataFrame:
    """Every mutation with its version of the key, from 1; deletions count."""
    return log.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def _ordered(batch: DataFrame, order: str | None) -> Column:
    """The order of a batch's rows: a column, or their place in the scan."""
    return F.col(order) if order else F.monotonically_increasing_id()


def _keyed(key: str) -> Column:
    """The key; a null one is an error, for it is no record's."""
    return F.coalesce(F.col(key), F.raise_error(F.lit("a null key"))).alias(key)


def last_rows(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Of rows with the same key the last one."""
    rest = [c for c in batch.columns if c != key]
    last = batch.select(_keyed(key), F.struct(*rest).alias("__row"), _ordered(batch, order).alias("__order")).groupBy(key).agg(F.max_by("__row", "__order").alias("__row"))
    return last.select(*[F.col(key) if c == key else F.col(f"__row.`{c}`").alias(c) for c in batch.columns])


def last_fields(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: of every field the last value that is not null. The order's column is not among the result."""
    rest = [c for c in changes.columns if c not in (key, order)]
    rows = changes.select(_keyed(key), *rest, _ordered(changes, order).alias("__order"))
    if not rest:
        return rows.select(key).distinct()
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__order"))).alias(c) for c in rest])


def upsert(state: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Full records of batch replace or join those of state; of several for a key the last one does. A null key is an error."""
    new = last_rows(batch, key, order)
    return state.join(new.select(key), key, "left_anti").unionByName(new.select(state.columns))


def patch(state: DataFrame, changes: DataFrame, key: str, *, unset: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Shallow merge: a non-null field of changes wins, the last of several; fields in unset become null where the key is patched."""
    changes = last_fields(changes, key, order)
    c = changes.select(key, F.lit(True).alias("__hit"), *[F.col(f).alias(f"__new_{f}") for f in changes.columns if f != key])
    out = state.join(c, key, "left")
    cols = [F.col(key)]
    for f in state.columns:
        if f == key:
            continue
        v = F.coalesce(f"__new_{f}", f) if f in changes.columns else F.col(f)
        cols.append(F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(f)).alias(f) if f in unset else v.alias(f))
    return out.select(*cols)


def delete(state: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return state.join(ids.select(key), key, "left_anti")


def unique_violations(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Values held by more than one row, with the number of holders."""
    return rows.groupBy(*fields).agg(F.count("*").alias("holders")).where("holders > 1")


def insert_unique(state: DataFrame, batch: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """Verdict per row of batch: `ok`, `missing` (a field is null or empty), `taken` (a live row holds a value) or `repeated` (an earlier row of the batch does)."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull() | (F.col(f).cast("string") == "")
    out = batch.where(~missing)  # rows without a value take no part in the joins, where they would be one hot key
    taken, repeated = F.lit(False), F.lit(False)
    for f in fields:
        held = state.select(F.col(f).alias(f)).where(F.col(f).isNotNull()).distinct().withColumn(f"__held_{f}", F.lit(True))
        first = batch.where(~missing).groupBy(f).agg(F.min(F.struct(order, key)).alias(f"__first_{f}"))
        out = out.join(held, f, "left").join(first, f)
        taken = taken | F.col(f"__held_{f}").isNotNull()
        repeated = repeated | (F.struct(order, key) > F.col(f"__first_{f}"))
    verdict = F.when(taken, "taken").when(repeated, "repeated").otherwise("ok")
    out = out.select(*batch.columns, verdict.alias("verdict"))
    return out.unionByName(batch.where(missing).withColumn("verdict", F.lit("missing")))


def compare_and_set(state: DataFrame, asked: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Verdict per request (key, expected): `ok`, `aborted` on another version, `missing`; 0 expects nothing.

    The versions are those before the batch. Of the requests of a key that would pass, in the order given,
    the first one changes the version, so later ones pass only where they expect nothing. Without an order a key has one request.
    """
    out = asked.join(state.select(key, "version"), key, "left")
    passes = (F.col("expected") == 0) | (F.col("expected") == F.col("version"))
    first = F.lit(True)
    if order:
        lead = out.where(F.col("version").isNotNull() & passes).groupBy(key).agg(F.min(order).alias("__first"))
        out, first = out.join(lead, key, "left"), (F.col("expected") == 0) | (F.col(order) == F.col("__first"))
    verdict = F.when(F.col("version").isNull(), "missing").when(passes & first, "ok").otherwise("aborted")
    return out.select(*asked.columns, "version", verdict.alias("verdict"))


def postings(rows: DataFrame, field: str, key: str) -> DataFrame:
    """value and id pairs of a secondary index; absent values are not indexed."""
    return rows.where(F.col(field).isNotNull()).select(F.col(field).alias("value"), F.col(key).alias("id"))


def posting_list(rows: DataFrame, field: str, key: str) -> DataFrame:
    """The ids of each value as a sorted set; for values of bounded frequency, else use postings."""
    return postings(rows, field, key).groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def posting_sizes(rows: DataFrame, field: str, key: str) -> DataFrame:
    """How many ids each value has; no list of them is made."""
    return postings(rows, field, key).groupBy("value").agg(F.count_distinct("id").alias("ids"))


def merge_segments(disk: DataFrame, memory: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """(disk without tombstones) and what is in memory; a pair in both counts once."""
    return disk.join(gone, list(key), "left_anti").unionByName(memory).distinct()
