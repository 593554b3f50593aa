"""The change feed as a table: counters, gaps, replay and merge with a snapshot.

Counters are dense whole numbers. Running values are made in two passes: within blocks of BLOCK
numbers, and over the blocks' own values, so that a feed of one kind is dealt among many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKLOG = 1024
#: Counter values of a block.
BLOCK = 1 << 20


def _block(counter: str, size: int) -> Column:
    return F.floor(F.col(counter) / size).alias("__block")


def _carried(feed: DataFrame, by: str, counter: str, size: int, value: Column, over) -> DataFrame:
    """The feed with its block and __before: `over` applied to the aggregate `value` of the earlier blocks of the same kind."""
    rows = feed.withColumn("__block", _block(counter, size))
    sizes = rows.groupBy(by, "__block").agg(value.alias("__value"))
    w = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), over("__value").over(w).alias("__before"))
    return rows.join(sizes, rows[by].eqNullSafe(sizes["__by"]) & (rows["__block"] == sizes["__at"])).drop("__by", "__at")


def collection_seq(feed: DataFrame, collection: str, seq: str, *, block: int = BLOCK) -> DataFrame:
    """coll_seq: position in the own collection's feed, from 1."""
    rows = _carried(feed, collection, seq, block, F.count("*"), F.sum)
    here = F.row_number().over(Window.partitionBy(collection, "__block").orderBy(seq))
    return rows.withColumn("coll_seq", (F.coalesce("__before", F.lit(0)) + here).cast("int")).drop("__block", "__before")


def gaps(feed: DataFrame, seq: str, by: str, *, arrival: str | None = None, start: int = 0, block: int = BLOCK) -> DataFrame:
    """gap and duplicate per event of each `by`, in order of a column `arrival` (else of seq itself).

    An event is a duplicate if its number is not above all that came before it (or `start`, what a
    snapshot holds), and a gap if it is above the next one.
    """
    order = arrival or seq
    rows = _carried(feed, by, order, block, F.max(seq), F.max)
    ties = [order] if arrival else [order, F.monotonically_increasing_id()]
    w = Window.partitionBy(by, "__block").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.max(seq).over(w), "__before", F.lit(start))
    rows = rows.withColumn("__seen", before)
    return rows.withColumn("gap", F.col(seq) > F.col("__seen") + 1).withColumn("duplicate", F.col(seq) <= F.col("__seen")).drop("__block", "__before", "__seen")


def stale(feed: DataFrame, seq: str, by: str, *, arrival: str | None = None, start: int = 0, block: int = BLOCK) -> DataFrame:
    """stale: whether a view that follows the feed has met a gap so far; it applies nothing from there on until it loads a snapshot."""
    order = arrival or seq
    rows = gaps(feed, seq, by, arrival=arrival, start=start, block=block)
    first = rows.where("gap").groupBy(by).agg(F.min(order).alias("__first")).select(F.col(by).alias("__by"), "__first")
    out = rows.join(first, rows[by].eqNullSafe(first["__by"]), "left")
    return out.withColumn("stale", F.coalesce(F.col(order) >= F.col("__first"), F.lit(False))).drop("__by", "__first")


def contiguous(feed: DataFrame, seq: str, after: int) -> tuple[int, bool]:
    """The number up to which a feed goes on from `after` without a gap, and whether there are events beyond it."""
    rows = feed.select(F.col(seq).alias("s")).where(F.col("s") > after).distinct()
    ends = rows.union(feed.sparkSession.createDataFrame([(after,)], "s long")).join(rows.select((F.col("s") - 1).alias("s")), "s", "left_anti")
    r = ends.agg(F.min("s").alias("end"), F.max("s").alias("most")).first()
    return r["end"], r["most"] > r["end"]


def replay(feed: DataFrame, seq: str, after: int, keep: Column | None = None) -> DataFrame:
    """Events strictly after a counter; 0 replays nothing, for there is a snapshot to load."""
    out = feed.where(F.col(seq) > after) if after > 0 else feed.limit(0)
    return out.where(keep) if keep is not None else out


def resume_lost(feed: DataFrame, seq: str, after: int) -> bool:
    """Whether events after a counter are gone, or the counter is beyond the head."""
    r = feed.agg(F.min(seq).alias("low"), F.max(seq).alias("high")).first()
    return after > 0 and (r["low"] is None or after + 1 < r["low"] or after > r["high"])


def backlog(feed: DataFrame, seq: str, n: int = BACKLOG) -> DataFrame:
    """The last n events."""
    return feed.orderBy(F.desc(seq)).limit(n)


def rollbacks(seen: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """Observations whose version is below one seen before for the key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return seen.withColumn("highest", F.max(version).over(w)).withColumn("rolled_back", F.coalesce(F.col(version) < F.col("highest"), F.lit(False)))


def merge(snapshot: DataFrame, delta: DataFrame, key: str, seq: str, deleted: str) -> DataFrame:
    """A snapshot (key, seq, ...) and later events: latest per key, deletions dropped."""
    every = snapshot.withColumn(deleted, F.lit(False)).unionByName(delta)
    last = every.groupBy(key).agg(F.max_by(F.struct(*[c for c in every.columns if c != key]), seq).alias("__last"))
    return last.where(~F.col(f"__last.{deleted}")).select(key, *[F.col(f"__last.`{c}`").alias(c) for c in snapshot.columns if c != key])


def first_uses(tokens: DataFrame, token: str, order: str, among: Column | None = None) -> DataFrame:
    """accepted, single use: whether an observation is the first of its token (of those where `among` holds); order is unique per token.

    The first ones are found by an aggregate that combines before the shuffle, so a token may have any share of the rows.
    """
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    first = tokens.where(among).groupBy(token).agg(F.min(order).alias("__first")).select(F.col(token).alias("__token"), "__first")
    out = tokens.join(first, tokens[token].eqNullSafe(first["__token"]), "left")
    return out.withColumn("accepted", among & F.coalesce(F.col(order) == F.col("__first"), F.lit(False))).drop("__token", "__first")
