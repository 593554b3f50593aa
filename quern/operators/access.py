"""Access control as predicates and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ALL, effective, row_matches


def fold_grants(log: DataFrame) -> DataFrame:
    """Masks after a log of (principal, seq, op, mask), op grant or revoke; who has no bit left is not listed.

    The grants of one principal are a bounded list, folded in order.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "op", "mask")))
    expand = lambda m: F.when(m.bitwiseAND(128) != 0, F.lit(ALL)).otherwise(m)
    folded = F.aggregate("steps", F.lit(0), lambda a, x: F.when(x["op"] == "grant", a.bitwiseOR(x["mask"])).otherwise(expand(a).bitwiseAND(F.bitwise_not(expand(x["mask"])))))
    return log.groupBy("principal").agg(steps.alias("steps")).select("principal", folded.alias("mask")).where("mask <> 0")


def roles_mask(grants: DataFrame, principal: str, mask: str) -> DataFrame:
    """One mask of all of a principal's roles."""
    return grants.groupBy(principal).agg(F.bit_or(mask).alias("mask"))


def effective_masks(principals: DataFrame, acl: DataFrame, key: str) -> DataFrame:
    """Every principal's effective mask; 0 for those without an entry."""
    return principals.join(acl, key, "left").withColumn("mask", effective(F.coalesce("mask", F.lit(0))))


def row_filtered(state: DataFrame, field: str, value: object) -> DataFrame:
    """The rows that a row-scoped principal may see, before any limit or page."""
    return state.where(row_matches(F.col(field), value))


def get_scoped(state: DataFrame, key: str, value: object, field: str, granted: object) -> DataFrame:
    """The record of a key, or nothing where it is out of the row scope: that it is there stays hidden. The same for find_one: find first, then this test."""
    return row_filtered(state.where(F.col(key) == F.lit(value)), field, granted)


def put_scoped(batch: DataFrame, key: str, field: str | None = None, granted: object = None) -> DataFrame:
    """verdict of each record of a direct put: `no id`, `out of scope` (the new record does not match the row scope) or `ok`."""
    inside = row_matches(F.col(field), granted) if field else F.lit(True)
    return batch.withColumn("verdict", F.when(F.col(key).isNull(), "no id").when(~inside, "out of scope").otherwise("ok"))


def delete_scoped(state: DataFrame, ids: DataFrame, key: str, field: str, granted: object) -> DataFrame:
    """The ids whose present record is in the row scope; others are left alone, as if they were not there."""
    return ids.join(row_filtered(state, field, granted).select(key), key, "left_semi")


def token_verdicts(tokens: DataFrame, *, now_ms: int, catalog: str, collection: str, needed: int) -> DataFrame:
    """verdict of each token (jti, kid_known, signed, exp, db, coll, scope, single_use, seq), by the first test that fails."""
    from .changes import first_uses

    inside = (F.col("db") == catalog) & ((F.col("coll") == "*") | (F.col("coll") == collection))
    passes = F.col("kid_known") & F.col("signed") & (F.col("exp") >= now_ms) & inside & (F.col("scope").bitwiseAND(needed) == needed)
    t = first_uses(tokens, "jti", "seq", F.col("single_use") & passes)  # only what passes all else uses a token up
    verdict = (
        F.when(~F.col("kid_known"), "unknown key")
        .when(~F.col("signed"), "bad signature")
        .when(F.col("exp") < now_ms, "expired")
        .when(F.col("db") != catalog, "other catalog")
        .when((F.col("coll") != "*") & (F.col("coll") != collection), "other collection")
        .when(F.col("scope").bitwiseAND(needed) != needed, "out of scope")
        .when(F.col("single_use") & ~F.col("accepted"), "used")
        .otherwise("ok")
    )
    return t.withColumn("verdict", verdict)
