"""Point, equality and range queries, pages and limits over a state.

Conditions stay bare comparisons of columns with literals, so they reach the Parquet scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import blind, blind_literal, bucket
from ..schema import Field

# Limits of the query surface.
PAGE_DEFAULT, PAGE_MAX = 100, 1000
FIND_MAX = 5000
#: Buckets up to which a blind range is a list of hashes.
PROBE_BUDGET = 4096


class QueryError(ValueError):
    """A query that names an unknown or unindexed field, or has no finite bounds."""


def clamp(v: int, low: int, high: int) -> int:
    return max(low, min(high, v))


def find_limit(limit: int | None) -> int:
    """0 and none mean the maximum; negative ones mean 1."""
    return clamp(limit or FIND_MAX, 1, FIND_MAX)


def check_indexed(fields: list[Field], name: str, *, ranged: bool = False) -> Field:
    """Validation mode: a query is on an indexed field, or an error and not a scan."""
    by = {f.name: f for f in fields}
    if name not in by:
        raise QueryError(f"unknown field {name!r}")
    f = by[name]
    if not (f.bucket_width is not None or f.index if ranged else f.index or f.blind):
        raise QueryError(f"field {name!r} has no index for this query")
    return f


def get(state: DataFrame, key: str, value: object) -> DataFrame:
    return state.where(F.col(key) == F.lit(value))


def find(state: DataFrame, field: str, value: object, *, limit: int | None = None, key: str | None = None) -> DataFrame:
    """Equality; null never matches. A limited result is ordered by key, so it is always the same one."""
    out = state.where(F.col(field) == F.lit(value).cast(state.schema[field].dataType))
    return out.orderBy(key).limit(limit) if limit and key else out.limit(limit) if limit else out


def find_one(state: DataFrame, field: str, value: object, key: str) -> DataFrame:
    return find(state, field, value, limit=1, key=key)


def find_blind(state: DataFrame, field: str, value: object, secret: bytes, stored: str | None = None) -> DataFrame:
    """Equality of keyed hashes, on a stored hash column or on one made of the clear column."""
    return state.where((F.col(stored) if stored else blind(F.col(field), secret)) == blind_literal(value, secret))


def _bounds(low: float, high: float) -> bool:
    for b in (low, high):
        if isinstance(b, float) and not math.isfinite(b):
            raise QueryError("bounds must be finite")
    return low <= high


def find_range(state: DataFrame, field: str | Column, low: object, high: object, *, limit: int = 0, key: str | None = None) -> DataFrame:
    """Inclusive range; nulls never match, an inverted range is empty, limit 0 means none."""
    col = F.col(field) if isinstance(field, str) else field
    out = state.where(col.between(F.lit(low), F.lit(high))) if _bounds(low, high) else state.limit(0)
    return (out.orderBy(key) if key else out).limit(limit) if limit else out


def bucket_hashes(low: float, high: float, width: float, secret: bytes) -> list[str] | None:
    """Hashes of all buckets of a range; None beyond PROBE_BUDGET."""
    first, last = math.floor(low / width), math.floor(high / width)
    return None if last - first + 1 > PROBE_BUDGET else [blind_literal(b, secret) for b in range(first, last + 1)]


def range_bucketed(state: DataFrame, value: Column, stored: str, low: float, high: float, width: float, secret: bytes) -> DataFrame:
    """Range over a stored column of bucket hashes: candidates by hash (within the budget), then the exact test."""
    if not _bounds(low, high):
        return state.limit(0)
    hashes = bucket_hashes(low, high, width, secret)
    out = state if hashes is None else state.where(F.col(stored).isin(hashes))
    return out.where(value.between(F.lit(low), F.lit(high)))


def with_bucket_hash(state: DataFrame, value: Column, name: str, width: float, secret: bytes) -> DataFrame:
    return state.withColumn(name, blind(bucket(value, width), secret))


def scan_page(state: DataFrame, key: str, after: object = None, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Keyset page: the next `limit` keys above `after` in ascending order; plans as a top-k, not a sort."""
    out = state if after is None else state.where(F.col(key) > F.lit(after))
    return out.orderBy(key).limit(clamp(limit, 1, PAGE_MAX))


def page_with_cursor(state: DataFrame, key: str, after: object = None, limit: int = PAGE_DEFAULT) -> tuple[list, object]:
    """The page's rows and the next cursor, None on the last page."""
    n = clamp(limit, 1, PAGE_MAX)
    out = state if after is None else state.where(F.col(key) > F.lit(after))
    rows = out.orderBy(key).limit(n + 1).collect()  # bounded by PAGE_MAX
    return rows[:n], rows[n - 1][key] if len(rows) > n else None


def postfilter_page(state: DataFrame, key: str, after: object, limit: int, keep: Column) -> DataFrame:
    """A row filter applied after the page is cut, so pages may be short; scan_page over a filtered state is the better query."""
    return scan_page(state, key, after, limit).where(keep)
