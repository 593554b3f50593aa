"""Capability tokens: three base64url parts (header, claims, HMAC-SHA256 of both), a ring of keys, and verification of whole tables.

Issuing is driver work. Verification is native: the ring holds a few keys, so a token's
signature is one keyed hash from sha2 under the key that its header names.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hmac_sha256
from .access import token_verdicts

#: Keys that a ring keeps; tokens of older ones are refused.
KEEP = 3


class KeyRing:
    """Secrets by key id, the newest last."""

    def __init__(self, keep: int = KEEP):
        self.keep, self.keys = keep, {}
        self.rotate()

    @property
    def current(self) -> str:
        return list(self.keys)[-1]

    def rotate(self, kid: str | None = None, secret: bytes | None = None) -> str:
        """A new key, by which tokens are signed from now on; the oldest beyond `keep` go."""
        kid = kid or secrets.token_hex(8)
        self.keys[kid] = secret or secrets.token_bytes(32)
        for old in list(self.keys)[: -self.keep]:
            del self.keys[old]
        return kid


def _part(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _json(value: dict) -> bytes:
    return json.dumps(value, separators=(",", ":")).encode()


def issue(ring: KeyRing, next_id: Callable[[], int], *, sub: str, db: str, scope: int, collection: str = "*", ttl_ms: int = 60_000, single_use: bool = True, row_filter: dict | None = None, granted: int | None = None, now_ms: int | None = None) -> str:
    """A signed token. scope must be bits of what the issuer holds itself (granted), a row filter needs a collection."""
    if not scope:
        raise ValueError("a token needs a scope")
    if granted is not None and (255 if granted & 128 else granted) & scope != scope:
        raise PermissionError("a token grants no more than its issuer holds")
    if row_filter and collection == "*":
        raise ValueError("a row filter needs a collection")
    now = time.time_ns() // 1_000_000 if now_ms is None else now_ms
    claims = {"sub": str(sub), "db": str(db), "coll": collection, "scope": scope, "jti": str(next_id()), "single_use": single_use, "row_filter": row_filter, "iat": now, "exp": now + ttl_ms}
    signed = f"{_part(_json({'alg': 'HS256', 'kid': ring.current}))}.{_part(_json(claims))}"
    return f"{signed}.{_part(hmac.new(ring.keys[ring.current], signed.encode(), hashlib.sha256).digest())}"


def _text(part: Column) -> Column:
    """The text of a base64url part; null where it is none."""
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


_HEADER = "kid string"
_CLAIMS = "sub string, db string, coll string, scope int, jti string, single_use boolean, row_filter struct<field: string, value: string>, exp long"


def verified(tokens: DataFrame, ring: KeyRing, *, seq: str, token: str = "token", now_ms: int, catalog: str, collection: str, needed: int) -> DataFrame:
    """The rows of tokens with verdict and the claims of those that are `ok` (else null).

    Tests come in the order shape, key, signature, expiry, catalog, collection, scope and, last, single use in order of the unique column seq:
    a token that fails another test uses nothing up. A null token is malformed.
    """
    parts = F.split(F.col(token), "\\.", -1)
    rows = tokens.select(F.struct(*tokens.columns).alias("row"), F.col(seq).alias("seq"), parts.alias("p"))
    rows = rows.withColumn("kid", F.when(F.size("p") == 3, F.from_json(_text(F.get("p", F.lit(0))), _HEADER)["kid"]))
    signed = F.concat_ws(".", F.get("p", F.lit(0)), F.get("p", F.lit(1)))
    right = F.lit(None).cast("string")
    for kid, secret in ring.keys.items():
        right = F.when(F.col("kid") == kid, F.base64(F.unhex(hmac_sha256(signed, secret)))).otherwise(right)
    right = F.rtrim(F.translate(right, "+/", "-_"), F.lit("="))
    rows = rows.withColumn("well", F.col("kid").isNotNull()).withColumn("kid_known", F.coalesce(F.col("kid").isin(list(ring.keys)), F.lit(False)))
    rows = rows.withColumn("signed", F.coalesce(F.get("p", F.lit(2)) == right, F.lit(False)))
    # claims count only where the signature does
    rows = rows.withColumn("c", F.when(F.col("signed"), F.from_json(_text(F.get("p", F.lit(1))), _CLAIMS)))
    rows = rows.select("row", "seq", "well", "kid_known", "signed", "c", *[F.col(f"c.{n}").alias(n) for n in ("jti", "exp", "db", "coll", "scope", "single_use")])
    out = token_verdicts(rows, now_ms=now_ms, catalog=catalog, collection=collection, needed=needed)
    verdict = F.when(~F.col("well"), "malformed").otherwise(F.col("verdict"))
    return out.select("row.*", verdict.alias("verdict"), F.when(F.col("verdict") == "ok", F.col("c")).alias("claims"))


def row_filter_of(claims: Column) -> tuple[Column, Column]:
    """Field and value of a token's row filter; null where it has none."""
    return claims["row_filter"]["field"], claims["row_filter"]["value"]
