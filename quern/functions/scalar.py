"""Native column expressions of the record store: keyed hashes, ids, names, masks and bits."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout of generated ids.
ID_EPOCH_MS = 1_700_000_000_000
ID_WORKER_BITS, ID_SEQ_BITS = 10, 12

# Permission bits.
READ, WRITE, DELETE, CREATE, DROP, ISSUE, SHARE, ADMIN = 1, 2, 4, 8, 16, 32, 64, 128
ALL = 255

DEFAULT_TTL = 300
#: Bytes of a keyed hash that are kept.
BLIND_BYTES = 16


def derive_key(secret: bytes, info: str, salt: bytes = b"", length: int = 32) -> bytes:
    """HKDF-SHA256 on the driver: one key per field, never per row."""
    prk = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out = block = b""
    i = 1
    while len(out) < length:
        block = hmac.new(prk, block + info.encode() + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text or bytes, as hex, from sha2 alone."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256))), 256)


def blind(value: Column, key: bytes) -> Column:
    """Keyed hash of a value's text, as hex: HMAC-SHA256 cut to BLIND_BYTES, from sha2 alone. Null stays null."""
    return F.substring(hmac_sha256(value.cast("string"), key), 1, 2 * BLIND_BYTES)


def blind_literal(value: object, key: bytes) -> str:
    """The same hash of one value, on the driver."""
    data = value if isinstance(value, bytes) else str(value).encode()
    return hmac.new(key, data, hashlib.sha256).hexdigest()[: 2 * BLIND_BYTES]


def bucket(value: Column, width: float) -> Column:
    """Range bucket: floor of the double quotient."""
    return F.floor(value.cast("double") / F.lit(float(width))).cast("long")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def id_of(ms: Column, worker: Column, seq: Column) -> Column:
    """A time-ordered id: milliseconds, worker, sequence."""
    return F.shiftleft((ms - ID_EPOCH_MS).cast("long"), ID_WORKER_BITS + ID_SEQ_BITS) + F.shiftleft(worker.cast("long"), ID_SEQ_BITS) + seq.cast("long")


def id_parts(i: Column) -> dict[str, Column]:
    """The inverse of id_of."""
    return {
        "ms": F.shiftright(i, ID_WORKER_BITS + ID_SEQ_BITS) + ID_EPOCH_MS,
        "worker": F.shiftright(i, ID_SEQ_BITS).bitwiseAND((1 << ID_WORKER_BITS) - 1),
        "seq": i.bitwiseAND((1 << ID_SEQ_BITS) - 1),
    }


def row_matches(field: Column, value: object) -> Column:
    """Row filter: equal as text."""
    return F.coalesce(field.cast("string") == F.lit(str(value)), F.lit(False))


def is_visible(disabled: Column) -> Column:
    """Null and false are visible."""
    return ~F.coalesce(disabled, F.lit(False))


def dns_name(name: Column) -> Column:
    """Trimmed, lower case, without one trailing dot."""
    return F.regexp_replace(F.lower(F.trim(name)), "\\.$", "")


def lookup_key(name: Column, kind: Column) -> Column:
    return F.concat_ws("|", dns_name(name), F.upper(kind))


def in_zone(name: Column, zone: Column) -> Column:
    return (name == zone) | F.endswith(name, F.concat(F.lit("."), zone))


def ancestors(name: Column, zone: Column) -> Column:
    """The name and all names above it down to the zone's apex, longest first."""
    labels = F.split(name, "\\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(every, lambda n: in_zone(n, zone))


def ttl_or_default(ttl: Column) -> Column:
    """A number in any notation, cut to whole seconds; null, zero and what is no number count as DEFAULT_TTL."""
    n = ttl.try_cast("double")
    return F.coalesce(F.nullif(n, F.lit(0.0)).try_cast("int"), F.lit(DEFAULT_TTL))


def mask_secret(text: Column) -> Column:
    """First and last four characters and the length; of short ones not even that, and nothing of empty and null ones."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    whole = F.concat(F.left(text, F.lit(4)), F.lit("…"), F.right(text, F.lit(4)), F.lit(" ("), n, F.lit("b)"))
    return F.when(n == 0, F.lit("")).when(n <= 8, F.lit("***")).otherwise(whole)


def effective(mask: Column) -> Column:
    """ADMIN means every bit."""
    return F.when(mask.bitwiseAND(ADMIN) != 0, ALL).otherwise(mask).cast("int")


def allows(mask: Column, needed: int) -> Column:
    return effective(mask).bitwiseAND(needed) == needed


def revoke(mask: Column, taken: Column) -> Column:
    """What is left when bits are taken, both expanded; null when nothing is."""
    left = effective(mask).bitwiseAND(F.bitwise_not(effective(taken)))
    return F.nullif(left, F.lit(0))


def san(name: Column) -> Column:
    """A subject alternative name without its kind, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, "^(?i:dns|ip|email|uri):", "")))


def subset(asked: Column, granted: Column) -> Column:
    return F.size(F.array_except(asked, granted)) == 0


def to_bool(v: Column) -> Column:
    """true and 1 are true, anything else false."""
    return F.coalesce(v.cast("string").isin("true", "1"), F.lit(False))


def varint(v: Column) -> Column:
    """A number as groups of seven bits, the lowest first, all but the last marked by the high bit; negative ones as unsigned."""
    n = F.ceil(F.length(F.bin(v)) / 7).cast("int")
    group = lambda i: F.call_function("shiftrightunsigned", v, (i * 7).cast("int")).bitwiseAND(127)
    byte = lambda i: F.lpad(F.hex(group(i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), ""))


def unvarint(b: Column) -> Column:
    """The inverse of varint."""
    at = F.sequence(F.lit(0), F.length(b) - 1)
    byte = lambda i: F.conv(F.hex(F.call_function("substring", b, i + 1, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", byte(i).bitwiseAND(127), (i * 7).cast("int"))))


def id_bytes(i: Column) -> Column:
    """An id as eight bytes, the highest first, so that bytes sort as ids do."""
    return F.unhex(F.lpad(F.hex(i), 16, "0"))


def bytes_id(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("long")


def thumbprint(data: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(data, 256), 1, 16)


def renew_due(now: Column, issued: Column, expires: Column) -> Column:
    """Whether two thirds of a lifetime are over."""
    return (now - issued) * 3 >= (expires - issued) * 2


def zigzag(v: Column) -> Column:
    """Signed to unsigned of small magnitude."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(1))
