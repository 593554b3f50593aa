"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Beside them, candidate strings (runs of token
characters with a digit) are slid over by a window of WINDOW characters; the window's
Shannon entropy is kept by integer counts of the characters inside, of which one goes and
one comes at every step. A candidate whose best window reaches the threshold of its
character class is a span too, unless an allow-list entry suppresses it.

Positions come from one regexp_replace per kind that puts markers around matches, and from
running sums over the lengths between markers, in a window by document: linear, however
many matches a text has. Only lengths and matches are shuffled, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the base patterns.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_MIN = 6
# Runs of one class: the shortest length in the pattern is the same as dropping short matches.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

WINDOW = 20
_TOKEN = "A-Za-z0-9+/=_-"
#: A whole run of token characters that holds a digit; only the start of a run is tried.
CANDIDATE = f"(?<![{_TOKEN}])(?=[A-Za-z+/=_-]*+[0-9])[{_TOKEN}]{{{WINDOW},}}+"
#: Bits of entropy in a window that make a span, by character class (of at most 4 and log2(WINDOW) = 4.32).
HEX_BITS, BASE64_BITS = 3.0, 3.8
#: Candidates that are no secrets: numbers, UUIDs, dashed or underscored words, paths of words, alphabets and keys of documentation.
ALLOW = (
    "[0-9+/=_-]+",
    "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "[A-Za-z]*([-_/][A-Za-z]+)+[-_/]?[0-9]{0,4}",
    "[0-9]{1,4}([-_/][0-9]{1,4}){2}[-_/A-Za-z]*",
    ".*([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]).*",
    ".*(abcdefghijklmnop|ABCDEFGHIJKLMNOP).*",
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
BASE = 3
MASK = "[secret]"
_OPEN, _CLOSE, _STAND_IN = "\u0001", "\u0002", "\u0003"
_SCALE = 1 << 20


def _cells(c: int) -> int:
    return round(c * math.log2(c) * _SCALE) if c else 0


def _least(bits: float) -> int:
    """The sum of c log2 c over a window's counts below which its entropy is at least bits."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * _SCALE)


def window_sum(v: Column) -> Column:
    """The least sum of c log2 c over all windows of an ASCII string of WINDOW characters or more (scaled integer)."""
    codes = F.transform(F.split(v, ""), F.ascii)
    f = F.array(*[F.lit(_cells(c)).cast("long") for c in range(WINDOW + 2)])
    # counts of the 128 characters, their sum, the least sum so far
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(1 << 62).cast("long").alias("least"))

    def over(c: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            come, go = F.get(c, i), F.get(c, i - WINDOW)  # nothing goes in the first window
            cnt_in, cnt_out = F.get(a["n"], come), F.get(a["n"], go)
            same = F.coalesce(come == go, F.lit(False))
            plus = F.get(f, cnt_in + 1) - F.get(f, cnt_in)
            minus = F.coalesce(F.get(f, cnt_out - 1) - F.get(f, cnt_out), F.lit(0).cast("long"))
            s = F.when(same, a["s"]).otherwise(a["s"] + plus + minus)
            n = F.when(same, a["n"]).otherwise(F.transform(a["n"], lambda x, k: x + (k == come).cast("int") - F.coalesce((k == go).cast("int"), F.lit(0))))
            return F.struct(n.alias("n"), s.alias("s"), F.when(i >= WINDOW - 1, F.least(a["least"], s)).otherwise(a["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), start, step, lambda a: a["least"])

    # an array of one element binds the codes to a variable, so that they are computed once
    return F.transform(F.array(codes), over)[0]


def is_secret(v: Column) -> tuple[Column, Column]:
    """Whether a candidate is a span of the hex class, and of the base64 class."""
    hexa = v.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    allowed = F.lit(False)
    for p in ALLOW:
        allowed = allowed | v.rlike(f"^(?:{p})$")
    limit = F.when(hexa, F.lit(_least(HEX_BITS))).otherwise(F.lit(_least(BASE64_BITS)))
    found = F.when(allowed, False).otherwise(window_sum(v) <= limit)
    return found & hexa, found & ~hexa


def _parts(text: Column, pattern: str) -> Column:
    """The text around and in the matches, in turn; the first is outside."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)


def _clean(text: Column) -> Column:
    """The text with markers of our own replaced by a character that no pattern holds either; positions stay."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, _STAND_IN * 2)).otherwise(text)


def _holds(kind: Column, v: Column) -> Column:
    return (kind != 0) | (F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= ASSIGN_MIN)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base (text), spans (text).

    docs has doc_id and text; other columns are not read. base and spans list
    kind:start:end (code points, end exclusive) by start, then kind in the order of KINDS,
    joined by commas. A null text counts as empty; repeated rows give a row each. Texts of
    any length are read as a whole.
    """
    text = _clean(F.col("text"))
    found = []
    for i, pattern in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE)):
        kind = F.lit(i).alias("kind")
        cut = F.transform(_parts(text, pattern), lambda p, j: F.struct(kind, j.alias("pos"), F.char_length(p).alias("n"), F.when(j % 2 == 1, p).alias("v")))
        found.append(F.when(F.size(cut) > 1, cut).otherwise(F.slice(cut, 1, 0)))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(*found).alias("cuts"))
    rows = rows.select("uid", "doc_id", F.explode_outer("cuts").alias("cut")).select("uid", "doc_id", "cut.*")
    rows = rows.repartition("uid")
    start = F.coalesce(F.sum("n").over(Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start)
    hexa, b64 = is_secret(F.col("v"))
    kind = F.when(F.col("v").isNull(), None).when(F.col("kind") < BASE, F.when(_holds(F.col("kind"), F.col("v")), F.col("kind"))).when(hexa, 3).when(b64, 4)
    rows = rows.withColumn("found", kind)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("found") + 1)
    span = F.when(F.col("found").isNotNull(), F.struct("start", "found", F.concat_ws(":", name, "start", F.col("start") + F.col("n")).alias("s")))
    counts = [F.count(F.when(F.col("found") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    by_doc = rows.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), *counts, F.array_sort(F.collect_list(span)).alias("all"))
    listed = lambda keep: F.array_join(F.transform(keep, lambda x: x["s"]), ",")
    return by_doc.select("doc_id", "n_assign", "n_access", "n_hex", (F.col("n_entropy_hex") + F.col("n_entropy_base64")).alias("n_entropy"), listed(F.filter("all", lambda x: x["found"] < BASE)).alias("base"), listed(F.col("all")).alias("spans"))


def _hider(kind: int, pattern: str) -> Callable[[Column], Column]:
    def hide(p: Column, j: Column) -> Column:
        hexa, b64 = is_secret(p)
        bad = hexa | b64 if kind == BASE else _holds(F.lit(kind), p)
        return F.when((j % 2 == 1) & bad, F.lit(MASK)).otherwise(p)

    return lambda t: F.when(t.rlike(pattern), F.array_join(F.transform(_parts(t, pattern), hide), "")).otherwise(t)


def mask(text: Column) -> Column:
    """The text with MASK in the place of every span; row by row, with no shuffle. Null stays null."""
    out = _clean(text)
    for i, pattern in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE)):
        # texts without a match are not taken apart
        out = F.transform(F.array(out), _hider(i, pattern))[0]
    return F.when(text.isNotNull(), out)


def scrub(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text, and n_chars (if there) of the new text; all rows and columns stay."""
    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
