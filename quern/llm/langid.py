"""Language identification by prediction by partial matching (PPM).

For every language a context tree of order ORDER over bytes is learned and frozen. A byte
is coded in the longest context that was seen in that language: with n occurrences of the
context and d different successors, a successor seen c times has probability c / (n + d),
and the escape d / (n + d) leads to the next shorter context, down to the uniform
distribution (method C, without exclusions). A text gets the language with the least
total code length, and the score is that language's posterior at equal priors.

As statistics are frozen, the code length of a byte depends on itself and the bytes
before it alone. The trees of all languages are therefore compiled into one table of
states (contexts) by symbols that holds all languages' code lengths, and whole
batches of texts are scored by array look-ups.

Training reads a bounded sample: of each language TRAIN_DOCS whole documents in
expectation, chosen by a hash of doc_id. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ORDER = 3
#: Documents of each language that the training sample holds in expectation.
TRAIN_DOCS = 2000
#: Byte symbols that are told apart; rarer bytes share symbol 0.
SYMBOLS = 96
#: Contexts of the full order become states when seen so often in the sample, over all languages.
MIN_SEEN = 4
#: Bytes that are scored at a time.
CHUNK = 1 << 20

UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # of each byte
    state: np.ndarray  # of the three symbols before
    bits: np.ndarray  # (states * symbols, languages)

    @property
    def k(self) -> int:
        return int(self.symbol.max()) + 1

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code lengths in bits, (texts, languages), of the texts that begin at starts in data."""
        out = np.zeros((len(starts), len(self.langs)))
        ends = np.append(starts[1:], len(data))
        i = 0
        while i < len(starts):
            j = i + 1
            while j < len(starts) and ends[j] - starts[i] <= CHUNK:
                j += 1
            lo, hi = int(starts[i]), int(ends[j - 1])
            for at in range(lo, hi, CHUNK):  # more than one step for one very long text only
                back = min(ORDER, at - lo)
                part = data[at - back : min(hi, at + CHUNK)]
                rel = np.clip(starts[i:j] - (at - back), 0, None) if at == lo else np.array([0])
                rows = self._rows(part, rel)[back:]
                if at == lo:
                    full = ends[i:j] > starts[i:j]
                    out[i:j][full] += np.add.reduceat(rows, rel[full], axis=0, dtype=float) if full.any() else 0
                else:
                    out[i] += rows.sum(0, dtype=float)
            i = j
        return out

    def _rows(self, part: np.ndarray, starts: np.ndarray) -> np.ndarray:
        s = self.symbol[part].astype(np.int32)
        starts = starts[starts < len(s)]
        before = [s]
        for _ in range(ORDER):
            shifted = np.empty_like(s)
            shifted[1:] = before[-1][:-1]
            shifted[:1] = 0
            shifted[starts] = 0
            before.append(shifted)
        k = self.k
        return self.bits[self.state[(before[3] * k + before[2]) * k + before[1]] * k + s]


def build(langs: list[str], grams: np.ndarray, counts: np.ndarray, byte_counts: np.ndarray) -> Model:
    """The compiled model. grams: four bytes in an integer, oldest highest; counts (grams, languages)."""
    top = np.argsort(-byte_counts, kind="stable")[: SYMBOLS - 1]
    symbol = np.zeros(256, np.uint8)
    symbol[np.sort(top[byte_counts[top] > 0])] = np.arange(1, 1 + (byte_counts[top] > 0).sum())
    k, n_lang = int(symbol.max()) + 1, len(langs)
    shared = max(1, 256 - (k - 1))  # bytes behind symbol 0
    s = [symbol[(grams >> (8 * i)) & 255].astype(np.int64) for i in range(4)]  # s[0] is coded, s[3] the oldest
    first = np.zeros((k, k, k), np.int64)
    np.add.at(first, (s[3], s[2], s[1]), counts.sum(1))
    kept = np.flatnonzero(first.reshape(-1) >= MIN_SEEN)
    state = np.tile(np.arange(k * k, dtype=np.int32), k)
    state[kept] = k * k + np.arange(len(kept))

    bits = np.empty((k * k + len(kept), k, n_lang), np.float32)
    for lang in range(n_lang):
        c = counts[:, lang].astype(float)
        p = np.full(k, 1 / 256)
        p[0] = shared / 256
        uni = np.bincount(s[0], c, k)
        p = _blend(uni[None], p[None])[0]
        duo = np.bincount(s[1] * k + s[0], c, k * k).reshape(k, k)
        p1 = _blend(duo, np.broadcast_to(p, (k, k)))
        tri = np.bincount((s[2] * k + s[1]) * k + s[0], c, k**3).reshape(k * k, k)
        p2 = _blend(tri, p1[np.arange(k * k) % k])
        bits[: k * k, :, lang] = -np.log2(p2)
        index = np.full(k**3, -1, np.int64)
        index[kept] = np.arange(len(kept))
        at = index[(s[3] * k + s[2]) * k + s[1]]
        quad = np.bincount(at[at >= 0] * k + s[0][at >= 0], c[at >= 0], len(kept) * k).reshape(-1, k)
        bits[k * k :, :, lang] = -np.log2(_blend(quad, p2[kept % (k * k)]))
    # a byte behind symbol 0 shares its probability with the others there
    bits[:, 0, :] += np.float32(np.log2(shared))
    return Model(langs, symbol, state, bits.reshape(-1, n_lang))


def _blend(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """PPM method C: probabilities of each context's successors, escaping to the shorter context."""
    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    scale = np.maximum(total + kinds, 1)
    return np.where(total > 0, np.where(n > 0, n / scale, kinds / scale * shorter), shorter)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-byte grams of the sample by language; three zero bytes stand before a text."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def counted(lang: str) -> tuple[np.ndarray, np.ndarray]:
        part = held.pop(lang)
        grams = np.concatenate([g for g, _ in part])
        u, inv = np.unique(grams, return_inverse=True)
        return u, np.bincount(inv, np.concatenate([c for _, c in part])).astype(np.int64)

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            x = np.frombuffer(b"\0\0\0" + text, np.uint8).astype(np.int64)
            g = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
            held.setdefault(lang, []).append(np.unique(g, return_counts=True))
            size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
            if size[lang] > 2_000_000:
                held[lang] = [counted(lang)]
                size[lang] = 0
    for lang in list(held):
        u, c = counted(lang)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(c)], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of the languages in docs (doc_id, text, lang); None if no row has both text and lang.

    The sample's grams come to the driver; train_docs bounds their number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and text <> ''")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = spark.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = docs.join(F.broadcast(share), "lang").where(drawn | (F.col("share") >= 1)).select("lang", F.col("text").cast("binary").alias("text"))
    table = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    grams, at = np.unique(table.column("gram").to_numpy(), return_inverse=True)
    column = np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist()))
    counts = np.zeros((len(grams), len(langs)), np.int64)
    counts[at, column] = table.column("n").to_numpy()
    return build(langs, grams, counts, np.bincount(grams & 255, counts.sum(1), 256))


def _score(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            text = b.column("text").fill_null(b"").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = text.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            bits = model.lengths(data, (offsets - offsets[0])[:-1])
            best = bits.argmin(1)
            score = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            known = b.column("letters").to_numpy(zero_copy_only=False)
            pred = [model.langs[i] if x else UNDETERMINED for i, x in zip(best.tolist(), known)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c not in ("text", "letters")), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*(c for c in b.schema.names if c not in ("text", "letters")), "lang_pred", "score"])

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, keep: dict[str, str]) -> DataFrame:
    """The kept columns (name: type) with lang_pred and score of every whole text.

    A text that is null or has no letter, and every text where no model could be learned,
    is `und` with score 0.
    """
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"), has_letter(F.col("text")).alias("letters"))
    return rows.mapInArrow(_score(shipped), ", ".join(f"`{c}` {t}" for c, t in (keep | {"lang_pred": "string", "score": "double"}).items()))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never trained on: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    docs has doc_id, text and lang. Rows with a null lang, a null or empty text, a null doc_id or a
    held-out doc_id are not learned from; all rows are predicted, from text alone. Ties go
    to the first language in alphabetical order.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), train_docs=train_docs)
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(rows, model, {"doc_id": "long", "held_out": "boolean"})
