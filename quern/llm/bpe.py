"""Byte-level BPE with forced boundaries.

A merge can only ever make a vocabulary token, so two neighbouring bytes that stand side
by side inside no token are never joined: between them there is a certain cut. The
pre-tokenizer must agree with a cut as well. A step from a character that is no white
space to white space always ends a pre-token and no look-ahead reaches over it, so whole
texts are cut at the forced pairs of that kind: before every space, where the table of
pairs shows that no token holds a space after another character and no white space stands
before it; else where a look-up of all pairs of bytes finds printable ASCII before ASCII
white space. The fragments are encoded independently, each distinct one once while it
stays in a bounded cache, and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fragments that a worker remembers; forgotten all at once when full.
CACHE = 300_000

#: White space before a space: there the pre-tokenizer looks ahead, and a cut needs a closer look.
_RUN = re.compile(r"\s ")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers file with byte-level BPE, no normalizer and the usual pattern.

    Added special tokens in a text become their ids, as in the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, of = spec["model"], spec["pre_tokenizer"], byte_chars()
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE of the kind supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        made = [vocab[bytes(of[c] for c in a + b)] for a, b in pairs]
        if made != sorted(made) or len(set(made)) != len(made):
            raise ValueError(f"{path}: merges are not in the order of ids")
        whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self._encode = lambda text: whole.encode_to_numpy(text, disallowed_special=())
        self.piece: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.piece[i] = t
        for t, i in self.special.items():
            self.piece[i] = t.encode()
        self._len = np.array([len(p) for p in self.piece])
        inside = np.zeros((256, 256), bool)
        for t in vocab:
            for a, b in zip(t, t[1:]):
                inside[a, b] = True
        left = np.zeros(256, bool)
        left[0x21:0x7F] = True
        right = np.zeros(256, bool)
        right[list(b"\t\n\r ")] = True
        #: forced[a * 256 + b]: no token holds a, b side by side
        self.forced = ~inside.reshape(-1)
        self._cuts = self.forced & (left[:, None] & right[None, :]).reshape(-1)
        #: whether a cut stands before the space after any character that is not white space (tokens of white space alone hold none such)
        self._each_space = not any(b" " in t[1:] for t in vocab if not t.decode("utf-8", "replace").isspace())
        self._cache: dict[str, bytes] = {}

    def fragments(self, text: str) -> list[str]:
        """The text, cut at certain cuts; every fragment but the first begins with a space."""
        if self._each_space and not _RUN.search(text):
            first, *rest = text.split(" ")
            return [first, *[" " + w for w in rest]]
        data = text.encode()
        b = np.frombuffer(data, np.uint8)
        at = (np.flatnonzero(self._cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1).tolist()
        return [data[i:j].decode() for i, j in zip([0, *at], [*at, len(data)])]

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        cache = self._cache
        if self._each_space and not _RUN.search(text):
            first, *keys = text.split(" ")  # a key stands for the fragment of a space and itself
            parts, space = [cache.get(k) for k in keys], " "
            head = self._encode(first).tobytes()
        else:
            keys = self.fragments(text)
            parts, space, head, cache = [None] * len(keys), "", b"", {}
        if None in parts:
            if len(cache) > CACHE:
                cache.clear()
            # what is missing is encoded in one call: fragments meet at certain cuts again, whatever stood between them
            new = list(dict.fromkeys([k for k, p in zip(keys, parts) if p is None]))
            ids = self._encode(space + space.join(new))
            ends = np.searchsorted(np.cumsum(self._len[ids]), np.cumsum([len(k.encode()) + len(space) for k in new])) + 1
            raw, i, fresh = ids.tobytes(), 0, {}
            for k, j in zip(new, (4 * ends).tolist()):
                fresh[k] = raw[i:j]
                i = j
            cache.update(fresh)
            parts = [fresh[k] if p is None else p for k, p in zip(keys, parts)]
        return head + b"".join(parts)

    def encode(self, text: str, *, cut: bool = True) -> np.ndarray:
        """Ids (uint32) of a text; without cut, text between special tokens is encoded in one piece (same ids)."""
        plain = self._plain if cut else lambda t: self._encode(t).tobytes()
        parts = [text]
        for token in self.special:
            parts = [x for p in parts for x in _interleave(p.split(token), token)] if token in text else parts
        if len(parts) == 1:
            return np.frombuffer(plain(text), np.uint32)
        return np.frombuffer(b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else plain(p) for p in parts), np.uint32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 are replaced."""
        piece = self.piece
        return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")


def _interleave(parts: list[str], token: str) -> list[str]:
    return [x for p in parts for x in (token, p)][1:]


@lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and file."""
    return ForcedBoundaryBPE(path)


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids = bpe.encode(t or "").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _text(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the tokens of every whole text; a null text has none."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_ids(path or tokenizer_path()), "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the inverse of encode_documents; null ids give the empty text."""
    small_batches(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(_text(path or tokenizer_path()), "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, one row per row of docs.

    The whole text is encoded and its ids are decoded again, in one pass and with no
    shuffle. A null text counts as empty; a null doc_id stays null; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(path or tokenizer_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
