"""Sequence packing by non-negative least squares on the histogram of lengths.

A task tokenizes its documents and packs them block by block (BLOCK pieces, so memory is
bounded and nothing is shuffled). Whole windows of long documents are cut off first. The
lengths that remain are counted in steps of STEP tokens, rounded up. All ways to fill a
window with at most DEPTH lengths are enumerated, and an active-set solver finds the
non-negative repeat counts that come closest to the histogram. Counts are rounded, pieces
are dealt to the windows so planned, and what is left over is packed greedily, longest
first, where a document is cut when it doesn't fit. The steps' rounding leaves gaps of a
few tokens, which are closed by cutting too. The end of a block that fills no window
becomes sequences whose lengths are powers of two, so there is no padding at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load, tokenizer_path
from .common import small_batches

WINDOW = 2048
#: Pieces, and tokens, that a task holds at a time.
BLOCK, BLOCK_TOKENS = 8192, 8_000_000
#: Steps in a window, by which lengths are counted.
STEPS = 64
DEPTH = 3
END = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def strategies(steps: int = STEPS, depth: int = DEPTH) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Every multiset of at most `depth` lengths (in steps) that fills a window, as columns of counts."""

    def ways(left: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif deep:
            for x in range(min(left, most), 0, -1):
                for rest in ways(left - x, x, deep - 1):
                    yield (x, *rest)

    found = list(ways(steps, steps, depth))
    a = np.zeros((steps, len(found)))
    for j, combo in enumerate(found):
        for x in combo:
            a[x - 1, j] += 1
    return a, found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Active-set non-negative least squares (Lawson and Hanson): x >= 0 with |ax - b| least."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if active.all() or w.max() <= 1e-9 * max(1.0, float(b.max(initial=0))):
            break
        active[np.argmax(w)] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                break
            bad = z <= 1e-12
            old = x[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = float(np.nanmin(np.where(bad, old / (old - z), np.inf)))
            moved = old + (t if np.isfinite(t) else 0.0) * (z - old)
            x[at] = np.where(moved <= 1e-12, 0, moved)
            x[at[bad & (moved <= 1e-9)]] = 0
            drop = at[x[at] == 0]
            if not len(drop):
                drop = at[bad][:1]
                x[drop] = 0
            active[drop] = False
        x[:] = 0
        x[at] = z
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, steps: int = STEPS, depth: int = DEPTH) -> tuple[list[list[int]], list[int]]:
    """Windows as lists of indices of lengths (all below window), and the indices left over, longest first."""
    bins = -(-lengths * steps // window)
    order = np.lexsort((lengths, bins))  # by bin, the longest last
    counts = np.bincount(bins, minlength=steps + 1)[1:]
    ends = np.cumsum(counts)
    stacks = [order[e - c : e].tolist() for c, e in zip(counts, ends)]
    a, found = strategies(steps, depth)
    repeats = np.rint(nnls(a, counts.astype(float))).astype(int)
    out = []
    for j in np.flatnonzero(repeats):
        for _ in range(repeats[j]):
            need = found[j]
            if any(len(stacks[x - 1]) < need.count(x) for x in need):
                break
            out.append([stacks[x - 1].pop() for x in need])
    rest = [i for s in stacks for i in s]
    return out, sorted(rest, key=lambda i: (-lengths[i], i))


class _Packer:
    def __init__(self, window: int, first_id: int):
        self.window, self.next_id, self.rows = window, first_id, []

    def _emit(self, doc: tuple, start: int, length: int, seq: int, offset: int) -> None:
        doc_id, ids = doc
        self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), seq, offset))

    def whole(self, doc: tuple) -> tuple | None:
        """Cut off a document's full windows; returns what is left as (document, start, length)."""
        n, w = len(doc[1]), self.window
        for s in range(0, n - n % w, w):
            self._emit(doc, s, w, self.next_id, 0)
            self.next_id += 1
        return (doc, n - n % w, n % w) if n % w else None

    def block(self, pieces: list[tuple]) -> None:
        if not pieces:
            return
        planned, rest = plan(np.array([p[2] for p in pieces]), self.window)
        todo = [pieces[i] for i in rest][::-1]  # taken from the end: longest first

        def fill(seq: list[tuple], room: int) -> None:
            """Greedily: the longest that fits, else a cut one."""
            while room and todo:
                doc, start, n = todo.pop()
                if n > room:
                    todo.append((doc, start + room, n - room))
                    n = room
                seq.append((doc, start, n))
                room -= n

        for chosen in planned:
            seq = [pieces[i] for i in chosen]
            fill(seq, self.window - sum(p[2] for p in seq)) if todo else None
            self._close(seq)
        while todo:
            seq: list[tuple] = []
            fill(seq, self.window)
            self._close(seq)

    def _close(self, seq: list[tuple]) -> None:
        """Number the pieces of a sequence; one that isn't full falls into powers of two."""
        left = sum(p[2] for p in seq)
        queue = seq[::-1]
        while left:
            size = 1 << (left.bit_length() - 1) if left < self.window else left
            offset = 0
            while offset < size:
                doc, start, n = queue.pop()
                take = min(n, size - offset)
                if take < n:
                    queue.append((doc, start + take, n - take))
                self._emit(doc, start, take, self.next_id, offset)
                offset += take
            self.next_id += 1
            left -= size


def _pack(path: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, packer = load(path), _Packer(window, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []
        tokens = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows)) or [[]] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(bpe.encode(text or "", cut=False), np.uint32(END))
                if rest := packer.whole((doc_id, ids)):
                    held.append(((doc_id, ids), rest[1], rest[2]))
                    tokens += len(ids)
                if len(held) >= BLOCK or tokens >= BLOCK_TOKENS:
                    packer.block(held)
                    held, tokens = [], 0
            yield out()
        packer.block(held)
        yield out()

    return run


def pack_documents(docs: DataFrame, *, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """All documents as pieces in sequences of at most `window` tokens; one row per piece.

    A document is its ids and the end id; a null text counts as empty and so is the end id
    alone. start counts the document's ids before the piece, doc_tokens all of them;
    offsets in a sequence have no gaps. Sequences are full, or their length is a power of
    two. A null doc_id stays null, repeated rows are packed each, an empty table gives no
    piece. sequence_id is the task's number and a count.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(path or tokenizer_path(), window), PIECE)
