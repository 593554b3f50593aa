"""Near-duplicates by improved consistent weighted sampling (ICWS) of TF-IDF shingles.

1. A counting sketch of fixed size over all documents gives document frequencies of
   shingles; frequent ones stand out of the sketch's noise. A shingle's weight is
   tf * (1 + log(1 + N / df) / log(1 + N)), so boilerplate counts less than rare text, but
   never less than half.
2. ICWS draws BANDS * ROWS samples per document; two documents agree in a sample with
   the probability of their weighted Jaccard similarity. Documents with the same words
   are one node from here on.
3. Documents that agree in all samples of a band meet in a bucket. In a bucket each is
   compared with its pivot (the member of least digest), and, if it is not much like it,
   with the bucket's other leaders; a candidate pair must agree in MIN_AGREE samples.
   Large groups of copies thus give a few pairs per document, not all pairs.
4. Candidates are verified on their whole shingle sets: a link has a weighted Jaccard
   similarity of at least the threshold, or a plain one.
5. What the pivots and leaders left out: in a bucket that still holds several components
   of links, members of different components that agree in REST_AGREE samples are
   verified too. They are found block by block; those that have such a partner meet again
   with their shingle sets and are verified within the block, the most alike first. A
   block gives links that join components, not pairs. No such pair is left unverified,
   but for those that links of their block have joined.
6. Components of all links are the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import attach, discard, small_batches, stable, written
from .components import components

THRESHOLD = 0.8
ROWS, BANDS = 3, 12
SAMPLES = ROWS * BANDS
#: Samples in which a candidate pair agrees; with a similarity of 0.8 fewer have a probability of about 1e-8.
MIN_AGREE = 14
#: The same for pairs that no pivot or leader stands for; with a similarity of 0.8 fewer have a probability of about 2e-4.
REST_AGREE = 20
#: Members of a bucket that are compared with as many others in one block, about.
BLOCK = 2048
#: Partners of a member in a block, round by round; the last round verifies all that still differ in root within the blocks.
PARTNERS = (None,)
#: Candidates of a member that are verified at once within a block.
AT_ONCE = 64
#: Pairs in an Arrow batch that a block gives.
PAIR_ROWS = 1 << 16
#: A document that agrees in so many samples with a leader is not one itself.
NEAR = 30
#: Leaders other than the pivot to which a document is paired, the most alike.
BEST = 2
SKETCH_BITS = 16
#: Random triples of ICWS per sample; a shingle uses the one that its hash points to.
TRIPLES_BITS = 12
#: Bits of the filter that keeps documents without a candidate pair out of the verification's shuffle.
FILTER_BITS = 25

_U = np.uint64


@dataclass
class Idf:
    """Estimated document frequencies: two rows of counters over all documents."""

    n_docs: int
    counts: np.ndarray  # (2, 1 << SKETCH_BITS)

    def weight(self, h: np.ndarray) -> np.ndarray:
        """Inverse document frequency, between 1 and 2."""
        a, b = slots(h)
        noise = self.counts.mean(1)
        df = np.minimum(self.counts[0][a] - noise[0], self.counts[1][b] - noise[1])
        n = max(self.n_docs, 2)
        return 1 + np.log1p(n / np.clip(df, 1, n)) / np.log1p(n)


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64), ((h * _U(0xD6E8FEB86659FD93)) >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _bags(block: pa.RecordBatch):
    data, offsets = sh.raw(block.column("text"))
    w = sh.words(data, offsets)
    n = block.num_rows
    return w, data, offsets, *sh.bags(*sh.shingles(w, n))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << SKETCH_BITS), np.int64)
    docs = 0
    for b in batches:
        docs += b.num_rows
        for block in sh.blocks(b):
            h = _bags(block)[3]
            for row, at in zip(counts, slots(h)):
                row += np.bincount(at, minlength=len(row))
    flat = counts.reshape(-1)
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs, *flat[at].tolist()], pa.int64())], names=["slot", "n"])


def document_frequencies(texts: DataFrame) -> Idf:
    """The sketch over all texts; 2 << SKETCH_BITS counters come to the driver, whatever the input."""
    got = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros(2 << SKETCH_BITS)
    counts[slot[slot >= 0]] = n[slot >= 0]
    return Idf(int(n[slot < 0].sum()), counts.reshape(2, -1))


class Icws:
    """Consistent weighted samples of weighted sets."""

    def __init__(self, seed: int = 7, samples: int = SAMPLES):
        rng = np.random.Generator(np.random.PCG64(seed))
        shape = (samples, 1 << TRIPLES_BITS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=_U) * _U(2) + _U(1)

    def samples(self, h: np.ndarray, log_w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sample hashes (sets, samples) of the sets that begin at first; elements sorted by hash in each."""
        out = np.empty((len(first), len(self.odd)), _U)
        sizes = np.diff(np.append(first, len(h)))
        log_w = log_w.astype(np.float32)
        for k in range(len(self.odd)):
            at = ((h * self.odd[k]) >> _U(64 - TRIPLES_BITS)).astype(np.int64)
            r, beta = self.r[k][at], self.beta[k][at]
            t = np.floor(log_w / r + beta)
            a = self.log_c[k][at] - r * (t - beta) - r
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
            won = hit[np.searchsorted(hit, first)]  # ties: the smallest hash
            out[:, k] = sh.mix(h[won] * self.odd[k] + t[won].astype(np.int64).view(_U))
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), _U)
    for i in range(BANDS):
        for j in range(ROWS):
            keys[:, i] = sh.mix(keys[:, i] * _U(31) + samples[:, i * ROWS + j] + _U(i + 1))
    return keys.view(np.int64)


def _signer(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, icws = shipped.value, Icws()
        for b in batches:
            for block in sh.blocks(b):
                w, data, offsets, h, rows, tf = _bags(block)
                n = block.num_rows
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                keys, marks, size, mass = [None] * n, [None] * n, np.zeros(n, np.int32), np.zeros(n)
                if len(first):
                    weight = tf * idf.weight(h)
                    s = icws.samples(h, np.log(weight), first)
                    size[rows[first]], mass[rows[first]] = np.diff(np.append(first, len(h))), np.add.reduceat(weight, first)
                    low = s.astype(np.uint8)
                    for i, row in enumerate(rows[first].tolist()):
                        marks[row] = low[i].tobytes()
                    for row, k in zip(rows[first].tolist(), band_keys(s).tolist()):
                        keys[row] = k
                yield pa.RecordBatch.from_arrays(
                    [block.column("uid"), block.column("doc_id"), pa.array(sh.classes(w, data, offsets), pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(size), pa.array(mass)],
                    names=["uid", "doc_id", "node", "keys", "marks", "size", "mass"],
                )

    return run


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(-1)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of buckets whose rows come together."""
    key, lead, lead_marks, count = None, [], np.zeros((64, SAMPLES), np.uint8), 0
    for b in batches:
        if not b.num_rows:
            continue
        nodes, keys = b.column("node").to_pylist(), b.column("key").to_numpy()
        pivots = b.column("pivot").to_pylist()
        marks = np.frombuffer(b"".join(b.column("marks").to_pylist()), np.uint8).reshape(-1, SAMPLES)
        with_pivot = _agree(marks, np.frombuffer(b"".join(b.column("pivot_marks").to_pylist()), np.uint8).reshape(-1, SAMPLES)).tolist()
        left, right = [], []
        for i, (node, k, pivot, like) in enumerate(zip(nodes, keys.tolist(), pivots, with_pivot)):
            if k != key:
                key, lead, count = k, [], 0
            if node == pivot:
                continue
            if like >= MIN_AGREE:
                left.append(pivot)
                right.append(node)
            if like >= NEAR:
                continue
            near = 0
            if count:
                got = _agree(lead_marks[:count], marks[i])
                for j in np.argsort(-got, kind="stable")[:BEST].tolist():
                    if got[j] >= MIN_AGREE:
                        left.append(lead[j])
                        right.append(node)
                near = int(got.max())
            if near < NEAR:
                if count == len(lead_marks):
                    lead_marks = np.concatenate([lead_marks, np.zeros_like(lead_marks)])
                lead_marks[count] = marks[i]
                lead.append(node)
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes (node, keys, marks; a written table) that may be near-duplicates."""
    rows = nodes.select("node", "marks", F.explode("keys").alias("key"))
    found = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    pivots = nodes.select(F.col("node").alias("pivot"), F.col("marks").alias("pivot_marks"))
    found = written(found.join(pivots, "pivot"), "buckets")
    total = nodes.count() * BANDS
    met = attach(rows, found, "key", "members", total).select("key", "node", "marks", "pivot", "pivot_marks")
    # by range, so that a bucket of any size is shared among tasks; the pivot is known to each
    dealt = met.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    pairs = dealt.mapInArrow(_leaders, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sides(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Marks, roots (small numbers) and the places of the two sides of a block; one of one side only is compared with itself."""
    marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, SAMPLES)
    root = np.unique(np.frombuffer(b"".join(t.column("root").to_pylist()), _U).reshape(-1, 2), axis=0, return_inverse=True)[1].reshape(-1)
    first = t.column("first").to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    return marks, root, left, right if len(right) else left


def _agreements(marks: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many samples the two sides agree; 0 for the same root."""
    got = np.zeros((len(left), len(right)), np.int8)
    for n, i in enumerate(left.tolist()):
        got[n] = np.where(root[right] != root[i], _agree(marks[right], marks[i]), 0)
    return got


def _block_pairs(rows: list[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a block's two sides that differ in root and agree, for each row the `most` most alike (None: all).

    A pair of nulls says that agreeing pairs were left out.
    """
    t = pa.Table.from_batches(rows)
    node = np.array(t.column("node").to_pylist(), object)
    marks, root, left, right = _sides(t)
    alone = left is right
    got = _agreements(marks, root, left, right)
    take = found = got >= REST_AGREE
    if most is not None:
        take = np.zeros_like(found)
        for side, into in ((got, take), (got.T, take.T)):
            n = min(most, side.shape[1])
            if n:
                np.put_along_axis(into, np.argpartition(side, side.shape[1] - n, axis=1)[:, -n:], True, axis=1)
        take &= found
    if alone:
        take = np.triu(take | take.T)
        found = np.triu(found)
    x, y = np.nonzero(take)
    for lo in range(0, len(x), PAIR_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(node[at[i[lo : lo + PAIR_ROWS]]].tolist(), pa.binary()) for at, i in ((left, x), (right, y))], names=["a", "b"])
    if len(x) < np.count_nonzero(found):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary())] * 2, names=["a", "b"])


def _block_members(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block that agree with one of the other side and of another root."""
    t = pa.Table.from_batches(rows)
    marks, root, left, right = _sides(t)
    found = _agreements(marks, root, left, right) >= REST_AGREE
    keep = np.zeros(len(root), bool)
    keep[left[found.any(1)]] = True
    keep[right[found.any(0)]] = True
    yield from t.filter(pa.array(keep)).to_batches()


def _block_links(rows: list[pa.RecordBatch], idf: Idf, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of a block's two sides: every pair that agrees and differs in root is verified, unless links found before join the two."""
    t = pa.Table.from_batches(rows)
    marks, root, left, right = _sides(t)
    alone = left is right
    root = root.copy()
    key = t.column("key")[0].as_py()
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    bags = [_open(x.as_buffer()) for c in t.column("bag").chunks for x in c]
    h, tf = (np.concatenate(z) for z in zip(*bags))
    size = np.array([len(x) for x, _ in bags])
    begin = np.cumsum(size) - size
    idf_of = idf.weight(h)
    mass = np.add.reduceat(tf * idf_of, begin)
    found: list[tuple[int, int]] = []
    for n, i in enumerate(left.tolist()):
        other = right[n + 1 :] if alone else right
        other = other[root[other] != root[i]]
        like = _agree(marks[other], marks[i])
        other, like = other[like >= REST_AGREE], like[like >= REST_AGREE]
        # a pair that shares several buckets is verified in that of its first band
        same = keys[other] == keys[i]
        here = keys[i][same.argmax(1)] == key
        other = other[here][np.argsort(-like[here], kind="stable")]
        mine, mine_tf = bags[i]
        while len(other):
            now, other = other[:AT_ONCE], other[AT_ONCE:]
            ends = np.cumsum(size[now])
            at = np.repeat(begin[now] - (ends - size[now]), size[now]) + np.arange(ends[-1])
            place = np.minimum(np.searchsorted(mine, h[at]), len(mine) - 1)
            hit = mine[place] == h[at]
            common = np.add.reduceat(hit.astype(np.int64), ends - size[now])
            both = np.add.reduceat(np.where(hit, np.minimum(tf[at], mine_tf[place]) * idf_of[at], 0.0), ends - size[now])
            alike = np.maximum(common / (size[now] + size[i] - common), both / (mass[now] + mass[i] - both)) >= threshold
            for j in now[alike].tolist():
                if root[j] != root[i]:
                    found.append((i, j))
                    root[root == root[j]] = root[i]
            other = other[root[other] != root[i]]
    node = t.column("node").combine_chunks()
    yield pa.RecordBatch.from_arrays([node.take(pa.array([p[k] for p in found], pa.int64())) for k in range(2)], names=["a", "b"])


def _compare(block: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What block gives for each block; a block's rows come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.stack([b.column(c).to_numpy() for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(cell[:, lo].tolist())
                if now != at and held:
                    yield from block(held)
                    held = []
                at = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from block(held)

    return run


_MEMBER = "key long, node binary, marks binary, root binary, x int, y int, first boolean"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def rest_blocks(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets with several roots, once for each block (key, x, y) that they are compared in.

    In a bucket the members of its largest component are not compared with each other; the others are, and with those.
    Both are cut into blocks by hash, so that a bucket of any size is shared among tasks.
    """
    rooted = nodes.join(roots, "node", "left").select("node", "marks", "keys", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    rows = rooted.select("node", "marks", "root", F.explode("keys").alias("key"))
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    mixed = written(mixed.select("key", "members", F.col("largest.root").alias("main"), F.col("largest.n").alias("n_main")), "mixed-buckets")
    met = attach(rows, mixed, "key", "members", rooted.count() * BANDS)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    n_rest, n_main = blocks(F.col("members") - F.col("n_main")), blocks(F.col("n_main"))
    is_main, h = F.col("root") == F.col("main"), F.xxhash64("node")
    met = met.select("key", "node", "marks", "root", n_rest.alias("n_rest"), n_main.alias("n_main"), is_main.alias("is_main"), F.pmod(h, F.when(is_main, n_main).otherwise(n_rest)).cast("int").alias("mine"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    cell = lambda x, y, first: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), first.alias("first"))
    mine = F.col("mine")
    # y below n_main is a block of the largest component, from n_main on one of the rest
    of_main = each(F.col("n_rest"), lambda i: cell(i, mine, F.lit(False)))
    with_main = each(F.col("n_main"), lambda i: cell(mine, i, F.lit(True)))
    with_rest = each(F.col("n_rest"), lambda i: cell(F.least(i, mine), F.col("n_main") + F.greatest(i, mine), mine <= i))
    met = met.select("key", "node", "marks", "root", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_rest))).alias("cell"))
    return _dealt(met.select("key", "node", "marks", "root", "cell.*"))


def rest_pairs(nodes: DataFrame, roots: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct pairs a < b of nodes that share a bucket, differ in root and may be near-duplicates, without those in done.

    With `most`, a node is paired with so many of the most alike nodes of each block that it
    is in, and a row of nulls says that there are more.
    """
    pairs = rest_blocks(nodes, roots).mapInArrow(_compare(lambda rows: _block_pairs(rows, most)), "a binary, b binary")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def rest_links(texts: DataFrame, nodes: DataFrame, roots: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Links a, b (written) that join all near-duplicates that share a bucket, agree in REST_AGREE samples and differ in root.

    What grows with the square of a group's size is the comparison within blocks alone: a block gives fewer links than it has members.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(idf)
    met = written(rest_blocks(nodes, roots).mapInArrow(_compare(_block_members), _MEMBER), "rest-members")
    bags = bags_of(texts, nodes.join(met.select("node").distinct(), "node", "left_semi"))
    whole = met.join(bags, "node").join(nodes.select("node", "keys"), "node")
    links = written(_dealt(whole).mapInArrow(_compare(lambda rows: _block_links(rows, shipped.value, threshold)), "a binary, b binary"), "links")
    discard(met)
    discard(bags)
    return links


def _slot(uid: np.ndarray) -> np.ndarray:
    return (sh.mix(uid.view(_U)) >> _U(64 - FILTER_BITS)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = np.unique(_slot(b.column("uid").to_numpy())) if b.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((s >> 5).astype(np.int32)), pa.array(np.left_shift(np.int64(1), s & 31))], names=["word", "bit"])


def _filter_words(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash: 1 << FILTER_BITS bits, whatever the input."""
    got = nodes.select("uid").mapInArrow(_marks, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return words


def _sets(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Only the texts that pass the filter are cut into shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        for b in batches:
            slot = _slot(b.column("uid").to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            b = b.filter(pa.array(((words[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1).astype(bool)))
            for block in sh.blocks(b):
                *_, h, rows, tf = _bags(block)
                ids = np.arange(block.num_rows)
                cuts = zip(np.searchsorted(rows, ids).tolist(), np.searchsorted(rows, ids, "right").tolist())
                yield pa.RecordBatch.from_arrays([block.column("uid"), pa.array([_closed(h[s:e], tf[s:e]) for s, e in cuts], pa.binary())], names=["uid", "bag"])

    return run


def _closed(h: np.ndarray, tf: np.ndarray) -> bytes:
    """Hashes, then places and counts of those that come more than once, and their number."""
    often = np.flatnonzero(tf > 1)
    return h.tobytes() + np.concatenate([often, tf[often], [len(often)]]).astype(np.uint32).tobytes()


def _open(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = len(bag) - 4
    often = int(np.frombuffer(bag, np.uint32, 1, end)[0])
    n = end // 8 - often
    counts = np.ones(n, np.uint32)
    counts[np.frombuffer(bag, np.uint32, often, 8 * n)] = np.frombuffer(bag, np.uint32, often, 8 * n + 4 * often)
    return np.frombuffer(bag, _U, n), counts


def similarities(x: bytes, y: bytes, idf: Idf) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two bags of shingles."""
    (hx, cx), (hy, cy) = _open(x), _open(y)
    common, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    plain = len(common) / max(1, len(hx) + len(hy) - len(common))
    both = float((np.minimum(cx[ix], cy[iy]) * idf.weight(common)).sum())
    every = float((cx * idf.weight(hx)).sum() + (cy * idf.weight(hy)).sum()) - both
    return both / every if every > 0 else 0.0, plain


def _verifier(shipped, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shipped.value
        for b in batches:
            got = [similarities(x, y, idf) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            ok = pa.array([max(g) >= threshold for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["a", "b", "weighted", "plain"]).filter(ok)

    return run


def bags_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and bag of the nodes (node, uid of a text of it); written."""
    keep = texts.sparkSession.sparkContext.broadcast(_filter_words(nodes))
    bags = texts.select("uid", F.col("text").cast("binary").alias("text")).mapInArrow(_sets(keep), "uid long, bag binary")
    return written(bags.join(nodes.select("node", "uid"), "uid").select("node", "bag"), "bags")


def verified_links(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Pairs a, b whose weighted or plain similarity reaches the threshold; written."""
    shipped = texts.sparkSession.sparkContext.broadcast(idf)
    bags = bags_of(texts, nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"))
    both = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verifier(shipped, threshold), "a binary, b binary, weighted double, plain double")
    links = written(links.select("a", "b"), "links")
    discard(bags)
    return links


def possible(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs without those whose sizes alone keep both similarities below the threshold."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.struct("size", "mass").alias(f"of_{c}"))
    pairs = pairs.join(end("a"), "a").join(end("b"), "b")
    near = lambda n: F.least(f"of_a.{n}", f"of_b.{n}") >= (threshold - 1e-9) * F.greatest(f"of_a.{n}", f"of_b.{n}")
    return pairs.where(near("size") | near("mass")).select("a", "b")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: uid, doc_id, class_id, class_size, kept.

    docs has doc_id and text; other columns are not read. class_id is the smallest doc_id
    of the class, of which exactly one row is kept: that with the smallest doc_id (null
    ones last; ties: the first row of the scan). Texts with the same words are alike; texts
    without any word (null and empty ones too) are alike when they are the same bytes. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = stable(docs).select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = document_frequencies(docs)
    texts = docs.withColumn("text", F.col("text").cast("binary"))
    shipped = docs.sparkSession.sparkContext.broadcast(idf)
    signed = written(texts.mapInArrow(_signer(shipped), "uid long, doc_id long, node binary, keys array<long>, marks binary, size int, mass double"), "signed")
    sets = signed.where("keys is not null").groupBy("node").agg(F.min("uid").alias("uid"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("size").alias("size"), F.first("mass").alias("mass"))
    sets = written(sets, "signatures")
    pairs = written(possible(candidate_pairs(sets), sets, threshold), "pairs")
    links = verified_links(texts, sets, pairs, idf, threshold)
    roots = components(links)
    for most in PARTNERS:
        if most is None:
            new = rest_links(texts, sets, roots, idf, threshold)
        else:
            more = written(possible(rest_pairs(sets, roots, pairs, most).where("a is not null"), sets, threshold), "pairs")
            new = verified_links(texts, sets, more, idf, threshold)
            pairs = pairs.unionByName(more)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")).alias("best")
    nodes = signed.groupBy("node").agg(F.count("*").alias("copies"), best)
    nodes = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    classes = nodes.groupBy("root").agg(F.count("*").alias("texts"), F.sum("copies").alias("class_size"), F.min("best").alias("chosen"))
    by_node = attach(nodes.select("node", "copies", "root"), written(classes, "classes"), "root", "texts", nodes.count())
    by_node = written(by_node.select("node", "copies", "class_size", "chosen"), "node-classes")
    found = attach(signed.select("uid", "doc_id", "node"), by_node, "node", "copies", idf.n_docs)
    return found.select("uid", "doc_id", F.col("chosen.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("chosen.uid")).alias("kept"))
