"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition digests its texts and sorts them into one run (digest, length,
identifier). Runs then meet in rounds: in round r, FAN neighbouring runs become one, and
the digest space of the merged run is cut FAN times finer, so that the number of merge
tasks never shrinks (recursive halving, FAN-nomial). Each merge streams over the
sorted input, combines equal digests whose byte lengths agree, keeps the verified
smallest or largest identifier and adds up the counts. A text that fills a third of the
corpus is one entry per run from the first level on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, small_batches, written

#: Runs that one merge takes: three binomial rounds at once.
FAN = 8

_RUN = "node long, digest binary, n_bytes long, keep_id long, keep_uid long, group_size long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # bytes.lower() changes A-Z only
        texts = [(t or b"").lower() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("run"), b.column("uid"), b.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
            names=["run", "uid", "doc_id", "digest", "n_bytes"],
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine neighbouring rows of one node and digest; rows come sorted, the identifier to keep last."""
    held: pa.RecordBatch | None = None
    names = [c.split()[0] for c in _RUN.split(", ")]
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays(b.columns, names=names)  # whether a column may be null differs by plan
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        n = b.num_rows
        digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), np.uint64).reshape(n, 4)
        node, n_bytes = b.column("node").to_numpy(), b.column("n_bytes").to_numpy()
        new = (digest[1:] != digest[:-1]).any(1) | (node[1:] != node[:-1]) | (n_bytes[1:] != n_bytes[:-1])
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        sizes = np.add.reduceat(b.column("group_size").to_numpy(), first)
        out = b.take(pa.array(last))
        out = out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(sizes, pa.int64()))
        held = out.slice(len(last) - 1)
        if len(last) > 1:
            yield out.slice(0, len(last) - 1)
    if held is not None:
        yield held


def _sorted(df: DataFrame, keep: str) -> DataFrame:
    best = ("keep_id", "keep_uid")
    by = [F.col(c).asc_nulls_first() if keep == "largest" else F.col(c).desc_nulls_first() for c in best]
    return df.sortWithinPartitions("node", "digest", "n_bytes", *by)


def exact_duplicates(docs: DataFrame, *, keep: str = "largest") -> DataFrame:
    """One row per document: uid, doc_id, keep_id, keep_uid, group_size, digest.

    docs has doc_id (long) and text; other columns are not read. Texts are equal when
    identical after lower-casing A-Z; null counts as the empty text. Of equal texts the
    row with the largest (or smallest) doc_id is kept; a null doc_id loses to any other;
    among rows that tie on doc_id exactly one is kept, told apart by uid
    (monotonically_increasing_id of the scan). An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep!r}")
    small_batches(docs.sparkSession)
    base = docs.select(F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    base = written(base.mapInArrow(_digests, "run long, uid long, doc_id long, digest binary, n_bytes long"), "digests")
    runs, total = base.agg(F.max("run") + 1, F.count("*")).first()
    level = base.select(F.col("run").alias("node"), "digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("group_size"))
    level = _sorted(level, keep).mapInArrow(_merge, _RUN)
    # the table that was read back may be dealt otherwise than it was written: one more round at the end joins what is left of a run
    left, cuts = runs or 1, 1
    while True:
        left, cuts = -(-left // FAN), cuts * FAN
        level = level.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        piece = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") % cuts
        level = _sorted(level.repartition("node", piece), keep).mapInArrow(_merge, _RUN)
        if left == 1:
            break
    groups = written(level.select("digest", "keep_id", "keep_uid", "group_size"), "digest-groups")
    return attach(base.select("uid", "doc_id", "digest"), groups, "digest", "group_size", total)
