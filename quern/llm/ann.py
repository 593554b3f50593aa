"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order in which it sees PIVOTS pivots, nearest first. It is
posted in the inverted files of its POST nearest file pivots (the first FILES pivots). A
query opens the files of its PROBE nearest file pivots, ranks what is posted there by the
footrule distance (sum of rank differences) of the orders, and reranks the best SHARE of
each file's postings by exact distance on the original vectors. All rows are indexed; the
pivots alone are a bounded sample.

Equal vectors are one posting that carries its k + 1 smallest identifiers, so copies
neither fill a file nor crowd out other neighbours. Files and the queries that open one are
cut into blocks of bounded size, which meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PIVOTS, FILES = 128, 32
POST, PROBE = 6, 16
SHARE, LEAST = 0.25, 200
#: Postings, and queries, in a block.
BLOCK, QUERIES = 16_384, 2048
#: Queries whose footrule distances to a block are computed at a time.
STEP_BYTES = 64 << 20


def usable(v: Column) -> Column:
    """Not null, all components finite, and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The rank of every pivot for every vector (uint8): 0 for the nearest; ties go to the first."""
    d = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    rank = np.empty(d.shape, np.uint8)
    np.put_along_axis(rank, np.argsort(d, 1, kind="stable"), np.arange(d.shape[1], dtype=np.uint8)[None], 1)
    return rank


def _ranker(shipped, files: int, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank = orders(_matrix(b.column("v")), shipped.value)
            near = np.argsort(rank[:, :files], 1, kind="stable")[:, :keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in rank], pa.binary()), pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "ranks", "near"])

    return run


def _search(k: int, share: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, posted: pa.Table, asked: pa.Table) -> pa.Table:
        file = key[0].as_py()
        out_q: list[int] = []
        out_v: list[int] = []
        out_d: list[float] = []
        if posted.num_rows and asked.num_rows:
            x, q = _matrix(posted.column("v")), _matrix(asked.column("v"))
            pr = np.frombuffer(b"".join(posted.column("ranks").to_pylist()), np.uint8).reshape(len(x), -1)
            qr = np.frombuffer(b"".join(asked.column("ranks").to_pylist()), np.uint8).reshape(len(q), -1)
            ids, qids = posted.column("first_id").to_numpy(), asked.column("query_id").to_numpy()
            low = posted.column("low").to_numpy()
            by_id = np.argsort(low, kind="stable")
            x, pr, ids, low = x[by_id], pr[by_id], ids[by_id], low[by_id]
            # in which place of the query's probes the files of a posting stand; the first one answers for it
            post = _matrix(posted.column("near")).astype(np.int64)[by_id]
            probes = _matrix(asked.column("near")).astype(np.int64)
            take = min(len(x), max(LEAST, k + 1, int(np.ceil(share * len(x)))))
            wide = pr.astype(np.int16)
            for i in range(len(q)):
                place = np.full(int(max(post.max(), probes[i].max(), file)) + 1, 255, np.int64)
                place[probes[i]] = np.arange(probes.shape[1])
                mine = np.flatnonzero(place[post].min(1) == place[file])
                if not len(mine):
                    continue
                foot = np.abs(wide[mine] - qr[i].astype(np.int16)).sum(1, dtype=np.int32)
                n = min(len(mine), take)
                if n < len(mine):
                    limit = np.partition(foot, n - 1)[n - 1]
                    mine = mine[foot <= limit]  # ties of the last stay
                d = np.sqrt(((x[mine] - q[i]) ** 2).sum(1))
                # of k + 1 vectors with the smallest identifiers none can be crowded out by another at the same distance
                best = np.lexsort((low[mine], d))[: k + 1]
                out_q += [int(qids[i])] * len(best)
                out_v += ids[mine][best].tolist()
                out_d += d[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "first_id": pa.array(out_v, pa.int64()), "score": pa.array(out_d, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, pivots: int = PIVOTS, files: int = FILES, post: int = POST, probe: int = PROBE, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, by Euclidean distance.

    vectors has vec_id and embedding (array of float or double); is_query is a condition on
    vec_id. Vectors that are null, zero or hold a null or non-finite component take no part,
    nor do rows with a null vec_id, nor vectors whose length is not the most frequent one.
    Candidates of a query are all other rows; repeated rows of a query are answered once.
    Ties go to the smaller vec_id. Few or no candidates give few or no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == length["n"])
    # the k + 1 smallest identifiers of equal vectors: limited before the shuffle as well
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    first = rows.select("vec_id", "v").withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    distinct = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("first_id", F.col("ids")[0])
    # repeated rows of one vec_id with different vectors stay apart by their position
    distinct = written(distinct.withColumn("key", F.monotonically_increasing_id()), "vectors")
    chosen = distinct.orderBy(F.xxhash64("first_id"), "first_id", "key").limit(pivots).select("v").collect()
    table = np.array([r["v"] for r in chosen])
    files, n_dim = min(files, len(table)), len(table[0])
    assert n_dim == length["n"]
    shipped = spark.sparkContext.broadcast(table)
    posted = distinct.select(F.col("key").alias("first_id"), F.col("first_id").alias("low"), "v").mapInArrow(_ranker(shipped, files, min(post, files)), "first_id long, low long, v array<double>, ranks binary, near array<int>")
    posted = written(posted, "postings")
    asked = rows.where("asks").select("vec_id", "v").distinct()
    asked = asked.select(F.monotonically_increasing_id().alias("query_id"), "vec_id", "v")
    asked = written(asked.mapInArrow(_ranker(shipped, files, min(probe, files)), "query_id long, vec_id long, v array<double>, ranks binary, near array<int>"), "queries")

    def blocks(df: DataFrame, size: int) -> DataFrame:
        """Blocks of each file; as many rows as there are files."""
        return F.broadcast(df.select(F.explode("near").alias("file")).groupBy("file").agg(F.ceil(F.count("*") / size).cast("int").alias("n")))

    cut_p, cut_q = blocks(posted, BLOCK), blocks(asked, QUERIES)

    def dealt(df: DataFrame, key: str, own: DataFrame, other: DataFrame, names: tuple[str, str]) -> DataFrame:
        x = df.withColumn("file", F.explode("near")).join(own, "file").withColumn(names[0], F.pmod(F.xxhash64(key), "n").cast("int")).drop("n")
        return x.join(other, "file").withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    left = dealt(posted, "first_id", cut_p, cut_q, ("pb", "qb")).groupBy("file", "pb", "qb")
    right = dealt(asked.drop("vec_id"), "query_id", cut_q, cut_p, ("qb", "pb")).groupBy("file", "pb", "qb")
    found = left.cogroup(right).applyInArrow(_search(k, share), "query_id long, first_id long, score double")
    found = found.join(distinct.select(F.col("key").alias("first_id"), "ids"), "first_id").join(asked.select("query_id", F.col("vec_id").alias("own")), "query_id")
    # one of the query's own identifiers goes
    at = F.array_position("ids", F.col("own"))
    others = F.when((F.col("score") == 0) & (at > 0), F.filter("ids", lambda x, i: i != at - 1)).otherwise(F.col("ids"))
    found = found.select("query_id", "own", "score", F.explode(others).alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("own").alias("query_id"), "rank", "vec_id", "score")
