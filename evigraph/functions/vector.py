"""Vector functions: column expressions for single rows, blocked matrix kernels for searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.session import attach

BLOCK = 16_384  # queries held by a task at once; more are searched in further passes


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    # the length is bound to a variable, or it would be computed anew for every number
    by = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.element_at(F.transform(F.array(norm(a)), by), 1)


def mean_by(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean vector per key, at length 1: ``keys, vec, n``.

    Vectors are summed inside the tasks of a map stage and only the sums are shuffled: a key that
    holds a third of all rows costs one row a batch."""
    attach(df.sparkSession)
    src = df.where(F.col(vec).isNotNull()).select(*keys, F.col(vec).cast("array<double>").alias("_v"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
    types = dict(src.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", s array<double>, w double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keyed = t.select(keys).append_column("_i", pa.array(np.arange(t.num_rows)))
            groups = keyed.group_by(keys, use_threads=False).aggregate([("_i", "list")])
            v = t.column("_v").combine_chunks()
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            w = t.column("_w").to_numpy()
            rows = [np.asarray(i) for i in groups.column("_i_list").to_pylist()]
            cols = [groups.column(k).combine_chunks() for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([(w[i, None] * x[i]).sum(axis=0) for i in rows], pa.list_(pa.float64())), pa.array([float(w[i].sum()) for i in rows]), pa.array([len(i) for i in rows], pa.int64())],
                names=[*keys, "s", "w", "n"],
            )

    sums = src.mapInArrow(run, schema)
    long = sums.select(*keys, F.posexplode("s").alias("d", "x")).groupBy(*keys, "d").agg(F.sum("x").alias("x"))
    vecs = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vec"))
    counts = sums.groupBy(*keys).agg(F.sum("n").alias("n"))
    return vecs.join(counts, keys).withColumn("vec", unit(F.col("vec")))


def topk(
    queries: DataFrame, items: DataFrame, k: int, transform: str = "none", exclude_self: bool = False, digits: int = 6
) -> DataFrame:
    """``(query_id, rnk, doc_id, score)``: the k items of the highest inner product per query.

    ``queries (query_id BIGINT, vec)`` and ``items (doc_id BIGINT, vec)`` with vectors of one length;
    null vectors are left out. Scores are rounded before ranking, ties go to the smaller id. The
    queries, in blocks of BLOCK, are held by the tasks; the items are scanned once a block, and each
    batch sends its k best per query on, so what is shuffled doesn't grow with the items of a task.
    """
    spark = attach(items.sparkSession)
    src = items.where("doc_id is not null and vec is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    out = None
    for part in query_blocks(queries.where("vec is not null").select("query_id", F.col("vec").cast("array<double>").alias("vec"))):
        held = spark.sparkContext.broadcast((part.column("query_id").to_numpy(), _shape(_matrix(part.column("vec")), transform)))
        found = src.mapInArrow(_scan(held, k, transform, exclude_self, digits), "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def query_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries by id, in blocks of about BLOCK rows, one at a time on the driver: never more than
    BLOCK + 1 are fetched before they are counted, and a larger table is read block by block, by the
    hash of the id."""
    q = queries.where("query_id is not null").withColumn("query_id", F.col("query_id").cast("long"))
    got = q.limit(BLOCK + 1).toArrow()
    if got.num_rows <= BLOCK:
        yield got.sort_by("query_id")
        return
    blocks = -(-2 * q.count() // BLOCK)
    for b in range(blocks):
        yield q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().sort_by("query_id")


def topk_heads(heads: DataFrame, items: DataFrame, k: int, tau: float | None = None, digits: int = 6) -> DataFrame:
    """``(query_id, rnk, doc_id, score)`` of queries with several positions ``(query_id, h, vec)``: the
    largest of a document's scores or, with ``tau``, their soft-or max + tau ln sum exp((x - max) /
    tau). Heads are put together inside the tasks, so no more than k a batch and query are shuffled.
    A query's heads, few by nature, stay in one block."""
    spark = attach(items.sparkSession)
    src = items.where("doc_id is not null and vec is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    out = None
    for part in query_blocks(heads.where("vec is not null").select("query_id", F.col("vec").cast("array<double>").alias("vec"))):
        ids, starts = np.unique(part.column("query_id").to_numpy(), return_index=True)
        held = spark.sparkContext.broadcast((ids, starts, _matrix(part.column("vec"))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, starts, q = held.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for lo in range(0, batch.num_rows, 1024):
                    s = np.round(q @ x[lo : lo + 1024].T, digits) + 0.0
                    top = np.maximum.reduceat(s, starts)
                    if tau is not None:
                        many = np.diff(np.append(starts, len(s)))
                        top = np.round(top + tau * np.log(np.add.reduceat(np.exp((s - np.repeat(top, many, axis=0)) / tau), starts)), digits)
                    yield _best(ids, own[lo : lo + 1024], top, k)

        found = src.mapInArrow(run, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def _best(ids: np.ndarray, own: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
    r, c = np.repeat(np.arange(len(s)), order.shape[1]), order.ravel()
    keep = np.isfinite(s[r, c])
    return pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(own[c[keep]]), pa.array(s[r[keep], c[keep]])], names=["query_id", "doc_id", "score"])


def rank_of(queries: DataFrame, items: DataFrame, pairs: DataFrame, transform: str = "unit", digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, rnk)``: at which place of the whole ranking each pair's item stands, by
    counting the items before it; no ranking is formed. A query itself is no item of its own. The
    pairs of a block of queries, as few as golds are, are held by the tasks."""
    spark = attach(items.sparkSession)
    src = items.where("doc_id is not null and vec is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    asked = queries.where("vec is not null").select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    wanted = pairs.select("query_id", "doc_id").distinct().join(src, "doc_id").join(asked.withColumnRenamed("vec", "qv"), "query_id")
    out = None
    for part in query_blocks(wanted.select("query_id", "doc_id", "vec", "qv")):
        ids, first, row = np.unique(part.column("query_id").to_numpy(), return_index=True, return_inverse=True)
        q = _shape(_matrix(part.column("qv")), transform)[first]
        gold, x = part.column("doc_id").to_numpy(), _shape(_matrix(part.column("vec")), transform)
        held = spark.sparkContext.broadcast((ids, q, row, gold, np.round(np.einsum("ij,ij->i", q[row], x), digits) + 0.0))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, row, gold, score = held.value
            before = np.zeros(len(row), np.int64)
            for batch in batches:
                own, x = batch.column(0).to_numpy(), _shape(_matrix(batch.column(1)), transform)
                for lo in range(0, batch.num_rows if len(ids) else 0, 1024):
                    some = own[lo : lo + 1024]
                    s = (np.round(q @ x[lo : lo + 1024].T, digits) + 0.0)[row]
                    ahead = (s > score[:, None]) | ((s == score[:, None]) & (some[None, :] < gold[:, None]))
                    before += (ahead & (some[None, :] != ids[row][:, None]) & (some[None, :] != gold[:, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(gold), pa.array(before)], names=["query_id", "doc_id", "before"])

        found = src.mapInArrow(run, "query_id long, doc_id long, before long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("query_id", "doc_id").agg((F.sum("before") + 1).alias("rnk"))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _shape(x: np.ndarray, transform: str) -> np.ndarray:
    if transform == "unit":
        n = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(n > 0, n, 1)[:, None]
    return np.sign(x) if transform == "sign" else x


def _scan(held, k: int, transform: str, exclude_self: bool, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, x = batch.column(0).to_numpy(), _shape(_matrix(batch.column(1)), transform)
            for lo in range(0, len(ids), 1024):
                s = np.round(q[lo : lo + 1024] @ x.T, digits) + 0.0
                if exclude_self:
                    s[ids[lo : lo + 1024, None] == own[None, :]] = -np.inf
                if s.shape[1] > 4 * k:  # few columns can be among the k best: sort those only
                    floor = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                    s = np.where(s >= floor[:, None], s, -np.inf)
                    some = np.flatnonzero(np.isfinite(s).any(axis=0))
                    yield _best(ids[lo : lo + 1024], own[some], s[:, some], k)
                else:
                    yield _best(ids[lo : lo + 1024], own, s, k)

    return run


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """``(query_id, rnk, doc_id, score)`` by score, ties to the smaller id; the k first of each."""
    from pyspark.sql import Window as W

    out = scored.withColumn("rnk", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return (out if k is None else out.where(F.col("rnk") <= k)).select("query_id", "rnk", "doc_id", "score")
