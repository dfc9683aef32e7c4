"""Hard partitions, centroids, overlapping memberships and partition-scoped retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.vector import _best, _matrix, mean_by, ranked
from evigraph.session import attach, cut

RANGES = 4_096  # id ranges by which a global rank is computed in parallel


def dense_rank_of(df: DataFrame, key: str) -> DataFrame:
    """Adds ``idx``, the 0-based position of each row by an integer key, without a global sort: keys
    are counted by range, and each range is ranked by itself."""
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(1, (hi - lo) // RANGES + 1)
    r = df.withColumn("_g", F.floor((F.col(key) - lo) / width))
    sizes = r.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))  # RANGES rows at most
    before = sizes.withColumn("_b", F.sum("_n").over(W.partitionBy().orderBy("_g")) - F.col("_n")).drop("_n")
    rn = F.row_number().over(W.partitionBy("_g").orderBy(key)) - 1
    return r.withColumn("_r", rn).join(F.broadcast(before), "_g").withColumn("idx", F.col("_r") + F.col("_b")).drop("_g", "_r", "_b")


def in_groups(df: DataFrame, group: str, key: str, value: str | None = None) -> DataFrame:
    """Adds to each row of a group, in the order of an integer key, ``idx``, its 0-based position,
    ``prev``, the key before it, and with ``value`` ``upto``, the sum of it up to and with the row.

    A group that holds a tenth of all rows isn't one task: keys are cut into ranges, ranges are
    counted per group, and each range of a group is ordered by itself. Null keys go."""
    df = df.where(F.col(key).isNotNull())
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    r = df.withColumn("_g", F.floor((F.col(key) - lo) / max(1, (hi - lo) // RANGES + 1)))
    v = F.col(value) if value else F.lit(0)
    sizes = r.groupBy(group, "_g").agg(F.count(F.lit(1)).alias("_n"), F.max(key).alias("_last"), F.sum(v).alias("_v"))  # RANGES rows a group
    w = W.partitionBy(group).orderBy("_g")
    before = sizes.select(
        F.col(group).alias("_group"), F.col("_g").alias("_at"), (F.sum("_n").over(w) - F.col("_n")).alias("_b"), (F.sum("_v").over(w) - F.col("_v")).alias("_s"), F.lag("_last").over(w).alias("_p"),
    )
    own = W.partitionBy(group, "_g").orderBy(key)
    out = r.withColumns({"_r": F.row_number().over(own) - 1, "_l": F.lag(key).over(own), "_u": F.sum(v).over(own.rowsBetween(W.unboundedPreceding, 0))})
    out = out.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_g") == F.col("_at")))
    out = out.withColumns({"idx": F.col("_r") + F.col("_b"), "prev": F.coalesce("_l", "_p"), "upto": F.col("_u") + F.col("_s")})
    return out.drop("_g", "_n", "_last", "_v", "_group", "_at", "_b", "_s", "_p", "_r", "_l", "_u", *([] if value else ["upto"]))


def subcentroids(items: DataFrame, c: int, rounds: int = 10) -> DataFrame:
    """``(pid, sub, vec)``: c means of each partition by Lloyd's rounds, from the c members of the
    smallest hashes; a partition of fewer members has those. Members are summed inside the tasks, so a
    partition that holds a third of all rows costs a row a task; the means, as few as partitions are,
    are held by the tasks."""
    spark = attach(items.sparkSession)
    src = items.where("pid is not null and vec is not null").select("pid", "doc_id", F.col("vec").cast("array<double>").alias("vec"))
    w = W.partitionBy("pid").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = src.withColumn("sub", F.row_number().over(w) - 1).where(F.col("sub") < c).select("pid", "sub", "vec")
    if first.limit(LIMIT * c + 1).count() > LIMIT * c:
        raise ValueError("more partitions than a task may hold means of")
    means = {(r["pid"], r["sub"]): np.array(r["vec"]) for r in first.collect()}
    for _ in range(rounds if c > 1 else 1):
        table = {}
        for (p, s), v in sorted(means.items()):
            table.setdefault(p, ([], []))
            table[p][0].append(s), table[p][1].append(v)
        held = spark.sparkContext.broadcast({p: (np.array(s), np.stack(v)) for p, (s, v) in table.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                pids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for p in np.unique(pids).tolist():
                    subs, m = held.value[p]
                    own = x[pids == p]
                    near = ((own[:, None, :] - m[None]) ** 2).sum(axis=2).argmin(axis=1)
                    for j in np.unique(near).tolist():
                        got = sums.setdefault((p, int(subs[j])), [0, 0])
                        got[0], got[1] = got[0] + own[near == j].sum(axis=0), got[1] + int((near == j).sum())
            rows = [(p, s, d, float(v), n) for (p, s), (total, n) in sums.items() for d, v in enumerate(total)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["pid", "sub", "d", "x", "n"])

        found = src.select("pid", "vec").mapInArrow(run, "pid long, sub int, d int, x double, n long").groupBy("pid", "sub", "d").agg((F.sum("x") / F.sum("n")).alias("x"))
        vecs = found.groupBy("pid", "sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("vec"))
        moved = {(r["pid"], r["sub"]): np.array(r["vec"]) for r in vecs.collect()}
        still = all(np.allclose(moved.get(k, v), v, atol=1e-12) for k, v in means.items())
        means.update(moved)
        if still:
            break
    rows = [(int(p), int(s), [float(x) for x in v]) for (p, s), v in sorted(means.items())]
    return spark.createDataFrame(rows, "pid long, sub long, vec array<double>")


def chunks(df: DataFrame, key: str, target: int) -> DataFrame:
    """Contiguous partitions of ``target`` rows by key: adds ``pid``."""
    return dense_rank_of(df, key).withColumn("pid", F.floor(F.col("idx") / target).cast("long")).drop("idx")


def hash_split(ids: DataFrame, key: str, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """``(key, split)`` by the order of a hash of the key: exact sizes without a global sort, by
    counting the hashes' first three digits and ranking inside each. Null keys go."""
    d = ids.where(F.col(key).isNotNull()).select(key, F.md5(F.col(key).cast("string")).alias("h")).withColumn("p", F.substring("h", 1, 3))
    held = d.groupBy("p").agg(F.count(F.lit(1)).alias("c"))  # 4,096 rows at most
    w = W.partitionBy()
    before = held.select("p", (F.sum("c").over(w.orderBy("p")) - F.col("c")).alias("b"), F.sum("c").over(w).alias("n"))
    i = F.row_number().over(W.partitionBy("p").orderBy("h", key)) - 1 + F.col("b")
    r = d.join(F.broadcast(before), "p").withColumn("i", i)
    a, b = F.floor(train * F.col("n")), F.floor(val * F.col("n"))
    return r.select(key, F.when(F.col("i") < a, "train").when(F.col("i") < a + b, "val").otherwise("test").alias("split"))


def spread_labels(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """``(node, label)``: every node starts as its own label and takes, round by round, the one most
    of its neighbours have, of equal ones the smallest. A hub's neighbours are counted map-side."""
    lab = nodes.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        seen = edges.join(lab.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = seen.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("l"))
        lab = cut(lab.join(best, "node", "left").select("node", F.coalesce("l", "label").alias("label")))
    return lab


def balanced(labels: DataFrame, target: int) -> DataFrame:
    """``(node, pid)``: nodes laid label by label, cut into partitions of ``target``. Labels are counted
    by range and each range is ranked by itself, so there is no global sort."""
    span = labels.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    r = labels.withColumn("_g", F.floor((F.col("label") - lo) / max(1, (hi - lo) // RANGES + 1)))
    sizes = r.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))  # RANGES rows at most
    before = sizes.withColumn("_b", F.sum("_n").over(W.partitionBy().orderBy("_g")) - F.col("_n")).drop("_n")
    at = F.row_number().over(W.partitionBy("_g").orderBy("label", "node")) - 1
    return r.withColumn("_r", at).join(F.broadcast(before), "_g").select("node", F.floor((F.col("_r") + F.col("_b")) / target).cast("long").alias("pid"))


def centroids(items: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """``(pid, vec, n)``: the mean vector of each partition at length 1, weighted by degree + 1."""
    if degree is not None:
        items = items.join(degree.select(F.col("node").alias("doc_id"), "degree"), "doc_id", "left")
        return mean_by(items, ["pid"], "vec", F.coalesce("degree", F.lit(0)) + 1)
    return mean_by(items, ["pid"], "vec")


LIMIT = 65_536  # partitions whose centroids a task may hold
ROWS, ASKING = 32_768, 8_192  # documents and queries of a partition that one task compares


def held_centroids(cents: DataFrame) -> pa.Table:
    """Centroids ``(pid, vec)`` on the driver, counted before they are fetched."""
    n = cents.count()
    if n > LIMIT:
        raise ValueError(f"{n} partitions: more centroids than a task may hold ({LIMIT})")
    return cents.select("pid", "vec").toArrow().sort_by("pid")


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Marked for a broadcast if it is counted to be small; otherwise left to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def scoped(queries: DataFrame, routed: DataFrame, items: DataFrame, k: int, each: bool = False) -> DataFrame:
    """Exact ranking of the items of each query's routed partitions only: ``(query_id, rnk, doc_id,
    score)``, or with ``each`` the k best of each partition, ``(query_id, pid, doc_id, score)``.

    A partition is cut into blocks of ROWS documents and its queries into blocks of ASKING, by their
    counts, so that a partition that holds a third of all rows is many tasks; each compares its
    blocks as matrices and sends k documents a query on."""
    routed = cut(routed.select("query_id", "pid"))  # ids only, used three times
    q = routed.join(queries.select("query_id", F.col("vec").cast("array<double>").alias("qv")), "query_id")
    it = items.select("pid", "doc_id", F.col("vec").cast("array<double>").alias("vec"))  # nulls go in the tasks: a filter would compute vectors twice
    parts = it.groupBy("pid").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("db")).join(
        routed.groupBy("pid").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("qb")), "pid"
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = parts.limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} partitions to search")
    parts = F.broadcast(items.sparkSession.createDataFrame([tuple(r) for r in rows], parts.schema))
    # aliases, for the two sides have a table in common
    own = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in cols])
    left = own(it.join(parts, "pid").withColumn("d", F.pmod(F.xxhash64("doc_id"), F.col("db")).cast("int")).withColumn("q", every(F.col("qb"))), "pid", "d", "q", "doc_id", "vec")
    right = own(q.join(parts, "pid").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int")).withColumn("d", every(F.col("db"))), "pid", "d", "q", "query_id", "qv")

    def run(key: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs, asked = docs.filter(docs.column("vec").is_valid()), asked.filter(asked.column("qv").is_valid())
        ids, own = asked.column("query_id").to_numpy(), docs.column("doc_id").to_numpy()
        x, y = _matrix(asked.column("qv")), _matrix(docs.column("vec"))
        out = []
        for lo in range(0, len(ids) if len(own) else 0, 256):
            out.append(_best(ids[lo : lo + 256], own, np.round(x[lo : lo + 256] @ y.T, 6) + 0.0, k))
        schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
        got = pa.Table.from_batches(out, schema) if out else schema.empty_table()
        return got.append_column("pid", pa.array(np.full(got.num_rows, key[0].as_py(), np.int64)))

    keys = ["pid", "d", "q"]
    s = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, doc_id long, score double, pid long")
    if not each:
        return ranked(s.select("query_id", "doc_id", "score"), k)
    w = W.partitionBy("query_id", "pid").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "pid", "doc_id", "score")


def quota(routed: DataFrame, scored: DataFrame, membership: DataFrame, partitions: int, each: int, k: int) -> DataFrame:
    """Quota interleave: of each of the first partitions the ``each`` best documents, taken rank by
    rank across partitions. ``routed (query_id, pid, rnk)``, ``scored (query_id, doc_id, score)``."""
    top = routed.where(F.col("rnk") <= partitions).select("query_id", "pid", F.col("rnk").alias("pr"))
    own = (scored if "pid" in scored.columns else scored.join(membership, "doc_id")).join(top, ["query_id", "pid"])
    dr = F.row_number().over(W.partitionBy("query_id", "pid").orderBy(F.desc("score"), "doc_id"))
    own = own.withColumn("dr", dr).where(F.col("dr") <= each)
    first = own.groupBy("query_id", "doc_id").agg(F.min(F.struct("dr", "pr")).alias("p"))
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy("p.dr", "p.pr", "doc_id")).cast("long")
    return first.withColumn("rnk", rnk).where(F.col("rnk") <= k).select("query_id", "rnk", "doc_id")


def onehop(hard: DataFrame, edges: DataFrame) -> DataFrame:
    """Own partition and those of the neighbours."""
    near = edges.join(hard.select(F.col("doc_id").alias("dst"), "pid"), "dst").select(F.col("src").alias("doc_id"), "pid")
    return hard.select("doc_id", "pid").unionByName(near).distinct()


def twohop(hard: DataFrame, edges: DataFrame) -> DataFrame:
    """Own partition and those within two hops: the one-hop sets of the neighbours, so no pair of
    nodes two apart is ever formed."""
    one = onehop(hard, edges)
    far = edges.join(one.select(F.col("doc_id").alias("dst"), "pid"), "dst").select(F.col("src").alias("doc_id"), "pid")
    return one.unionByName(far).distinct()


def explosion(hard: DataFrame, membership: DataFrame) -> DataFrame:
    """``(pid, hard, pool, factor)``: documents of each partition, hard and overlapped."""
    h = hard.groupBy("pid").agg(F.count(F.lit(1)).alias("hard"))
    m = membership.groupBy("pid").agg(F.count(F.lit(1)).alias("pool"))
    return m.join(h, "pid", "left").select("pid", F.coalesce("hard", F.lit(0)).alias("hard"), "pool", F.round(F.col("pool") / F.col("hard"), 6).alias("factor"))
