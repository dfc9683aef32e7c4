"""Problem 4: splits that keep related records together.

Queries tied by a gold or by their seed form components. Components of one size and one label
profile are interchangeable, so they are bundled; a min-cost flow from the bundles to the splits
meets the quotas, overall and per profile, with convex costs for deviations; its flows are rounded
to whole components, and which components of a bundle go where is decided by the order of their
hashes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.operators.components import components
from evigraph.session import attach, cut

PARTS = 4  # a label's part of a group is rounded to so many parts in its profile
BUNDLE_LIMIT = 200_000  # distinct sizes and profiles; sizes are at most sqrt(2 n) for n queries
BATCH = 64  # bundles of one flow; from the large to the small, each batch makes up for the ones before
SPLITS = 1_000  # rows of the table of shares; more are refused
SHARD = 4_096  # components of a bundle that one task ranks


def seed_of(query_id: Column) -> Column:
    """The seed record of a query: its id without the ``.number`` of a derived question."""
    return F.regexp_replace(query_id, r"\.[0-9]+$", "")


def label_of(query_id: Column) -> Column:
    return F.regexp_extract(query_id, r"^(.*?)_q_", 1)


def groups(queries: DataFrame) -> DataFrame:
    """``(query_id, first_query_id)``: each query with the smallest id of its group.

    Every query is tied to the smallest query of each of its golds (other than -1) and of its
    seed, so a gold that serves a third of all queries costs one edge a query, not one a pair.
    Queries with null or empty golds are tied by their seed only; null ids are left out; redelivered
    rows count once.
    """
    attach(queries.sparkSession)
    q = queries.where("query_id is not null").select("query_id", "golds")
    keys = q.select(
        "query_id",
        F.explode(
            F.concat(
                F.array(F.concat(F.lit("s"), seed_of(F.col("query_id")))),
                F.transform(
                    F.filter(F.coalesce("golds", F.array().cast("array<bigint>")), lambda g: g.isNotNull() & (g != -1)),
                    lambda g: F.concat(F.lit("g"), g.cast("string")),
                ),
            )
        ).alias("key"),
    ).distinct()
    keys = cut(keys)
    low = keys.groupBy("key").agg(F.min("query_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = keys.join(low, "key").where("query_id <> low").select("query_id", "low")
    tied = components(edges)
    ids = keys.select("query_id").distinct()
    return ids.join(tied.toDF("query_id", "root"), "query_id", "left").select(
        "query_id", F.coalesce("root", "query_id").alias("first_query_id")
    )


class Flow:
    """Min-cost flow by successive shortest paths with potentials; costs aren't negative."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: float, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.out)
        high = [0.0] * n
        while True:
            dist, via, heap = [float("inf")] * n, [-1] * n, [(0.0, source)]
            dist[source] = 0.0
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x] + 1e-12:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    new = d + self.cost[e] + high[x] - high[y]
                    if self.room[e] > 1e-9 and new < dist[y] - 1e-12:
                        dist[y], via[y] = new, e
                        heapq.heappush(heap, (new, y))
            if via[sink] < 0:
                return
            for x in range(n):
                if dist[x] < float("inf"):
                    high[x] += dist[x]
            push, x = float("inf"), sink
            while x != source:
                push, x = min(push, self.room[via[x]]), self.to[via[x] ^ 1]
            x = sink
            while x != source:
                self.room[via[x]] -= push
                self.room[via[x] ^ 1] += push
                x = self.to[via[x] ^ 1]


def allocate(bundles: list[tuple[int, str, int]], shares: list[tuple[str, float]]) -> dict[tuple[int, str], list[int]]:
    """How many components of each bundle ``(size, profile, count)`` each split gets.

    Bundles are taken in batches from large components to small. In a batch's flow every bundle has
    its own arcs to the splits: free of charge up to its whole components' share, then at convex
    costs that weigh more the larger the components are. A split takes its quota of each profile
    free of charge (up to one component more) and its overall quota, and what is beyond at a cost.
    What a batch's whole components miss or exceed is carried into the next one's quotas.
    """
    total = sum(s * n for s, _, n in bundles)
    whole = sum(w for _, w in shares) or 1.0
    weight = [w / whole for _, w in shares]
    k = len(shares)
    if not total:
        return {}
    order = sorted(bundles, key=lambda b: (-b[0], b[1]))
    quota = [0.0] * k  # what is still due, overall and by profile
    due: dict[str, list[float]] = {}
    ahead = float(total)
    out: dict[tuple[int, str], list[int]] = {}
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        amount = sum(s * n for s, _, n in batch)
        ahead -= amount
        of: dict[str, int] = {}
        step: dict[str, int] = {}
        for s, p, n in batch:
            of[p] = of.get(p, 0) + s * n
            step[p] = max(step.get(p, 0), s)
        for j in range(k):
            quota[j] += amount * weight[j]
        for p, m in of.items():
            own = due.setdefault(p, [0.0] * k)
            for j in range(k):
                own[j] += m * weight[j]
        # what later batches are due may be used in advance, so a large component isn't over a quota
        cap = [max(0.0, quota[j]) for j in range(k)]
        spare = [ahead * weight[j] for j in range(k)]
        flows = _batch(batch, weight, cap, spare, {p: [max(0.0, x) for x in due[p]] for p in of}, step)
        for (size, profile, n), flow in zip(batch, flows):
            want = [f / size for f in flow]
            got = [min(n, int(w + 1e-6)) for w in want]
            for _ in range(n - sum(got)):
                # the next whole component goes where most of the flow is left, then where most is due
                j = max(range(k), key=lambda j: (weight[j] > 0, round(want[j] - got[j], 6), quota[j] - size * got[j], -j))
                got[j] += 1
            for j in range(k):
                quota[j] -= size * got[j]
                due[profile][j] -= size * got[j]
            out[size, profile] = got
    return out


def _batch(
    batch: list[tuple[int, str, int]], weight: list[float], cap: list[float], spare: list[float], due: dict[str, list[float]], step: dict[str, int],
) -> list[list[float]]:
    """The flow of each bundle of a batch to each split, in queries."""
    k, profiles = len(weight), sorted(due)
    node = {p: 2 + len(batch) + i * k for i, p in enumerate(profiles)}
    last = 2 + len(batch) + len(profiles) * k
    flow = Flow(last + k)
    most = max(s for s, _, _ in batch)
    free, arcs = [], []
    for i, (s, p, n) in enumerate(batch):
        top = flow.arc(0, 2 + i, float(s * n), 0.0)
        own = []
        for j in range(k):
            if not weight[j]:
                continue
            base = int(n * weight[j] + 1e-9)
            rise = 0.01 * s / most
            own.append([
                (j, flow.arc(2 + i, node[p] + j, float(base * s), 0.0)),
                (j, flow.arc(2 + i, node[p] + j, float(s), rise * (1 - (n * weight[j] - base)))),
                (j, flow.arc(2 + i, node[p] + j, float("inf"), 2 * rise)),
            ])
            free.append((top, own[-1][0][1], p, j))
        arcs.append([a for three in own for a in three])
    down: dict[tuple[str, int], int] = {}
    for p in profiles:
        for j in range(k):
            down[p, j] = flow.arc(node[p] + j, last + j, due[p][j] + step[p], 0.0)
            flow.arc(node[p] + j, last + j, float("inf"), 1.0)
    end = []
    for j in range(k):
        end.append(flow.arc(last + j, 1, cap[j], 0.0))
        flow.arc(last + j, 1, spare[j], 4.0)
        flow.arc(last + j, 1, float("inf"), 16.0)
    # what costs nothing is laid at once: a flow without cost is the cheapest of its amount
    for top, arc, p, j in free:
        path = (top, arc, down[p, j], end[j])
        push = min(flow.room[a] for a in path)
        for a in path:
            flow.room[a] -= push
            flow.room[a ^ 1] += push
    flow.run(0, 1)
    got = []
    for own in arcs:
        row = [0.0] * k
        for j, a in own:
            row[j] += flow.room[a ^ 1]
        got.append(row)
    return got


def assign(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``(query_id, first_query_id, split)`` with the shares of ``targets (split, share)``.

    The profile of a group is the part of each dataset among its queries, in PARTS parts. Only
    bundles come to the driver, at most sizes times profiles, never groups; the plan made of them is
    broadcast. Ranks inside a bundle are exact: components are cut into shards by hash, shards are
    counted, and each is ranked by itself. A group larger than every quota goes where it is least
    over.
    """
    member = cut(groups(queries))
    spark = queries.sparkSession
    wanted = targets.where("split is not null and share > 0").select("split", F.col("share").cast("double")).limit(SPLITS + 1).collect()
    shares = sorted((r["split"], r["share"]) for r in wanted)
    if not shares:
        raise ValueError("no split has a share")
    if len(shares) > SPLITS:
        raise ValueError(f"more than {SPLITS} splits")
    per = member.groupBy("first_query_id", label_of(F.col("query_id")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # a group's labels are few: one row a dataset
    comp = per.groupBy("first_query_id").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("ls"))
    part = lambda x: F.concat_ws("=", x["label"], F.round(PARTS * x["n"] / F.col("size")).cast("int"))
    comp = cut(comp.select(
        "first_query_id", "size", F.concat_ws(",", F.transform("ls", part)).alias("profile"), F.xxhash64("first_query_id").alias("h"),
    ))
    got = comp.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n")).limit(BUNDLE_LIMIT + 1).collect()
    if len(got) > BUNDLE_LIMIT:
        raise ValueError("more bundles than a flow can take: lower PARTS")
    plan = allocate([(r["size"], r["profile"], r["n"]) for r in got], shares)
    rows = []
    for b, ((size, profile), counts) in enumerate(plan.items()):
        ends, upto = [], 0
        for c in counts:
            upto += c
            ends.append(upto)
        rows.append((size, profile, b, max(1, -(-upto // SHARD)), ends))
    # at most BUNDLE_LIMIT rows
    table = F.broadcast(spark.createDataFrame(rows, "size long, profile string, b int, shards long, ends array<long>"))
    c = comp.join(table, ["size", "profile"]).select("first_query_id", "h", "b", "ends", F.pmod("h", "shards").alias("shard"))
    held = c.groupBy("b", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = held.withColumn("before", F.sum("n").over(W.partitionBy("b").orderBy("shard")) - F.col("n")).drop("n")
    ranked = c.withColumn("rn", F.row_number().over(W.partitionBy("b", "shard").orderBy("h", "first_query_id")) - 1).join(before, ["b", "shard"])
    names = F.array(*[F.lit(name) for name, _ in shares])
    rank = F.col("rn") + F.col("before")
    placed = ranked.select("first_query_id", names[F.size(F.filter("ends", lambda x: x <= rank))].alias("split"))
    return member.join(placed, "first_query_id").select("query_id", "first_query_id", "split")


def found(queries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``(first_query_id, query_id)``: the smallest id of each group with every other one, as they
    were assigned to the splits; without ``targets`` of the groups alone."""
    done = groups(queries) if targets is None else assign(queries, targets)
    return done.where("query_id <> first_query_id").select("first_query_id", "query_id")


def audit(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``(queries, torn_golds, torn_seeds, off)``: queries assigned, golds and seeds whose queries
    are in more than one split, and splits whose share is off by more than a hundredth plus the
    largest group; the last three are 0 if the assignment is right."""
    done = cut(assign(queries, targets).select("query_id", "first_query_id", "split"))
    golds = queries.where("query_id is not null").select("query_id", F.explode("golds").alias("g")).where("g <> -1")
    torn = golds.join(done, "query_id").groupBy("g").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("torn_golds"))
    seeds = done.groupBy(seed_of(F.col("query_id"))).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("torn_seeds"))
    n = done.agg(F.count(F.lit(1)).alias("queries"))
    most = done.groupBy("first_query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    per = done.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    want = targets.where("split is not null and share > 0").select("split", (F.col("share") / F.sum("share").over(W.partitionBy())).alias("w"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  tables of a single row, joined on it
    off = one(want.join(per, "split", "left")).join(one(n), "_one").join(one(most), "_one").agg(
        F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("w") * F.col("queries")) > 0.01 * F.col("queries") + F.col("most")).alias("off")
    )
    return one(n).join(one(torn), "_one").join(one(seeds), "_one").join(one(off), "_one").drop("_one")


def balance(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``(split, queries, share, wanted)``: what each split got and should get."""
    done = assign(queries, targets)
    want = targets.withColumn("wanted", F.col("share") / F.sum("share").over(W.partitionBy()))
    return (
        done.groupBy("split").agg(F.count(F.lit(1)).alias("queries"))
        .withColumn("share", F.col("queries") / F.sum("queries").over(W.partitionBy()))
        .join(want.select("split", "wanted"), "split")
    )
