"""Problem 3: the most similar vectors of every vector, by a hash-prefix forest.

A tree gives each vector a long hash string; its sorted array keeps vectors with long common
prefixes side by side. The trees come in FAMILIES: the first bits of a family's strings are the path
in a tree of hyperplanes fitted on a bounded sample of the dataset (balanced at the sample's medians,
each chosen so that it parts few of the sample's nearest pairs), what follows are INNER different
strings of random hyperplanes around the leaf's centre. So a contiguous range of all arrays of a
family, a cell, can be searched by one task.

The search has the two steps of the method. Descent: strings alone, 8 bytes an array, are sorted by
cell, and each vector learns how many others share each of its prefixes in each tree. Ascent: over
all trees of all families at once, level by level from the longest prefix, until the ranges of that
level hold ASK candidates. Then the vectors meet in their cells, each is compared with the ranges of
its level in all arrays, and the candidates of all trees are united and scored exactly. The cost of a
vector is ASK comparisons, whatever the number of vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import attach, cut

SAMPLE = 49_152  # vectors fitted on, over all datasets
CELL = 12_288  # vectors that a cell should hold at most, by their count
LEAST = 1_024  # a cell isn't split where a part would be smaller, so that the ascent ends inside it
FAMILIES = 3  # fitted trees; vectors are shuffled once for each
INNER = 3  # strings of a family
BITS = 21  # of a string after the fitted path: three fit a long
ASK = 8_192  # candidates over all trees, repeats among them, up to which a vector ascends
WIDE = 4_096  # longest range that is compared as a whole; in longer ones the nearest in the array are
PLANES = 24  # hyperplanes tried at a node of the fitted tree
GROUPS = 4_096  # datasets
HOT = 64  # more copies of one direction than this are searched once
GRID = 1 << 18  # steps of the grid on which directions count as one
CENTROID_LIMIT = 65_536  # centroids in a broadcast; larger tables are searched slice by slice


def source(df: DataFrame, id_col: str, group_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, g, v`` of the usable rows: vectors of the collection's length, all of whose numbers
    are there and finite (NaN sorts above infinity), not all zero."""
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("g"), F.col(vec_col).cast("array<float>").alias("v"))
    low, high, inf = F.array_min("v"), F.array_max("v"), F.lit(float("inf"))
    return out.where(
        F.col("id").isNotNull() & F.col("g").isNotNull() & (F.size("v") == dim) & (F.size(F.array_compact("v")) == dim)
        & (high < inf) & (low > -inf) & ((high != 0) | (low != 0))
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as float32, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest entry first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def fit_tree(x: np.ndarray, pairs: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes and thresholds of a complete binary tree, by the order of a heap.

    ``pairs`` are near neighbours in the sample; of PLANES planes through a node's median the one
    that parts the fewest of its pairs is kept."""
    n, dim = x.shape
    planes = rng.standard_normal(((1 << depth) - 1, dim)).astype(np.float32)
    cuts = np.zeros((1 << depth) - 1, np.float32)
    where = np.zeros(n, np.int64)
    for node in range((1 << depth) - 1):
        own = np.flatnonzero(where == node)
        if len(own) >= 8:
            a, b = rng.integers(0, len(own), (2, PLANES))
            tried = x[own[a]] - x[own[b]]
            tried[np.abs(tried).sum(axis=1) == 0] = planes[node]
            at = x[own] @ tried.T
            cut = np.median(at, axis=0)
            side = np.zeros((n, PLANES), bool)
            side[own] = at > cut
            inside = pairs[(where[pairs[:, 0]] == node) & (where[pairs[:, 1]] == node)]
            parted = (side[inside[:, 0]] != side[inside[:, 1]]).sum(axis=0)
            uneven = np.abs(side[own].mean(axis=0) - 0.5) > 0.2  # many equal values at the median
            best = int(np.argmin(parted + uneven * len(pairs)))
            planes[node], cuts[node] = tried[best], cut[best]
        if len(own):
            where[own] = 2 * node + 1 + (x[own] @ planes[node] > cuts[node])
    return planes, cuts


def nearest_pairs(x: np.ndarray) -> np.ndarray:
    """Each row with its nearest other row."""
    best = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 2048):
        s = x[lo : lo + 2048] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        best[lo : lo + 2048] = s.argmax(axis=1)
    return np.stack([np.arange(len(x)), best], axis=1)


def best_in(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and values of at least the k + 1 most similar of ``c`` for each of
    ``q``, ties included. The k-th largest of block maxima bounds the k-th largest value from below, so that
    most entries are looked at once only."""
    s = q @ c.T
    n = s.shape[1]
    want = k + 1
    if n <= 2 * want:
        return (*np.divmod(np.arange(s.size), n), s.ravel())
    width = max(1, min(32, n // (2 * want)))
    head = s[:, : n // width * width].reshape(len(s), -1, width).max(axis=2)
    floor = np.partition(head, head.shape[1] - want, axis=1)[:, -want] - 2e-6
    r, h = np.nonzero(s >= floor[:, None])
    return r, h, s[r, h]


def path(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """Leaf of each row at a depth of the fitted tree."""
    planes, cuts = tree[:2]
    node = np.zeros(len(x), np.int64)
    code = np.zeros(len(x), np.int64)
    for _ in range(depth):
        bit = np.einsum("ij,ij->i", x, planes[node]) > cuts[node]
        node, code = 2 * node + 1 + bit, 2 * code + bit
    return code


@functools.lru_cache(maxsize=64)
def _inner_planes(dim: int, family: int) -> np.ndarray:
    return np.random.default_rng([17, family]).standard_normal((dim, INNER * BITS)).astype(np.float32)


_POWERS = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)


def strings(x: np.ndarray, leaf: np.ndarray, centres: np.ndarray, family: int) -> np.ndarray:
    """The bits that follow the fitted path, ``(rows, INNER)``: on which side of random hyperplanes
    through the leaf's centre each row lies."""
    p = _inner_planes(x.shape[1], family)
    side = (x @ p - (centres @ p)[leaf]) > 0
    return side.reshape(len(x), INNER, BITS) @ _POWERS


def fit_forest(x: np.ndarray, depth: int, dim: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Planes, thresholds and leaf centres of each family."""
    pairs = nearest_pairs(x) if depth else np.zeros((0, 2), np.int64)
    out = []
    for t in range(FAMILIES):
        planes, cuts = fit_tree(x, pairs, depth, np.random.default_rng([t, len(x)]))
        leaf = path(x, (planes, cuts), depth)
        n = np.bincount(leaf, minlength=1 << depth)
        centres = np.zeros((1 << depth, dim), np.float32)
        np.add.at(centres, leaf, x)
        whole = x.mean(axis=0) if len(x) else np.zeros(dim, np.float32)
        out.append((planes, cuts, np.where(n[:, None] > 0, centres / np.maximum(n, 1)[:, None], whole).astype(np.float32)))
    return out


def cell_depths(counts: np.ndarray) -> np.ndarray:
    """For each leaf of a fitted tree the length of the prefix that names its cell, by the leaves'
    counts: a node is split while it holds more than CELL and both parts LEAST (or it holds four
    cells); a leaf that holds more goes on with bits of its first string."""
    leaves = len(counts)
    depth = leaves.bit_length() - 1
    out = np.zeros(leaves, np.int64)
    todo = [(0, leaves, 0)]
    while todo:
        lo, hi, d = todo.pop()
        n, mid = counts[lo:hi].sum(), (lo + hi) // 2
        if n <= CELL:
            out[lo:hi] = d
        elif d == depth:
            out[lo] = d + min(BITS, int(np.ceil(np.log2(n / CELL))))
        elif min(counts[lo:mid].sum(), counts[mid:hi].sum()) < LEAST and n <= 4 * CELL:
            out[lo:hi] = d
        else:
            todo += [(lo, mid, d + 1), (mid, hi, d + 1)]
    return out


def cells(leaf: np.ndarray, first: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The cell of each row, from its leaf and its first string."""
    fitted = len(depths).bit_length() - 1
    d = depths[leaf]
    return (np.int64(1) << d) | (((leaf << BITS) | first) >> (fitted + BITS - d))


def company(codes: np.ndarray, bits: int, top: int) -> np.ndarray:
    """``(rows, top + 1)``: for each prefix length from ``bits - top`` to ``bits`` how many rows share
    it with each row."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    out = np.empty((len(codes), top + 1), np.int64)
    for level in range(top + 1):
        starts = np.flatnonzero(np.diff(s >> (top - level), prepend=-1))
        n = np.diff(np.append(starts, len(s)))
        out[order, level] = np.repeat(n, n)
    return out


_COUNTS = 2.0 ** (np.arange(256) / 8) - 1


def packed_counts(n: np.ndarray) -> np.ndarray:
    """Counts in a byte each, to a twelfth."""
    return np.minimum(255, np.floor(8 * np.log2(1.0 + n))).astype(np.uint8)


def ascend(profiles: list[tuple[int, np.ndarray]], ask: int) -> np.ndarray:
    """The level at which the ascent of each vector over all trees at once stops: the longest prefix
    whose ranges hold ``ask`` candidates in total. Each tree gives the length of its cell's prefix
    and, a row a vector, its counts from there on; beyond the cell nothing is to be found."""
    low, high = min(d for d, _ in profiles), max(d + n.shape[1] for d, n in profiles) - 1
    total = np.zeros((len(profiles[0][1]), high - low + 1))
    for d, n in profiles:
        own = _COUNTS[n]
        total[:, : d - low] += own[:, :1]
        total[:, d - low : d - low + n.shape[1]] += own
    # counts fall with the length of the prefix, so those that are enough come first
    return low + np.maximum(0, (total >= ask).sum(axis=1) - 1)


def compare(
    xq: np.ndarray, xi: np.ndarray, cq: list[np.ndarray], ci: list[np.ndarray], level: np.ndarray, bits: int, k: int,
) -> np.ndarray:
    """Candidate pairs as ``query * len(xi) + item``: of each query the best of the items that share
    its prefix of its level in any array. Strings have ``bits`` bits."""
    n, pairs, values = len(xi), [], []
    for t, (q, c) in enumerate(zip(cq, ci)):
        order = np.argsort(c, kind="stable")
        y, s = xi[order], c[order]
        for at in np.unique(level).tolist():
            own = np.flatnonzero(level == at)
            if at == 0 and t:
                continue  # the empty prefix is the same in every tree
            shift = bits - at
            lo = np.searchsorted(s >> shift, q[own] >> shift, "left")
            hi = np.searchsorted(s >> shift, q[own] >> shift, "right")
            place = np.searchsorted(s, q[own])
            # queries of one range together; a range too long for that is cut around their places
            piece = np.where(hi - lo > WIDE, 1 + (place - lo) // (WIDE // 2), 0)
            by = np.lexsort((piece, lo))
            cuts = np.flatnonzero((np.diff(lo[by], prepend=-1) != 0) | (np.diff(piece[by], prepend=-1) != 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(by))):
                rows, first = own[by[a:b]], by[a]
                x, z = int(lo[first]), int(hi[first])
                if piece[first]:
                    m = x + (int(piece[first]) - 1) * (WIDE // 2)
                    x, z = max(x, m - WIDE // 4), min(z, m + WIDE // 2 + WIDE // 4)
                for u in range(0, len(rows) if z > x else 0, 1024):
                    r, h, value = best_in(xq[rows[u : u + 1024]], y[x:z], k)
                    pairs.append(rows[r + u] * n + order[h + x])
                    values.append(value)
    if not pairs:
        return np.zeros(0, np.int64)
    got, first = np.unique(np.concatenate(pairs), return_index=True)
    value = np.concatenate(values)[first]
    # of the candidates of all trees those that may be among the k + 1 best, by the error of a float
    q = got // n
    order = np.lexsort((-value, q))
    start = np.searchsorted(q, np.arange(len(xq) + 1))
    at = np.minimum(start[:-1] + k, np.maximum(start[1:] - 1, 0))
    return got[value >= value[order][at][q] - 2e-6]


def lists(ids: np.ndarray, others: np.ndarray, wq: np.ndarray, wi: np.ndarray, pairs: np.ndarray, k: int, same: bool) -> pa.Table:
    """``(id, best)``: the k best others of each id among its candidates, scored exactly; ties go to
    the smaller id. ``same``: both are one collection, in one order."""
    r, c = np.divmod(pairs, max(1, len(others)))
    if same:
        r, c = r[r != c], c[r != c]
    cos = np.empty(len(r), np.int64)
    for lo in range(0, len(r), 65_536):
        p = slice(lo, lo + 65_536)
        cos[p] = np.rint(np.einsum("ij,ij->i", wq[r[p]], wi[c[p]]) * 1e6)
    order = np.lexsort((others[c], -cos, r))
    r, c, cos = r[order], c[order], cos[order]
    start = np.searchsorted(r, np.arange(len(ids)))
    top = np.arange(len(r)) - start[r] < k
    r, c, cos = r[top], c[top], cos[top]
    at = np.flatnonzero(np.diff(r, prepend=-1))
    ends = pa.array(np.append(at, len(r)).astype(np.int32))
    best = pa.StructArray.from_arrays([pa.array(-cos.astype(np.int32)), pa.array(others[c])], names=["c", "o"])
    return pa.table({"id": pa.array(ids[r[at]]), "best": pa.ListArray.from_arrays(ends, best)})


BEST = "array<struct<c:int,o:long>>"


def directions(raw: np.ndarray) -> np.ndarray:
    """Hash of each row's direction on a grid of GRID steps of its largest number, so that copies
    that differ in length are copies: a sum with random odd weights, mixed."""
    grid = np.rint(raw / np.abs(raw).max(axis=1, keepdims=True).astype(np.float64) * GRID).astype(np.int64).astype(np.uint64)
    weights = np.random.default_rng(23).integers(0, 1 << 63, grid.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (grid * weights).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def neighbours(
    df: DataFrame, k: int = 5, dim: int = 64, id_col: str = "vec_id", group_col: str = "dataset", vec_col: str = "vec",
    sample: int = SAMPLE,
) -> DataFrame:
    """``(id, other_id, millionths)``: the k most similar other vectors of each usable one within
    its dataset; ``millionths`` is the cosine rounded to 6 places, times a million.

    Left out are rows whose id or dataset is null and vectors that are null, too short, all zero or
    not finite. Redelivered rows count once. Vectors of one direction are each other's neighbours at
    1; of a direction with more than HOT copies, one representative is searched together with the
    ids of its k + 1 smallest copies, so that a vector that a third of the rows share, at whatever
    length, costs no more than any other. Ties go to the smaller id. A dataset with fewer than k
    others gives fewer rows; an empty table gives an empty table.
    """
    spark = attach(df.sparkSession)
    src = source(df, id_col, group_col, vec_col, dim)

    # Copies, by hash: 20 bytes a row, combined map-side. Trees are sized by the vectors that are
    # searched and fitted on a sample of those: copies would draw the planes through them.
    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(directions(matrix(batch.column(2), dim)))], names=["id", "g", "h"])

    hashed = src.select("id", "g", "v").mapInArrow(hashing, "id long, g string, h long")
    copies = hashed.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") > HOT, 1).otherwise(F.col("n"))
    totals = copies.groupBy("g").agg(F.sum(once).alias("n"), F.max("n").alias("most")).limit(GROUPS + 1).collect()
    if len(totals) > GROUPS:
        raise ValueError(f"more than {GROUPS} datasets: the trees fitted for them would not fit a broadcast")
    sizes, any_hot = {r["g"]: r["n"] for r in totals}, any(r["most"] > HOT for r in totals)
    if any_hot:
        hot = copies.where(F.col("n") > HOT).select("g", "h")
        members = hashed.join(hot, ["g", "h"], "left_semi").select("g", "h", "id").distinct()  # ids only
        few = members.groupBy("g", "h").agg(F.min("id").alias("rep"))
        others = members.join(few, ["g", "h"]).where("id <> rep").select("id")
        searched = src.join(others, "id", "left_anti").select("id", "g", "v")
    else:
        searched = src.select("id", "g", "v")
    forest = _fitted(searched, sizes, sample, dim)
    held = spark.sparkContext.broadcast(forest)
    index = {g: i for i, g in enumerate(sorted(sizes))}
    names = sorted(sizes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaf and strings of each vector in each family."""
        for ids, g, x in _by_group(batches, dim):
            for t, tree in enumerate(held.value[g]):
                leaf = path(x, tree, _depth(tree))
                code = strings(x, leaf, tree[2], t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), index[g] * FAMILIES + t, np.int32)), pa.array(ids), pa.array(leaf.astype(np.int32)),
                        pa.array((code[:, 0] << 2 * BITS) | (code[:, 1] << BITS) | code[:, 2]),
                    ],
                    names=["tree", "id", "leaf", "code"],
                )

    codes = cut(searched.mapInArrow(coded, "tree int, id long, leaf int, code long"))
    # a row a leaf: at most SAMPLE / 16 leaves a family
    counted = codes.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    sums = {i * FAMILIES + t: np.zeros(1 << _depth(tree), np.int64) for g, i in index.items() for t, tree in enumerate(forest[g])}
    for r in counted:
        sums[r["tree"]][r["leaf"]] += r["n"]
    cut_at = spark.sparkContext.broadcast({tree: cell_depths(n) for tree, n in sums.items()})
    many = sum(int((1 << (cut_at.value[t] - _log(len(n))).clip(0)).sum()) for t, n in sums.items())
    # a task for every four cells, more where there are few cells
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(many, 4 * spark.sparkContext.defaultParallelism), many // 4)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, leaf, code = (batch.column(i).to_numpy() for i in (0, 2, 3))
            cell = np.zeros(len(tree), np.int64)
            for t in np.unique(tree).tolist():
                own = np.flatnonzero(tree == t)
                cell[own] = cells(leaf[own].astype(np.int64), code[own] >> 2 * BITS, cut_at.value[t])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), *(batch.column(i) for i in (1, 2, 3))], names=["tree", "cell", "id", "leaf", "code"])

    def descend(key: tuple, table: pa.Table) -> pa.Table:
        """How many vectors of the cell share each longer prefix with each of them, in all arrays of
        the family together."""
        depths = cut_at.value[key[0].as_py()]
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)  # redelivered rows
        leaf, code = table.column("leaf").to_numpy()[first].astype(np.int64), table.column("code").to_numpy()[first]
        d, bits = int(key[1].as_py()).bit_length() - 1, _log(len(depths)) + BITS
        parts = [(leaf << BITS) | ((code >> shift) & ((1 << BITS) - 1)) for shift in (2 * BITS, BITS, 0)]
        got = packed_counts(sum(company(c, bits, bits - d) for c in parts))
        return pa.table({
            "id": pa.array(ids), "tree": pa.array(np.full(len(ids), key[0].as_py(), np.int32)), "cell": pa.array(np.full(len(ids), key[1].as_py(), np.int64)),
            "counts": pa.array([row.tobytes() for row in got], pa.binary()),
        })

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The level of each vector, sent to its cells; where every family has one cell and the same,
        to that of the first."""
        for batch in batches:
            rows = batch.column(1)
            n = np.diff(rows.offsets.to_numpy())
            tree, cell, counts = (c.to_numpy(zero_copy_only=False) for c in rows.flatten().flatten())
            first = rows.offsets.to_numpy()[:-1] - rows.offsets.to_numpy()[0]
            depth = np.array([c.bit_length() - 1 for c in cell.tolist()], np.int64)
            level, whole = np.zeros(len(cell), np.int32), np.zeros(len(cell), bool)
            # vectors whose cells have prefixes of the same lengths ascend together
            alike: dict[tuple, list[int]] = {}
            for i, (x, m) in enumerate(zip(first.tolist(), n.tolist())):
                alike.setdefault(tuple((depth[y], len(counts[y])) for y in range(x, x + m)), []).append(x)
            for shape, starts in alike.items():
                at = np.array(starts)
                profile = [(int(d), np.frombuffer(b"".join(counts[at + j]), np.uint8).reshape(len(at), size)) for j, (d, size) in enumerate(shape)]
                got = ascend(profile, ASK)
                for j in range(len(shape)):
                    level[at + j] = got
                    whole[at + j] = not any(d for d, _ in shape)
            keep = np.flatnonzero(~whole | (tree % FAMILIES == 0))
            ids = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree[keep].astype(np.int32)), pa.array(cell[keep].astype(np.int64)), pa.array(ids[keep]), pa.array(level[keep])],
                names=["tree", "cell", "id", "level"],
            )

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, x, v in _by_group(batches, dim, raw=True):
            whole = all((cut_at.value[index[g] * FAMILIES + t] == 0).all() for t in range(FAMILIES))
            for t, tree in enumerate(held.value[g][: 1 if whole else FAMILIES]):
                leaf = path(x, tree, _depth(tree))
                own = cells(leaf, strings(x, leaf, tree[2], t)[:, 0], cut_at.value[index[g] * FAMILIES + t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), index[g] * FAMILIES + t, np.int32)), pa.array(own), pa.array(ids), v], names=["tree", "cell", "id", "v"],
                )

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t, g = key[0].as_py() % FAMILIES, names[key[0].as_py() // FAMILIES]
        ids, first = np.unique(left.column("id").to_numpy(), return_index=True)  # redelivered rows
        raw = matrix(left.column("v"), dim)[first]
        asked, at = np.unique(right.column("id").to_numpy(), return_index=True)
        level = np.zeros(len(ids), np.int64)
        level[np.searchsorted(ids, asked)] = right.column("level").to_numpy()[at]
        x = unit(raw)
        codes, bits = [], BITS + _depth(held.value[g][t])
        # the one cell of a dataset that isn't cut holds the arrays of all families
        whole = all((cut_at.value[index[g] * FAMILIES + u] == 0).all() for u in range(FAMILIES))
        for u in range(FAMILIES) if whole else [t]:
            tree = held.value[g][u]
            leaf = path(x, tree, _depth(tree))
            codes += [(leaf << BITS) | c for c in strings(x, leaf, tree[2], u).T]
        wide = _wide(raw)
        return lists(ids, ids, wide, wide, compare(x, x, codes, codes, level, bits, k), k, True)

    profiles = codes.mapInArrow(celled, "tree int, cell long, id long, leaf int, code long").groupBy("tree", "cell").applyInArrow(
        descend, "id long, tree int, cell long, counts binary"
    )
    levels = profiles.groupBy("id").agg(F.collect_list(F.struct("tree", "cell", "counts")).alias("p")).mapInArrow(  # FAMILIES rows an id
        climb, "tree int, cell long, id long, level int"
    )
    vectors = searched.mapInArrow(routed, "tree int, cell long, id long, v array<float>")
    found = (
        vectors.repartition(tasks, "tree", "cell").groupBy("tree", "cell")
        .cogroup(levels.repartition(tasks, "tree", "cell").groupBy("tree", "cell"))
        .applyInArrow(search, f"id long, best {BEST}")
    )
    merged = (
        found.groupBy("id").agg(F.flatten(F.collect_list("best")).alias("best"))  # FAMILIES short lists an id
        .select("id", F.slice(F.array_sort(F.array_distinct("best")), 1, k).alias("best"))
    )
    pairs = _with_hot(merged, members, few, k) if any_hot else merged.select("id", F.explode("best").alias("p"))
    return pairs.select(
        F.col("id").alias(id_col), F.col("p.o").alias("other_id"), (-F.col("p.c")).alias("millionths")
    )


def _log(n: int) -> int:
    return n.bit_length() - 1


def _depth(tree: tuple) -> int:
    return _log(len(tree[2]))


def _by_group(batches: Iterator[pa.RecordBatch], dim: int, raw: bool = False) -> Iterator[tuple]:
    """``(ids, dataset, unit vectors)`` of the rows of each dataset in each batch of ``id, g, v``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = np.array(batch.column(1).to_pylist(), object)
        for g in sorted(set(groups.tolist())):
            own = np.flatnonzero(groups == g)
            v = batch.column(2).take(pa.array(own))
            got = batch.column(0).to_numpy()[own], g, unit(matrix(v, dim))
            yield (*got, v) if raw else got


def _fitted(rows: DataFrame, sizes: dict[str, int], sample: int, dim: int) -> dict[str, list]:
    """The trees of each dataset, fitted on a sample of at most ``sample`` vectors over all of them,
    drawn by hash, deep enough for cells of CELL vectors as far as the sample bears it."""
    if not sizes:
        return {}
    share = max(64, sample // len(sizes))
    rate = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, share / max(1, n))))])
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < rate[F.col("g")] * 1_000_003)
    got = drawn.select("g", "id", "v").toArrow()
    names = np.array(got.column("g").to_pylist(), object)
    all_x = unit(matrix(got.column("v"), dim)) if len(names) else np.zeros((0, dim), np.float32)
    all_i = got.column("id").to_numpy()
    out = {}
    for g in sorted(sizes):
        own = np.flatnonzero(names == g)
        own = own[np.unique(all_i[own], return_index=True)[1]]
        x = all_x[own]
        depth = int(np.ceil(np.log2(max(1, sizes[g]) / CELL))) if sizes[g] > CELL else 0
        depth = min(depth, int(np.log2(len(x) / 16))) if len(x) >= 16 else 0
        out[g] = fit_forest(x, depth, dim)
    return out


def _with_hot(merged: DataFrame, members: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """Put the smallest copies of a hot vector beside its representative wherever that was found,
    and give every copy its representative's list."""
    from pyspark.sql import Window as W

    w = W.partitionBy("g", "h").orderBy("id")
    small = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    rep_of = few.select("g", "h", "rep")
    lists = (
        small.join(rep_of, ["g", "h"]).groupBy("rep")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    )
    pairs = merged.select("id", F.explode("best").alias("p"))
    # others that are representatives stand for their smallest copies
    wide = pairs.join(lists.withColumnRenamed("rep", "_o").withColumnRenamed("ids", "_ids"), F.col("p.o") == F.col("_o"), "left")
    wide = wide.select("id", F.explode(F.transform(F.coalesce("_ids", F.array("p.o")), lambda o: F.struct(F.col("p.c").alias("c"), o.alias("o")))).alias("p"))
    # copies: the representative's list, with its other copies at similarity 1 before it
    own = members.join(rep_of, ["g", "h"]).join(lists, "rep").join(merged.withColumnRenamed("id", "rep"), "rep", "left")
    own = own.select(
        F.col("id"),
        F.explode(
            F.concat(
                F.transform("ids", lambda o: F.struct(F.lit(-1_000_000).alias("c"), o.alias("o"))),
                F.coalesce("best", F.array().cast("array<struct<c:int,o:long>>")),
            )
        ).alias("p"),
    ).where("p.o <> id")
    # Lists of at most k entries, each grown by at most k + 1 copies: bounded per id.
    others = wide.join(members.select("id"), "id", "left_anti")
    every = others.unionByName(own)
    top = every.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("p")), 1, k).alias("best"))
    return top.select("id", F.explode("best").alias("p"))


def centroid_neighbours(
    df: DataFrame, centroids: DataFrame, k: int = 5, dim: int = 64, id_col: str = "vec_id", group_col: str = "dataset",
    vec_col: str = "vec", centroid_id: str = "pid",
) -> DataFrame:
    """``(id, other_id, millionths)``: the k most similar usable centroids of each vector's dataset.

    The forest of a dataset's centroids is a sorted array for each string; every vector descends
    them to its longest matches and ascends over all at once until it has ASK candidates, or all
    centroids. Forests of up to CENTROID_LIMIT centroids, counted first, are broadcast; a larger
    table is searched in slices of that size, one pass over the vectors each. Left out are vectors
    and centroids that aren't usable; redelivered rows count once.
    """
    spark = attach(df.sparkSession)
    src = source(df, id_col, group_col, vec_col, dim)
    cen = source(centroids, centroid_id, group_col, "vec", dim).toDF("c", "g", "w").dropDuplicates(["g", "c"])
    n = cen.count()
    slices = 1 if n <= CENTROID_LIMIT else -(-2 * n // CENTROID_LIMIT)
    found = None
    for s in range(slices):
        own = cen if slices == 1 else cen.where(F.pmod(F.xxhash64("g", "c"), F.lit(slices)) == s)
        got = own.limit(CENTROID_LIMIT + 1).toArrow()
        if got.num_rows > CENTROID_LIMIT:
            raise ValueError("a slice of the centroids is larger than a broadcast may be")
        part = _descending(src, got, k, dim)
        found = part if found is None else found.unionByName(part)
    top = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("best")))), 1, k).alias("best"))
    return top.select(F.col("id").alias(id_col), F.explode("best").alias("p")).select(id_col, F.col("p.o").alias("other_id"), (-F.col("p.c")).alias("millionths"))


def _descending(src: DataFrame, got: pa.Table, k: int, dim: int) -> DataFrame:
    """Each vector's list among the centroids of one broadcast."""
    names = np.array(got.column("g").to_pylist(), object)
    w, c = matrix(got.column("w"), dim), got.column("c").to_numpy()
    forest = {}
    for g in sorted(set(names.tolist())):
        own = np.flatnonzero(names == g)
        own = own[np.argsort(c[own], kind="stable")]
        y = unit(w[own])
        centre = y.mean(axis=0, keepdims=True)
        codes = [a for t in range(FAMILIES) for a in strings(y, np.zeros(len(y), np.int64), centre, t).T]
        forest[g] = c[own], _wide(w[own]), y, centre, codes
    held = src.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, x, v in _by_group(batches, dim, raw=True):
            if g not in held.value:
                continue
            others, wide, y, centre, codes = held.value[g]
            own = [a for t in range(FAMILIES) for a in strings(x, np.zeros(len(x), np.int64), centre, t).T]
            level = np.zeros(len(x), np.int64)
            for at in range(1, BITS + 1):
                shift, total = BITS - at, np.zeros(len(x), np.int64)
                for q, items in zip(own, codes):
                    s = np.sort(items) >> shift
                    total += np.searchsorted(s, q >> shift, "right") - np.searchsorted(s, q >> shift, "left")
                if not (total >= ASK).any():
                    break
                level[total >= ASK] = at
            pairs = compare(x, y, own, codes, level, BITS, k)
            yield from lists(ids, others, _wide(matrix(v, dim)), wide, pairs, k, False).to_batches()

    return src.select("id", "g", "v").mapInArrow(run, f"id long, best {BEST}")


def _wide(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
