"""Problem 7: filling containers of fixed capacity with texts along a space-filling curve.

Each text is sized in tokens and its hashed token vector projected to four dimensions, which a
Hilbert key orders: neighbours on the curve are alike. The curve is cut at bounded blocks, which are
packed by themselves, each along the curve: a container takes the next texts in their order while
they fit, and what fits best among the LOOK texts ahead closes it, so that neighbours share it.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.tokens import encoder, spread, vocabulary
from evigraph.session import attach, cut

DIMS, BITS = 4, 8  # of the Hilbert curve
HASHED = 1 << 15  # buckets of the hashed token vectors
PREFIX = 16  # bits of the key by which blocks are cut: 65,536 counts at most come to the driver
BLOCK = 8_192  # texts of a task, at most about this many
LOOK = 256  # texts ahead on the curve that may join a container
BUDGETS = 10_000  # rows of the budget table


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points ``(n, d)``, by Skilling's transform on all rows at once."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((HASHED, DIMS)).astype(np.float32)


def sized(df: DataFrame, id_col: str, text_col: str, tokenizers: list[str], folder: str | None = None) -> DataFrame:
    """``(id, sizes ARRAY<BIGINT>, key)`` of the texts that aren't null or empty: tokens by each
    tokenizer, and the Hilbert key of the hashed vector of the first one's tokens. Whole texts are
    encoded and counted."""
    spark = attach(df.sparkSession)
    held = [vocabulary(spark, name, folder) for name in tokenizers]
    src = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(name, h.value) for name, h in zip(tokenizers, held)]
        table = _directions()
        for batch in batches:
            sizes, points = [], np.zeros((batch.num_rows, DIMS), np.float64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoders[0](text)
                sizes.append([len(ids), *(len(e(text)) for e in encoders[1:])])
                if ids:
                    hashed, n = np.unique(np.asarray(ids) % HASHED, return_counts=True)
                    weight = np.sqrt(n)
                    points[i] = weight @ table[hashed] / np.sqrt((weight * weight).sum())
            # coordinates are about normal: the logistic curve spreads them evenly over the cells
            cells = np.minimum((1 << BITS) - 1, ((1 << BITS) / (1 + np.exp(-1.7 * points))).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.list_(pa.int64())), pa.array(hilbert(cells, BITS))], names=["_id", "sizes", "key"]
            )

    return spread(src, "_id").mapInArrow(run, f"_id {id_type}, sizes array<long>, key long")


def fill(sizes: list[int], capacity: int, look: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pack items in their order on the curve: ``(item, piece, start, container)`` rows and the
    number of containers.

    A container takes the items that come next on the curve while they fit; then, of the ``look``
    items ahead, the largest that still fits, of equal ones the nearest, until none does. An item
    larger than a container is cut into full ones and a rest, which is packed as an item."""
    look = LOOK if look is None else look
    out, n = [], 0
    rests = []
    for i, size in enumerate(sizes):
        piece, start = 0, 0
        while size - start > capacity:
            out.append((i, piece, start, n))
            piece, start, n = piece + 1, start + capacity, n + 1
        if size > start:
            rests.append((size - start, i, piece, start))
    ahead: list[tuple[int, int]] = []  # size and negated place of the items in view, sorted
    used = [False] * len(rests)
    first = seen = 0
    while first < len(rests):
        room, ordered = capacity, True
        while True:
            while seen < len(rests) and len(ahead) <= look:
                insort(ahead, (rests[seen][0], -seen))
                seen += 1
            while first < len(rests) and used[first]:
                first += 1
            ordered = ordered and first < len(rests) and rests[first][0] <= room
            fits = bisect_right(ahead, (rests[first][0], -first) if ordered else (room, 1))
            if not fits:
                break
            size, at = ahead.pop(fits - 1)
            used[-at] = True
            out.append((*rests[-at][1:], n))
            room -= size
        n += 1
    return out, n


def pack(df: DataFrame, budgets: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``(budget_id, block, context, id, piece, start, tokens, place)``: for each budget, where each
    text goes; ``(block, context)`` names a container, ``start`` and ``tokens`` the part of the text,
    ``place`` its rank on the block's part of the curve.

    Null and empty texts are left out, as are texts without tokens and budgets without a positive
    capacity. A text is cut only if it alone exceeds the capacity. Repeated rows are packed as often
    as they occur. A place on the curve that holds more texts than a block, as copies of one text
    do, is cut by the hash of the id, so no task gets more than about BLOCK texts.
    """
    spark = attach(df.sparkSession)
    rows = budgets.where("budget_id is not null and capacity > 0 and tokenizer is not null").select("budget_id", "tokenizer", "capacity").dropDuplicates(["budget_id"]).limit(BUDGETS + 1).collect()
    if len(rows) > BUDGETS:
        raise ValueError("the budget table is larger than it can be")
    names = sorted({r["tokenizer"] for r in rows})
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"budget_id int, block long, context long, {id_col} {id_type}, piece int, start long, tokens long, place long"
    if not rows:
        return spark.createDataFrame([], schema)
    items = cut(sized(df, id_col, text_col, names, folder))
    low = DIMS * BITS - PREFIX
    counts = sorted(items.groupBy(F.shiftright("key", low).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    blocks, block, inside = [], 0, 0
    for p, n in counts:
        if inside and inside + n > BLOCK:
            block, inside = block + 1, 0
        parts = -(-n // BLOCK)
        blocks.append((p, block, parts))
        inside += n
        if parts > 1:
            block, inside = block + parts, 0
    table = spark.createDataFrame(blocks, "p long, first long, parts long")
    placed = items.withColumn("p", F.shiftright("key", low)).join(table, "p").select(
        "_id", "sizes", "key", (F.col("first") + F.pmod(F.xxhash64("_id"), F.col("parts"))).alias("block")
    )
    caps = [(int(r["budget_id"]), names.index(r["tokenizer"]), int(r["capacity"])) for r in sorted(rows)]
    # one task a block packs it for every budget: the texts' sizes are shuffled once
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("_id", "ascending")])
        sizes = np.asarray(group.column("sizes").to_pylist(), np.int64).reshape(group.num_rows, len(names))
        parts = []
        for budget, which, capacity in caps:
            own = sizes[:, which]
            got, _ = fill(own.tolist(), capacity)
            if not got:
                continue
            i, piece, start, box = (np.asarray(x) for x in zip(*got))
            parts.append(
                pa.table({
                    "budget_id": pa.array(np.full(len(i), budget, np.int32)),
                    "block": pa.array(np.full(len(i), key[0].as_py(), np.int64)),
                    "context": pa.array(box.astype(np.int64)),
                    id_col: group.column("_id").take(pa.array(i)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start.astype(np.int64)),
                    "tokens": pa.array(np.minimum(capacity, own[i] - start)),
                    "place": pa.array(i.astype(np.int64)),
                })
            )
        return pa.concat_tables(parts) if parts else pa.schema([("budget_id", pa.int32()), ("block", pa.int64()), ("context", pa.int64()), (id_col, group.schema.field("_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()), ("place", pa.int64())]).empty_table()

    # as many tasks as blocks, for their rows are few bytes and would be put together into one task
    tasks = max(1, min(block + 1, 4 * spark.sparkContext.defaultParallelism))
    return placed.repartition(tasks, "block").groupBy("block").applyInArrow(run, schema)


def fullness(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(budget_id, contexts, tokens, least, fill, span)``: containers used, tokens in them, the
    number that no packing can go below, the share of the room that is filled, and over how many
    places of the curve a container's texts are spread on average."""
    boxes = packed.groupBy("budget_id", "block", "context").agg(F.sum("tokens").alias("t"), (F.max("place") - F.min("place") + 1).alias("s"))
    per = boxes.groupBy("budget_id").agg(F.count(F.lit(1)).alias("contexts"), F.sum("t").alias("tokens"), F.avg("s").alias("span"))
    b = budgets.select("budget_id", "capacity").dropDuplicates(["budget_id"])
    return per.join(b, "budget_id").select(
        "budget_id", "contexts", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"),
        (F.col("tokens") / (F.col("contexts") * F.col("capacity"))).alias("fill"), "span",
    )


def audit(packed: DataFrame, budgets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(budget_id, texts, over, torn, gaps)``: texts that were packed, containers over capacity,
    texts cut though they fit, and texts whose pieces leave out or repeat tokens; the last three are
    0 if the packing is right."""
    b = budgets.select("budget_id", "capacity").dropDuplicates(["budget_id"])
    boxes = packed.groupBy("budget_id", "block", "context").agg(F.sum("tokens").alias("t")).join(b, "budget_id")
    texts = packed.groupBy("budget_id", id_col).agg(
        F.sum("tokens").alias("t"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.count(F.lit(1)).alias("n"), F.count_distinct("start").alias("starts"),
    ).join(b, "budget_id")
    over = boxes.groupBy("budget_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("over"))
    per = texts.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("torn"),
        F.count_if((F.col("t") != F.col("end")) | (F.col("n") != F.col("starts"))).alias("gaps"),
    )
    return per.join(over, "budget_id").select("budget_id", "texts", "over", "torn", "gaps")
