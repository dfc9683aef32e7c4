"""The contract of run rows: validation, hydration, end-to-end scores, paired comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.stats import mcnemar
from evigraph.operators.metrics import answer_scores


def violations(rows: DataFrame) -> DataFrame:
    """``(id, problem)`` of rows that break the contract: a missing id or question, an id that occurs
    with different contents, repeated retrieved ids, ranks that aren't 1..n, negative latencies or
    token counts. Whole repeats of a row are redeliveries, not violations."""
    checks = F.array_compact(
        F.array(
            F.when(F.col("id").isNull(), "missing id"),
            F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "missing question"),
            F.when(F.size("retrieved_document_ids") != F.size(F.array_distinct("retrieved_document_ids")), "repeated retrieved id"),
            F.when(F.exists("contexts", lambda c: c["rank"] < 1) | (F.size(F.array_distinct(F.transform("contexts", lambda c: c["rank"]))) != F.size("contexts")), "bad context rank"),
            F.when(F.col("latency_ms.total") < 0, "negative latency"),
            F.when((F.col("usage.prompt_tokens") < 0) | (F.col("usage.completion_tokens") < 0), "negative usage"),
        )
    )
    own = rows.select("id", F.explode(checks).alias("problem")).distinct()
    twice = rows.where("id is not null").select("id", F.xxhash64("question", "prediction", "retrieved_document_ids").alias("h")).groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    return own.unionByName(twice.select("id", F.lit("id with different contents").alias("problem")))


def hydrate(external: DataFrame, documents: DataFrame, budget: int, max_k: int = 100) -> DataFrame:
    """External rankings ``(query_id, doc_ids)`` joined to documents ``(doc_id, title)``: unknown ids
    are dropped, the rest renumbered and cut at ``max_k``; the first ``budget`` are contexts."""
    p = external.select("query_id", F.posexplode("doc_ids").alias("pos", "doc_id"))
    known = p.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos")).join(documents, "doc_id")
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy("pos")).cast("long")
    return known.withColumn("rnk", rnk).where(F.col("rnk") <= max_k).withColumn("context", F.col("rnk") <= budget)


def end_to_end(rows: DataFrame, ks: list[int]) -> DataFrame:
    """One row an id: recall, full coverage, evidence F1 at each k, EM, F1, joint scores, whether an
    answer is in a context. Gold-less rows score 0, unanswerable ones have null answer scores."""
    g = F.array_distinct(F.coalesce("supporting_document_ids", F.array().cast("array<string>")))
    r = F.array_distinct(F.coalesce("retrieved_document_ids", F.array().cast("array<string>")))
    base = rows.select("id", "system", g.alias("g"), r.alias("r"), "prediction", "answers", F.transform("contexts", lambda c: F.lower(F.coalesce(c["text"], F.lit("")))).alias("ctx"))
    cols = ["id", "system"]
    for k in ks:
        top = F.slice("r", 1, k)
        hit = F.size(F.array_intersect("g", top))
        rec = F.when(F.size("g") > 0, hit / F.size("g")).otherwise(0.0)
        prec = F.when(F.size(top) > 0, hit / F.size(top)).otherwise(0.0)
        cols += [
            F.round(rec, 6).alias(f"recall_{k}"),
            F.when((F.size("g") > 0) & (hit == F.size("g")), 1).otherwise(0).alias(f"full_{k}"),
            F.round(F.when(hit > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0), 6).alias(f"evidence_f1_{k}"),
        ]
    known = F.filter("answers", lambda a: F.trim(a) != "")
    inside = F.when(F.size(known) > 0, F.exists(known, lambda a: F.exists("ctx", lambda c: c.contains(F.lower(a)))).cast("int"))
    scored = base.select(*cols, inside.alias("answer_in_context"))
    ans = answer_scores(rows, "id", "prediction", "answers")
    k = max(ks)
    return scored.join(ans, "id").withColumn("joint_em", F.col("em") * F.col(f"full_{k}")).withColumn("joint_f1", F.round(F.col("f1") * F.col(f"evidence_f1_{k}"), 6))


FROZEN = ("question", "answers", "supporting_document_ids")  # what two runs must have in common


def differing(a: DataFrame, b: DataFrame, key: str = "id", frozen: tuple[str, ...] = FROZEN) -> DataFrame:
    """``(key, problem)``: keys that only one side has, and keys whose frozen fields differ."""
    cols = [c for c in frozen if c in a.columns and c in b.columns]
    x = a.select(key, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols]).dropDuplicates([key])
    y = b.select(key, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols]).dropDuplicates([key])
    j = x.join(y, key, "full_outer")
    same = [F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs") for c in cols]
    problems = F.array_compact(F.array(F.when(F.col("_b").isNull(), "only in the first"), F.when(F.col("_a").isNull(), "only in the second"), *same))
    return j.select(key, F.explode(problems).alias("problem"))


def compare(a: DataFrame, b: DataFrame, value: str, strict: bool = True) -> DataFrame:
    """Paired comparison of two systems on a common key ``pair``: wins, ties, losses, difference of
    the means and McNemar's p of the wins against the losses. Both must have the same keys, else it
    is refused; without ``strict`` keys of one side only are counted."""
    if strict and not differing(a, b, "pair", ()).isEmpty():
        raise ValueError("a paired comparison needs identical query IDs")
    j = a.select("pair", F.col(value).alias("x"), F.lit(1).alias("a")).join(b.select("pair", F.col(value).alias("y"), F.lit(1).alias("b")), "pair", "full_outer")
    s = j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("pairs"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"),
        F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"),
        F.round(F.avg(F.col("x") - F.col("y")), 6).alias("difference"),
    )
    return s.withColumn("p", F.round(mcnemar(F.col("wins"), F.col("losses")), 6))


def digits(seed: int, blocks: int, *key: str):
    """32 hexadecimal digits a block of MD5, from a seed and the row's key: the source of randomness,
    the same in any engine."""
    own = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    return F.concat(*[F.md5(F.concat(F.lit(f"{seed}:{i}:"), own)) for i in range(blocks)])


def _bytes(column: pa.Array, hexes: int) -> np.ndarray:
    """Values of the digits, ``(rows, hexes)``."""
    raw = np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(len(column), -1)[:, :hexes]
    return np.where(raw < 58, raw - 48, raw - 87)


#: Of a byte, where the count of a Poisson draw of mean 1 goes up.
POISSON = (94, 188, 235, 251, 255)


def bootstrap(df: DataFrame, keys: list[str], value: str, draws: int = 200, seed: int = 7, ident: str = "id") -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: each row gets an independent count
    for each draw from two digits of its hash, so replicates are sums that combine map-side, whatever
    the rows. Rows without a value are left out."""
    group = [F.col(k).cast("string").alias(k) for k in keys]
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"), digits(seed, -(-2 * draws // 32), ident).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _bytes(batch.column(len(keys) + 1), 2 * draws)
            w = np.searchsorted(POISSON, 16 * d[:, ::2] + d[:, 1::2], "right")
            v = batch.column(len(keys)).to_numpy()
            own = pa.Table.from_batches([batch]).select(keys).append_column("_i", pa.array(np.arange(batch.num_rows)))
            for g in own.group_by(keys, use_threads=False).aggregate([("_i", "list")]).to_pylist():
                i = np.asarray(g["_i_list"])
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([g[k]] * draws, pa.string()) for k in keys], pa.array(np.arange(draws)), pa.array(v[i] @ w[i]), pa.array(w[i].sum(axis=0))], names=[*keys, "draw", "s", "n"],
                )

    schema = "".join(f"{k} string, " for k in keys) + "draw long, s double, n long"
    reps = rows.mapInArrow(run, schema).groupBy(*keys, "draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    return reps.groupBy(*keys).agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def sign_flip(pairs: DataFrame, difference: str, draws: int = 500, seed: int = 11, ident: str = "id") -> DataFrame:
    """Paired sign-flip randomisation: p = (extreme + 1) / (draws + 1); a sign is a bit of the row's
    hash, replicates are sums."""
    rows = pairs.where(F.col(difference).isNotNull()).select(F.col(difference).cast("double").alias("d"), digits(seed, -(-draws // 128), ident).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                four = _bytes(batch.column(1), -(-draws // 4))
                bits = ((four[:, :, None] >> np.array([3, 2, 1, 0])) & 1).reshape(batch.num_rows, -1)[:, :draws]
                d = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1)), pa.array(np.append(d @ (2 * bits - 1), d.sum()))], names=["draw", "s"])

    sums = rows.mapInArrow(run, "draw long, s double").groupBy("draw").agg(F.sum("s").alias("s"))
    # one row a draw: the observed sum beside each
    both = sums.agg(F.collect_list(F.when(F.col("draw") < draws, F.abs("s"))).alias("flipped"), F.max(F.when(F.col("draw") == draws, F.abs("s"))).alias("o"))
    return both.select(F.round((F.size(F.filter("flipped", lambda s: s >= F.col("o") - 1e-9)) + 1) / (draws + 1), 6).alias("p"))
