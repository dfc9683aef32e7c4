"""The queries of the training-data operators: SQL equivalence where there is SQL, invariants elsewhere."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine, theirs = Q.queries()[name](spark, SF), duck.execute(Q.oracle_sql()[name])
    cols = sorted(mine.columns)
    names = [d[0] for d in theirs.description]
    assert sorted(names) == cols
    want = sorted(str([row[names.index(c)] for c in cols]) for row in theirs.fetchall())
    assert sorted(str(list(r)) for r in mine.select(*cols).collect()) == want


def test_every_query_runs_with_its_columns(spark):
    want = {
        "p1_found": "id defect", "p1_labels": "id defect posterior", "p1_cutoffs": "defect cutoff good alarms made caught", "p2_collisions": "h128 rows", "p4_balance": "split queries share wanted",
        "p4_splits": "query_id split", "p5_counts": "split source queries exact near", "p5_found": "query_id_a query_id_b", "p5_links": "class_a class_b similarity queries_a queries_b",
        "p5_members": "query_id class_id links", "p6_ids": "doc_id ids", "p7_fill": "budget_id contexts tokens least fill span", "p8_canonical": "doc_id form", "p8_classes": "doc_id class_id twins", "p8_found": "doc_id_a doc_id_b",
    }
    for name, cols in want.items():
        df = Q.queries()[name](spark, SF)
        assert df.columns == cols.split(), name
        assert df.count() >= 0


def test_classes_agree_with_pairs(spark):
    pairs = Q.p8_found(spark, SF)
    both = pairs.select(F.col("doc_id_a").alias("doc_id")).union(pairs.select("doc_id_b")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    classes = {r.doc_id: r.twins for r in Q.p8_classes(spark, SF).where("twins > 0").collect()}
    assert {r.doc_id: r.n for r in both.collect()} == classes
    links = Q.p5_members(spark, SF).agg(F.sum("links")).first()[0]
    assert links == 2 * Q.p5_found(spark, SF).count()
