from pyspark.sql import functions as F

from evigraph.llm import canonical as C

SCHEMA = "node_id string, content string, metadata struct<title:string>, h128 string"


def kept(spark, rows):
    df = spark.createDataFrame([(i, c, (t,), "clash") for i, c, t in rows], SCHEMA)
    pairs = C.copies(df, "node_id", F.col("content"), F.col("metadata.title"), "kept", "copy").collect()
    return {(r.kept, r.copy) for r in pairs}


def test_form_alone_is_no_difference(spark):
    rows = [
        ("a", "The well-known Straße opened in 1,900.", "T (dam)"), ("b", "  the WELL known STRASSE -- opened in 1,900!\r\n", "t, DAM"),
        ("c", "The well-known Straße opened in 1900.", "T (dam)"), ("d", "The well-known Strasé opened in 1,900.", "T (dam)"),
        ("e", "Opened in 1,900 the well-known Straße.", "T (dam)"), ("f", "The well-known Straße opened in 1,900.", None),
        ("g", "the well known straße opened in 1,900", None), ("h", "The well-known Straße opened in 1,900.", ""),
    ]
    assert kept(spark, rows) == {("a", "b"), ("f", "g")}


def test_fields_may_change_their_order(spark):
    rows = [
        ("a", '{"name": "X", "born in": "Rome", "n": "3.5"}', "X"), ("b", '{"born in": "ROME", "n": "3.5",  "name": "X"}', "X"),
        ("c", '{"name": "Rome", "born in": "X", "n": "3.5"}', "X"), ("d", "X. born in: Rome; length: 3", "X"), ("e", "x. length: 3 | born in: rome;", "X"),
        ("f", "born in: Rome\nlength: 3\n", "X"), ("g", "length: 3\r\nborn in: Rome;", "X"), ("h", "X. born in: 3; length: Rome", "X"),
    ]
    assert kept(spark, rows) == {("a", "b"), ("d", "e"), ("f", "g")}


def test_long_names_of_fields_and_nested_objects(spark):
    name = "the name under which the building is known " * 4
    rows = [
        ("a", f"{name}: X\nborn in: Rome", "t"), ("b", f"born in: Rome\n{name}: X", "t"), ("c", f"N. {name}: X; born in: Rome", "t"), ("d", f"N. born in: Rome; {name}: X", "t"),
        ("e", '{"p": {"x": 1, "y": {"b": 2, "a": [1, {"d": 1, "c": 2}]}}, "q": 1}', "t"), ("f", '{"q": 1, "p": {"y": {"a": [1, {"c": 2, "d": 1}], "B": 2}, "x": 1}}', "t"),
        ("g", '{"q": 1, "p": {"y": {"a": [1, {"c": 1, "d": 2}], "b": 2}, "x": 1}}', "t"), ("h", '{"q": [2, {"a": 1}]}', "t"), ("i", '{"q": [{"a": 1}, 2]}', "t"),
    ]
    assert kept(spark, rows) == {("a", "b"), ("c", "d"), ("e", "f")}


def test_numbers_keep_their_marks(spark):
    rows = [("a", "costs 5.6 crowns", "t"), ("b", "costs 56 crowns", "t"), ("c", "costs 5 6 crowns", "t"), ("d", "costs 5.6, crowns.", "t"), ("e", "on 10:30", "t"), ("f", "on 10.30", "t")]
    assert kept(spark, rows) == {("a", "d")}


def test_blanks_nulls_redelivery_and_counts(spark):
    rows = [("a", None, "t"), ("b", " \n", "t"), ("c", "x", "t"), ("c", "x", "t"), ("d", "X!", "t"), ("e", ";;;", "t"), ("f", "...", "t"), (None, "x", "t")]
    df = spark.createDataFrame([(i, c, (t,), "clash") for i, c, t in rows], SCHEMA)
    args = (df, "node_id", F.col("content"), F.col("metadata.title"))
    assert {(r.kept, r.copies) for r in C.collapse(*args).collect()} == {("c", 2), ("e", 2)}
    assert C.collisions(*args).count() == 0
    empty = (df.limit(0), *args[1:])
    assert C.collapse(*empty).count() == 0 and C.copies(*empty, "k", "c").count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(3000).select(F.format_string("n%05d", "id").alias("node_id"), F.when(F.col("id") % 3 == 0, "Same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("content"), F.struct(F.lit("t").alias("title")).alias("metadata"))
    got = C.copies(df, "node_id", F.col("content"), F.col("metadata.title"), "kept", "copy")
    assert got.count() == 999 and {r.kept for r in got.select("kept").distinct().collect()} == {"n00000"}
