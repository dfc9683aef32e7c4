"""Problem 2: duplicates hidden by formatting differences.

Everything up to the hash is a JVM expression: characters, case, white space, punctuation and the
order of fields are canonicalised, the result is hashed to 128 bits, and counts are aggregated
with map-side combining. A second, independent 64-bit hash and the length of the canonical form
are part of the grouping key, so that two contents that collide on the 128 bits stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"\s\p{Z}\p{Cc}"
#: Characters that part words: spaces, all punctuation and the ASCII marks that serve as
#: separators. Currency and arithmetic signs stay, for they carry meaning.
_PART = rf"[[^a-z0-9]&&[{_SPACE}\p{{P}}|`~^]]"  # the first test settles most characters
#: A run of them, but for a single mark between two digits, which is part of the number.
_RUN = rf"(?s){_PART}(?:(?<![0-9].){_PART}*+|{_PART}++|(?![0-9])|(?<=[{_SPACE}]))"
_HIDDEN = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+"
_FIELD = r"^\s*[^:\n.!?]++:\s*\S"


def words(c: Column) -> Column:
    """Lower-case words parted by one space, without punctuation. A mark between two digits is
    part of the number and stays."""
    c = F.lower(c)
    # sharp s and its capital spelling meet; what doesn't show can't be in a text of ASCII alone
    wide = F.regexp_replace(F.replace(c, F.lit("\u00df"), F.lit("ss")), _HIDDEN, "")
    c = F.when(F.length(c) == F.octet_length(c), c).otherwise(wide)
    return F.trim(F.regexp_replace(c, _RUN, " "))


def _sorted(value: Column) -> Column:
    """A JSON value with the keys of its objects in order; other values as they are."""
    inner = value.rlike(r"^[{\[]") & value.contains("{")
    return F.when(inner, F.coalesce(F.to_json(F.try_parse_json(F.lower(value))), value)).otherwise(value)


def with_form(df: DataFrame, content: Column, title: Column) -> DataFrame:
    """Adds ``_form``, the canonical form of content and title.

    The content's form is its words or, of a record, the sorted words of its fields; objects inside a
    JSON object have the order of their keys, at any depth. A record is a JSON object, lines ``relation: value``, or ``relation: value`` items parted by ``;`` or ``|``
    after a name and a full stop. Each step is a projection of its own, so that an expression that
    several others use is computed once, and only where the ones before ask for it."""
    text, n = F.col("_text"), F.length("_name")
    shown = lambda x: x.rlike(rf"[^{_SPACE}\p{{P}}|]")
    is_field = lambda x: x.rlike(_FIELD)
    out = df.withColumn("_title", title).withColumn("_text", F.btrim(content, F.lit(" \t\r\n\u00a0\u2007\u202f;")))
    marked = text.contains(":")
    out = out.withColumns({
        "_json": F.when(text.startswith("{"), F.map_entries(F.from_json(text, "map<string,string>"))),
        "_lines": F.when(marked & text.rlike(r"[\r\n]"), F.filter(F.split(text, r"[\r\n\u2028\u2029]+"), shown)),
        # the name goes before the first full stop and has no colon
        "_name": F.when(marked & text.rlike("[;|]"), F.regexp_extract(text, rf"^([^:;|]*?)\.[{_SPACE}]+[^:.;|!?]++:", 1)),
    })
    rest = F.when(n > 0, F.substring(text, n + F.lit(2), F.length(text))).otherwise(text)
    out = out.withColumn("_items", F.when(F.col("_name").isNotNull(), F.filter(F.split(rest, "[;|]"), shown)))
    fields = (
        F.when(
            F.size("_json") > 0,
            F.transform("_json", lambda e: F.concat_ws(" ", e["key"], F.coalesce(_sorted(e["value"]), F.lit("null")))),
        )
        .when((F.size("_lines") > 1) & F.forall("_lines", is_field), F.col("_lines"))
        .when(
            (F.size("_items") > 0) & F.forall("_items", is_field),
            F.when(n > 0, F.concat(F.array("_name"), "_items")).otherwise(F.col("_items")),
        )
    )
    out = out.withColumn("_fields", fields)
    body = F.when(F.col("_fields").isNull(), words(text)).otherwise(
        F.concat_ws("\u0001", F.array_sort(F.transform("_fields", words)))
    )
    # a null title equals only a null title: it is written as a form that no title can take
    form = F.concat(body, F.lit("\u0002"), F.coalesce(words(F.col("_title")), F.lit("\u0003")))
    return out.withColumn("_form", form)


def keyed(df: DataFrame, id_col: str, content: Column, title: Column) -> DataFrame:
    """``id, h128, check64, size`` of each row whose content isn't null or blank."""
    # filtered before the steps: a filter on their result would be pushed below them and repeat them
    src = df.where(F.col(id_col).isNotNull() & content.rlike(rf"[^{_SPACE}]")).withColumn("_id", F.col(id_col))
    forms = with_form(src, content, title).select("_id", "_form")
    return forms.select(
        F.col("_id").alias(id_col),
        F.unhex(F.md5("_form")).alias("h128"),
        F.xxhash64("_form").alias("check64"),
        F.length("_form").alias("size"),
    )


KEY = ("h128", "check64", "size")


def collapse(df: DataFrame, id_col: str, content: Column, title: Column) -> DataFrame:
    """One row per distinct node: ``kept`` (smallest id in byte order) and ``copies``.

    ``copies`` counts distinct ids, so redelivered rows count once. Null or blank contents are left
    out; further columns are ignored; an empty table gives an empty table. The hash of a group that
    holds a third of all rows is combined map-side to one row per task before the shuffle.
    """
    rows = keyed(df, id_col, content, title)
    # a redelivered row repeats its id: first fold ids (spread evenly), then groups (combined map-side)
    ids = rows.dropDuplicates([id_col, *KEY])
    return ids.groupBy(*KEY).agg(F.min(id_col).alias("kept"), F.count(F.lit(1)).alias("copies"))


def copies(df: DataFrame, id_col: str, content: Column, title: Column, kept: str, copy: str) -> DataFrame:
    """``(kept, copy)`` for every member of a group but its smallest id.

    Only ids and hashes are joined, never texts. A hot group is one row on the side of the groups;
    the side of its members is split by the adaptive skew join.
    """
    rows = keyed(df, id_col, content, title)
    ids = rows.dropDuplicates([id_col, *KEY])
    groups = ids.groupBy(*KEY).agg(F.min(id_col).alias(kept), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (
        ids.join(groups.drop("_n"), list(KEY))
        .where(F.col(id_col) != F.col(kept))
        .select(kept, F.col(id_col).alias(copy))
    )


def collisions(df: DataFrame, id_col: str, content: Column, title: Column) -> DataFrame:
    """128-bit hashes under which different canonical forms meet; empty unless hashes collide."""
    return (
        keyed(df, id_col, content, title)
        .groupBy("h128")
        .agg(
            F.min("check64").alias("a"), F.max("check64").alias("b"),
            F.min("size").alias("c"), F.max("size").alias("d"), F.count(F.lit(1)).alias("rows"),
        )
        .where("a <> b or c <> d")
        .select(F.hex("h128").alias("h128"), "rows")
    )

