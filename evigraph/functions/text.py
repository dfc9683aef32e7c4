"""Scalar text functions as column expressions; all stay on the JVM."""

from __future__ import annotations

import csv
import io
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII punctuation, as a character class.
PUNCT = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def tokens(c: Column) -> Column:
    """Lower-case words parted by white space; null and blank give an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


def alnum(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower case; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normal_answer(c: Column) -> Column:
    """Answer normalisation: lower case, no ASCII punctuation, no English articles, single blanks."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCT, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\b(a|an|the)\b", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def compatible(c: pd.Series) -> pd.Series:
    """Compatibility form (NFKC), which the JVM's functions lack."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def folded(c: pd.Series) -> pd.Series:
    """Compatibility form without case: NFKC and full case folding."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()))


def content_key(title: Column, text: Column) -> Column:
    """Content-addressed key of a document: compatibility form, white space collapsed, the title
    without case."""
    return F.sha2(F.concat(squeezed(folded(F.coalesce(title, F.lit("")))), F.lit("\n"), squeezed(compatible(F.coalesce(text, F.lit(""))))), 256)


def title_or_id(title: Column, ident: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), ident.cast("string"))


def relation_label(path: Column) -> Column:
    """Last part of a dotted relation path, underscores as blanks."""
    return F.replace(F.element_at(F.split(path, r"\."), -1), F.lit("_"), F.lit(" "))


#: White space of any script, and what parts sentences where no double blank does.
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
SENTENCE_END = rf"([.!?]){BLANK}+([A-Z0-9\"'])"


def squeezed(c: Column) -> Column:
    """White space at the ends gone, inside it single blanks."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def sentences(c: Column) -> Column:
    """Sentences: where a text has two or more white spaces in a row anywhere, those part it; only
    else a white space after ``.!?`` before a capital, a digit or a quote does. White space inside a
    sentence becomes one blank, blank sentences go; null gives none."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{BLANK}+|{BLANK}+$", ""), "\r\n?", "\n")
    marked = F.regexp_replace(text, SENTENCE_END, "$1\u0001$2")
    parts = F.when(text.rlike(BLANK + "{2,}"), F.split(text, BLANK + "{2,}")).otherwise(F.split(marked, "\u0001"))
    return F.filter(F.transform(parts, squeezed), lambda x: x != "")


def triplets(c: Column) -> Column:
    """Triples of ``<h##r##t>$$<...>``; those without three non-blank parts are dropped, repeats too."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\$\$"), lambda x: F.split(F.regexp_replace(F.trim(x), r"^<|>$", ""), "##"))
    good = F.filter(parts, lambda p: (F.size(p) == 3) & ~F.exists(p, lambda y: F.trim(y) == ""))
    return F.array_distinct(F.transform(good, lambda p: F.struct(F.trim(p[0]).alias("h"), F.trim(p[1]).alias("r"), F.trim(p[2]).alias("t"))))


#: What parts a question, what a span of names is, what may stand before one, and
#: words that are no sub-query.
PART = r"\band\b|\bor\b|,|;|\bwhose\b|\bhave\b"
NAMES = r"[A-Z][\p{L}\p{N}_.'\x{2019}&:\-]*(?:\s+(?:[A-Z][\p{L}\p{N}_.'\x{2019}&:\-]*|of|the|to|de|for|a|an|in|\([^)]*\)))*"
LEAD = r"^(?:Are|Do|Does|Which|What|Who|Where|When|Is|Both|The)\b\s*"
NO_QUERY = ("film", "films", "director", "directors", "the")


def decompose(c: Column) -> Column:
    """Sub-queries of a question, each once, in order: itself, bracketed spans, and spans of names in
    its parts, with connecting words inside them, without a leading question word, longer than two
    characters; null gives null."""
    brackets = F.transform(F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1)), F.trim)
    spans = F.flatten(F.transform(F.split(c, PART), lambda p: F.regexp_extract_all(p, F.lit(NAMES), F.lit(0))))
    spans = F.transform(spans, lambda x: F.trim(F.regexp_replace(F.trim(x), LEAD, "")))
    good = F.filter(spans, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*NO_QUERY))
    return F.array_distinct(F.concat(F.array(c), F.filter(brackets, lambda x: x != ""), good))


def keyword_object(c: Column) -> Column:
    """Keywords of a JSON object, with or without a code fence: high_level and low_level arrays."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.from_json(body, "high_level_keywords array<string>, low_level_keywords array<string>")


#: Where rows of other systems hold what they retrieved, and what names a document.
ID_FIELDS = ("retrieved_document_ids", "retrieved_doc_ids", "document_ids", "doc_ids", "retrieved_docs")
ID_HOLDERS = ("document", "documents", "passage", "passages")
ID_NAMES = ("id", "document_id", "title", "name")
#: Where metadata holds answers.
ANSWER_FIELDS = ("answers", "answer", "answer_text", "gold_answer", "gold_answers")


def _first_of(c: Column, names: tuple[str, ...]) -> Column:
    """The first of several fields of a JSON object that isn't empty."""
    return F.coalesce(*[F.nullif(F.nullif(F.get_json_object(c, f"$.{n}"), F.lit("")), F.lit("[]")) for n in names])


def _listed(c: Column) -> Column:
    """A JSON list as texts; anything else as a list of one."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def retrieved_ids(row: Column) -> Column:
    """Document ids, each once, in order, out of a JSON row: the first of ID_FIELDS that is there, as a
    text, a list of texts or of objects, or an object that holds such a list; without one none."""
    field = F.coalesce(*[F.get_json_object(row, f"$.{n}") for n in ID_FIELDS])
    held = F.when(field.startswith("{"), F.coalesce(_first_of(field, ID_HOLDERS), F.lit("[]"))).otherwise(field)
    ids = F.transform(_listed(held), lambda x: F.when(x.startswith("{"), _first_of(x, ID_NAMES)).otherwise(x))
    return F.coalesce(F.array_distinct(F.array_compact(ids)), F.array().cast("array<string>"))


def metadata_answers(meta: Column) -> Column:
    """Answers, each once, sorted, out of JSON metadata: of all ANSWER_FIELDS, given as a text, a list
    of texts or of objects with ``text`` or ``answer``, or such an object; empty ones go."""
    every = []
    for n in ANSWER_FIELDS:
        v = F.get_json_object(meta, f"$.{n}")
        texts = F.transform(_listed(v), lambda x: F.when(x.startswith("{"), _first_of(x, ("text", "answer"))).otherwise(x))
        every.append(F.when(v.isNotNull(), texts).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(F.concat(*every)), lambda x: x != "")))


def prompt(question: Column, contexts: Column) -> Column:
    """The reader's prompt: numbered contexts ``(title, text)``, then the question. The wording is a
    fixed value."""
    one = lambda c, i: F.regexp_replace(
        F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["title"], F.lit("")), F.lit("\n"), F.coalesce(c["text"], F.lit(""))), r"\s+$", ""
    )
    return F.concat(
        F.lit("Answer the question using only the context below. If the answer is not supported, say that it is not available.\n\nContext:\n"),
        F.array_join(F.transform(contexts, one), "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"),
    )


def csv_section(df: DataFrame, id_col: str, blob: str, column: str = "content") -> DataFrame:
    """``(id, pos, column)``: the non-empty values of a column of the CSV section of a text; quoted
    fields may run over lines. A text without the section gives no row; a section without the column
    is an error."""
    id_type = df.schema[id_col].dataType.simpleString()

    def rows(blob: str | None) -> list[str]:
        body = re.search(r"-----Sources-----\s*```csv\s*(.*?)\s*```", blob or "", re.DOTALL)
        got = list(csv.reader(io.StringIO(body[1].strip(), newline=""))) if body else []
        if not got:
            return []
        names = [x.strip().lower() for x in got[0]]
        if column not in names:
            raise ValueError(f"the section has no column {column}")
        at = names.index(column)
        return [r[at] for r in got[1:] if len(r) > at and r[at]]

    def run(batches):
        csv.field_size_limit(1 << 30)
        for batch in batches:
            ids, pos, out = [], [], []
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = rows(b)
                ids += [i] * len(got)
                pos += range(1, len(got) + 1)
                out += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(pos, pa.int64()), pa.array(out, pa.string())], names=["i", "pos", "v"])

    return df.select(id_col, blob).mapInArrow(run, f"i {id_type}, pos long, v string").toDF(id_col, "pos", column)
