"""Problem 8: visually identical text with different characters.

Compatibility forms that look the same are normalised, characters that don't show are deleted.
What is left is read as a lattice: every letter that has twins in other scripts, letters of the very
same look, may stand for any of them. Viterbi search over each token picks the letters that agree
best with the scripts and letter pairs of the corpus. Where even the best of these paths mixes
scripts, the lattice gets the letters that are merely confusable, by the public confusables data of
Unicode that Spark's own ICU library holds, each at a cost: a stray letter in a word of another
script is then read as what it passes for if the scores say so, whereas words of one script are never
touched. The lattice depends on the twins alone, not on which was written, so texts that look the
same get the same form.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.tokens import spread
from evigraph.session import attach, cut

#: Letters that look the same, a class a line: Latin, Cyrillic, Greek, Armenian and others.
LOOK_ALIKES = """
A А Α Ꭺ
B В Β Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Е Ε Ꭼ
F Ϝ
G Ԍ Ꮐ
H Н Η Ꮋ
I І Ι Ӏ Ꮖ
J Ј Ϳ Ꭻ
K К Κ Ꮶ
L Ꮮ
M М Μ Ϻ Ꮇ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
Q Ԛ
R Ꭱ Ꮢ
S Ѕ Տ Ꮪ
T Т Τ Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Х Χ
Y Ү Υ
Z Ζ Ꮓ
a а ɑ
c с ϲ
d ԁ ժ
e е
g ɡ ց
h һ հ
i і
j ј ϳ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ գ
s ѕ
u ս
v ѵ ν
w ԝ
x х
y у
Æ Ӕ
æ ӕ
Ə Ә
ə ә
Ɛ Ԑ
ɛ ԑ
Г Γ
П Π
Ф Φ
"""
#: Signs that look the same.
SAME_SIGNS = {"\u2010": "-", "\u2011": "-", "\ufe63": "-", "\u2024": ".", "\u02bc": "\u2019"}
#: Compatibility classes whose members look as what they stand for.
SAME_FORMS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Compatibility characters of other classes that look as what they stand for:
#: ligatures, digraphs, Roman numerals, leader dots.
SAME_RANGES = ((0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2024, 0x2026), (0xFB20, 0xFB4F))
#: Characters beside those of category Cf that don't show.
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

SWITCH = 9.0  # what a change of script inside a token costs
WEAK = 4.0  # what a confusable letter costs
#: Scripts whose letters are confusable with those of others; cased, but for Lisu.
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
MODEL_LIMIT = 250_000  # letter pairs of the model; its alphabet bounds them far below this


@functools.lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Every letter of a class, as its members in the order of the table."""
    rows = [line.split() for line in LOOK_ALIKES.strip().splitlines()]
    return {c: "".join(row) for row in rows for c in row}


@functools.lru_cache(maxsize=65_536)
def script(c: str) -> str:
    """Script of a letter by its name; Latin small alpha and script g count as strays, so that a
    word isn't spelt with them."""
    if c in "ɑɡ":
        return "STRAY"
    return unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else ""


@functools.lru_cache(maxsize=65_536)
def shown(c: str) -> str:
    """What one character shows: its compatibility form where that looks the same, nothing if it
    doesn't show, a blank for any space, one kind of line end."""
    if c in "\n\t":
        return c
    if c in "\r\x0b\x0c\x85\u2028\u2029":
        return "\n"
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind in ("Cf", "Cc") or ord(c) in UNSEEN:
        return ""
    if c in SAME_SIGNS:
        return SAME_SIGNS[c]
    if unicodedata.decomposition(c).startswith(SAME_FORMS) or any(a <= ord(c) <= b for a, b in SAME_RANGES):
        return unicodedata.normalize("NFKC", c)
    return c


_JOINED = regex.compile(r"(?<=\p{Extended_Pictographic}[\ufe0f\p{Emoji_Modifier}]?)\u200d(?=\p{Extended_Pictographic})")
_HELD = "\ue000"  # stands for a joiner that stays
_TOKENS = regex.compile(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+")
_PLAIN = re.compile(r"[\n\t\x20-\x7e]*").fullmatch
_WORDS = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no digits
_MARK = regex.compile(r"\p{M}").search
_TRAILING = re.compile(r"[ \t]+(?=\n|\Z)")


class _Shown(dict):
    def __missing__(self, code: int) -> str:
        self[code] = got = shown(chr(code))
        return got


_TABLE = _Shown()


def normal(text: str) -> str:
    """Compatibility normalisation and deletion of what doesn't show, blanks at the ends of lines
    among it. A joiner between two pictographs makes one picture of them and stays."""
    if not _PLAIN(text):
        if "\r\n" in text:
            text = text.replace("\r\n", "\n")
        if "\u200d" in text:
            text = _JOINED.sub(_HELD, text)
        text = unicodedata.normalize("NFC", text.translate(_TABLE)).replace(_HELD, "\u200d")
    return _TRAILING.sub("", text).strip("\n")


def confusables(spark) -> dict[str, str]:
    """Letters that pass for letters of other scripts: each with the others of one skeleton in the
    public confusables data and of one case. Letters with a decomposition are left out, for marks
    and compatibility forms are dealt with before."""
    letters = []
    for code in range(0x41, 0xFFFF):
        c = chr(code)
        if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and script(c) in SCRIPTS:
            if unicodedata.category(c) != "Lo" or script(c) == "LISU":
                letters.append(c)
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shapes = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(shapes) != len(letters):
        raise RuntimeError("the skeleton of a letter breaks the line")
    by: dict[tuple[str, bool], list[str]] = {}
    for c, shape in zip(letters, shapes):
        by.setdefault((shape, unicodedata.category(c) == "Ll"), []).append(c)
    return {c: "".join(x for x in own if script(x) != script(c)) for own in by.values() for c in own if len({script(x) for x in own}) > 1}


def words_in(text: str) -> set[str] | None:
    """The letter tokens of a normalised text, each once, or None where only the full pattern tells
    them: with marks or numerals among them."""
    if not text.isascii() and _MARK(text):
        return None
    words = set(_WORDS.findall(text))
    return words if text.isascii() or all(map(str.isalpha, words)) else None


def symbol(c: str) -> str:
    """A letter of the model: members of classes are themselves, other letters their script."""
    return c if c in classes() else f"<{script(c)}>"


def letters(token: str) -> list[tuple[str, str]]:
    """Base letter and marks of each letter of a token, composed letters taken apart, so that a
    letter with an accent has the look-alikes of the bare one."""
    out: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFD", token):
        if unicodedata.combining(c) and out:
            out[-1] = (out[-1][0], out[-1][1] + c)
        else:
            out.append((c, ""))
    return out


def tally(tokens: Counter, counts: Counter) -> None:
    """Count letter pairs of tokens of one script each; others say nothing about a script."""
    for token, n in tokens.items():
        bases = [c for c, _ in letters(token)]
        if bases[0].isalpha() and len({script(c) for c in bases}) == 1:
            marks = ["^", *map(symbol, bases), "$"]
            for pair in zip(marks, marks[1:]):
                counts[pair] += n


class Reader:
    """Viterbi search with a model of letter pairs."""

    def __init__(self, pairs: dict[tuple[str, str], int], weak: dict[str, str] | None = None) -> None:
        self.pairs, self.weak = pairs, weak or {}
        self.total = Counter()
        for (a, _), n in pairs.items():
            self.total[a] += n
        self.cache: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        n = self.pairs.get((a, b), 0)
        return math.log((n + 0.01) / (self.total.get(a, 0) + 5.0))

    def options(self, base: str, weak: bool) -> list[tuple[str, float]]:
        """What a letter may stand for, with its cost: its twins, and if asked for what they pass for."""
        twins = classes().get(base, base)
        out = [(c, SWITCH * (script(c) == "STRAY")) for c in twins]
        if weak:
            more = dict.fromkeys(x for c in twins for x in self.weak.get(c, "") if x not in twins)
            out += [(c, WEAK) for c in more]
        return out

    def search(self, chars: list[tuple[str, str]], weak: bool) -> tuple[str, set[str]]:
        """The best path and its scripts; ties go to the earlier option."""
        best: list[tuple[float, str, str, frozenset]] = [(0.0, "", "^", frozenset())]  # score, spelling, last letter, scripts
        for base, marks in chars:
            step = []
            for c, cost in self.options(base, weak):
                own, name = script(c), symbol(c)
                score, spelt, seen = max(
                    (
                        (s + self.score(symbol(last) if last != "^" else "^", name) - SWITCH * (last != "^" and script(last) != own) - cost, w, x)
                        for s, w, last, x in best
                    ),
                    key=lambda x: x[0],
                )
                step.append((score, spelt + c + marks, c, seen | {own}))
            best = step
        top = max(best, key=lambda x: x[0] + self.score(symbol(x[2]), "$"))
        return top[1], set(top[3])

    def token(self, token: str) -> str:
        """The best spelling of a token, the same for all spellings with the same twins."""
        table = classes()
        chars = [(table.get(c, c)[0], m) for c, m in letters(token)]
        found = {script(c) for c, _ in chars}
        if len(found) == 1 and not any(c in table for c, _ in chars):
            return token
        spelt, scripts = self.search(chars, False)
        if len(scripts) > 1:
            spelt, _ = self.search(chars, True)
        return unicodedata.normalize("NFC", spelt)

    def form(self, token: str) -> str:
        got = self.cache.get(token)
        if got is None:
            got = self.token(token) if token[0].isalpha() else token
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def text(self, text: str) -> str:
        """One consistent form of a text."""
        text = normal(text)
        words = words_in(text)
        if words is not None:
            other = {w: f for w in words if (f := self.form(w)) != w}
            return _WORDS.sub(lambda m: other.get(m[0], m[0]), text) if other else text
        return "".join(map(self.form, _TOKENS.findall(text)))


def model(df: DataFrame, text_col: str = "text") -> dict[tuple[str, str], int]:
    """Letter pairs of all texts. Counted in the tasks, then summed; the alphabet (members of
    classes and one symbol per script) bounds the table, whatever the corpus."""
    attach(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        tokens: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    text = normal(text)
                    plain = words_in(text) is not None
                    tokens.update(_WORDS.findall(text) if plain else (t for t in _TOKENS.findall(text) if t[0].isalpha()))
            if len(tokens) > 100_000:
                tally(tokens, counts)
                tokens.clear()
        tally(tokens, counts)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([counts[x] for x in keys], pa.int64())],
            names=["a", "b", "n"],
        )

    rows = df.select(F.col(text_col)).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    got = rows.limit(MODEL_LIMIT + 1).collect()
    if len(got) > MODEL_LIMIT:
        raise ValueError("the model's alphabet is larger than it can be")
    return {(r["a"], r["b"]): r["n"] for r in got}


def _mapped(df: DataFrame, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    spark = attach(df.sparkSession)
    src = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id")
    held = spark.sparkContext.broadcast(Reader(model(src, "_text"), confusables(spark)))
    id_type = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch, held.value)

    return src.mapInArrow(run, f"_id {id_type}, {schema}").withColumnRenamed("_id", id_col)


def canonical(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, form)``: each text in one consistent form.

    Null stays null, a text with nothing visible becomes empty. Every space becomes a plain blank,
    every line end the same; blanks before a line end don't show and go. Repeated rows come out repeated; further columns are left out.
    """

    def make(batch: pa.RecordBatch, reader: Reader) -> pa.RecordBatch:
        forms = [None if t is None else reader.text(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["_id", "form"])

    return _mapped(df, id_col, text_col, "form string", make)


def hashed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, look, raw)``: 128-bit hashes of the consistent form and of the characters; texts that
    are null or show nothing are left out."""

    def make(batch: pa.RecordBatch, reader: Reader) -> pa.RecordBatch:
        ids, look, raw = [], [], []
        for i, t in zip(batch.column(0), batch.column(1).to_pylist()):
            form = reader.text(t) if t and i.is_valid else ""
            if form.strip():
                ids.append(i)
                look.append(hashlib.md5(form.encode("utf-8", "surrogatepass")).digest())
                raw.append(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
        return pa.RecordBatch.from_arrays(
            [pa.array([i.as_py() for i in ids], batch.column(0).type), pa.array(look, pa.binary()), pa.array(raw, pa.binary())],
            names=["_id", "look", "raw"],
        )

    return _mapped(df, id_col, text_col, "look binary, raw binary", make)


EXPAND = 4_096  # pairs of rows of one look that found() writes out; larger groups as a star


def classes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, twins)`` of every row with a visible text, at every size of group: the
    smallest id of the rows that look the same, and the number of those whose characters differ."""
    rows = cut(hashed(df, id_col, text_col).withColumnRenamed(id_col, "id").dropDuplicates(["id"]))
    spellings = rows.groupBy("look", "raw").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    looks = spellings.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("m"))
    per = spellings.join(looks, "look").select("look", "raw", "class_id", (F.col("m") - F.col("n")).alias("twins"))
    return rows.join(per, ["look", "raw"]).select(F.col("id").alias(id_col), "class_id", "twins")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(id_a, id_b)``, the smaller first: rows whose texts look the same but aren't the same
    characters. A group of more than EXPAND such pairs becomes a star: its rows are paired with the
    smallest id of another spelling, of the first spelling where that isn't their own; ``whole``
    writes out all pairs. :func:`classes_of` is the whole result in a form bounded by the input."""
    rows = cut(hashed(df, id_col, text_col).withColumnRenamed(id_col, "id").dropDuplicates(["id"]))
    spellings = rows.groupBy("look", "raw").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    looks = spellings.groupBy("look").agg(
        F.count(F.lit(1)).alias("k"), ((F.sum("n") * F.sum(n) - F.sum(n * n)) / 2).alias("pairs"), F.min(F.struct("first", "raw")).alias("top"),
    ).where("k > 1")
    large = F.lit(False) if whole else F.col("pairs") > EXPAND
    mixed = rows.join(looks.select("look", "top", large.alias("star")), "look")
    plain = mixed.where("not star").select("look", "raw", "id")
    a, b = plain.toDF("look", "ra", "ida"), plain.toDF("look", "rb", "idb")
    full = a.join(b, "look").where("ra <> rb and ida < idb").select("ida", "idb")
    next_best = (
        spellings.join(looks.where(large).select("look", "top"), "look").where(F.col("raw") != F.col("top.raw"))
        .groupBy("look").agg(F.min("first").alias("second"))
    )
    star = mixed.where("star").join(next_best, "look").select(
        F.col("id").alias("ida"), F.when(F.col("raw") == F.col("top.raw"), F.col("second")).otherwise(F.col("top.first")).alias("idb")
    )
    star = star.select(F.least("ida", "idb").alias("ida"), F.greatest("ida", "idb").alias("idb")).distinct()
    return full.unionByName(star).toDF(f"{id_col}_a", f"{id_col}_b")
