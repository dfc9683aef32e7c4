"""What a user plugs in: encoders, language models, retrievers, readers. Each is a plain object or
function that works on batches; the functions here run it over DataFrames.

An encoder has ``dim`` and ``encode(list[str]) -> array (n, dim)``; a language model has
``generate(list[str]) -> list[str]``; a retriever is ``(queries, documents, k) -> DataFrame
(query_id, rnk, doc_id, score)``; a reader's sufficiency is ``(order) -> bool``, see
:func:`evigraph.operators.kernels.best_first`. Objects are pickled to the tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import attach


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


class HashedEncoder:
    """Stand-in for a trained encoder: words are hashed to a place and a sign and summed, at length 1."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self.known: dict[str, tuple[int, int]] = {}

    def place(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            h = hashlib.md5(word.encode()).digest()
            got = h[0] % self.dim, 1 - 2 * (h[1] % 2)
            if len(self.known) < 1_000_000:
                self.known[word] = got
        return got

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall("[a-z0-9]+", text.lower()):
                at, sign = self.place(word)
                row[at] += sign
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(n > 0, n, 1)


class ConstantModel:
    """Mock of a language model: the same answer to everything."""

    def __init__(self, answer: str = "unknown") -> None:
        self.answer = answer

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answer] * len(prompts)


class ExtractiveModel:
    """Mock of a reader: the first words of the prompt's first context."""

    def __init__(self, words: int = 5) -> None:
        self.words = words

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = p.partition("Context:\n")[2].split("\n")
            out.append(" ".join(" ".join(lines[1:2]).split()[: self.words]))
        return out


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """``(id, vec)`` of each row with an id; a null text counts as an empty one. Map-only."""
    attach(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(encoder.encode([t or "" for t in batch.column(1).to_pylist()]), np.float64)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["i", "vec"])

    return df.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"i {id_type}, vec array<double>").toDF(id_col, "vec")


def generate(df: DataFrame, id_col: str, prompt_col: str, model: LanguageModel, batch: int = 64) -> DataFrame:
    """``(id, answer)`` of each row with a prompt, asked for in batches of ``batch``. Map-only."""
    attach(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(1).to_pylist()
            out = [x for at in range(0, len(prompts), batch) for x in model.generate(prompts[at : at + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["i", "answer"])

    return df.where(F.col(prompt_col).isNotNull()).select(id_col, prompt_col).mapInArrow(run, f"i {id_type}, answer string").toDF(id_col, "answer")


RETRIEVERS: dict[str, Retriever] = {}


def retriever(name: str) -> Callable[[Retriever], Retriever]:
    """Registers a retriever under a name."""

    def add(f: Retriever) -> Retriever:
        if name in RETRIEVERS:
            raise ValueError(f"two retrievers are named {name}")
        RETRIEVERS[name] = f
        return f

    return add


def retrieve(name: str, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The ranking of a registered retriever for ``queries (query_id, text)`` over ``documents (doc_id,
    text)``."""
    if name not in RETRIEVERS:
        raise KeyError(f"no retriever {name}; there are {sorted(RETRIEVERS)}")
    return RETRIEVERS[name](queries, documents, k)


@retriever("hashed")
def hashed(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Dense search over the stand-in encoder's vectors."""
    from evigraph.functions.vector import topk

    e = HashedEncoder()
    return topk(encode(queries, "query_id", "text", e), encode(documents, "doc_id", "text", e), k)


@retriever("bm25")
def bm25(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    from evigraph.operators import lexical

    return lexical.bm25(queries, documents, k)
