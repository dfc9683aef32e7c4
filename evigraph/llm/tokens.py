"""Problem 6: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.bpe import ByteBPE
from evigraph.session import attach

#: Folder with the vocabulary files; override with the environment variable or the parameter.
FOLDER = os.environ.get("EVIGRAPH_TOKENIZERS", "/opt/tokenizers")

#: File of each public tokenizer, as README.md of the folder names them.
FILES = {
    "byte_bpe_50k": "byte_bpe_50k.json",
    "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken",
    "word_bpe_49k": "word_bpe_49k.json",
    "piece_bpe_32k": "piece_bpe_32k.model",
}
MAX_VOCABULARY_BYTES = 64 << 20  # what is broadcast is the vocabulary file alone


def vocabulary(spark: SparkSession, name: str, folder: str | None = None):
    """Broadcast of a vocabulary file's bytes, read once on the driver, checked for size."""
    path = os.path.join(folder or FOLDER, FILES[name])
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than a vocabulary may have")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(zlib.compress(f.read(), 1))


@functools.lru_cache(maxsize=4)
def _encoder(name: str, key: int, held: "_Held") -> Callable[[str | None], list[int]]:
    data = zlib.decompress(held.data)
    if name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        return ByteBPE(data).encode
    if name == "word_bpe_49k":
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data.decode())
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids if text else []
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda text: p.encode(text) if text else []


class _Held:
    """Bytes that hash as equal, so that a worker builds an encoder once and keeps it."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held)


def encoder(name: str, data: bytes) -> Callable[[str | None], list[int]]:
    """The encode function of a tokenizer, built once per worker process."""
    return _encoder(name, zlib.crc32(data), _Held(data))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan of few partitions before a stage that is heavy on the CPU.

    A scan that already fills the cores is left as it is, so large inputs aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str | None = None,
) -> DataFrame:
    """``(id, ids ARRAY<INT>)`` of each row, without special tokens.

    Null and empty texts get an empty list; blank texts get the tokens of their blanks; strings
    that resemble special tokens are ordinary text; repeated rows come out repeated; a null id
    stays null; further columns are left out, whatever their names; an empty table gives an empty
    table. Byte-level vocabularies are encoded by the rank queue of :mod:`evigraph.llm.bpe`, the
    others by their own library. Map-only: texts aren't shuffled unless the scan has fewer
    partitions than the cluster has cores.
    """
    spark = attach(df.sparkSession)
    held = vocabulary(spark, tokenizer, folder)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, held.value)
        for batch in batches:
            texts, ends, flat = batch.column(1), [0], []
            for text in texts.to_pylist():
                flat += enc(text)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(np.asarray(ends, np.int32), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_id", "ids"])

    out = spread(src, "_id").mapInArrow(run, f"_id {id_type}, ids array<int>")
    return out.select(F.col("_id").alias(id_col), "ids")
