import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import tokens
from evigraph.llm.bpe import PATTERN, ByteBPE, RankQueue

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no vocabularies here")


def load(name):
    with open(os.path.join(tokens.FOLDER, name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    data = load("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return ByteBPE(load("byte_bpe_50k.json")), tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_as_the_public_library_does(pair, text):
    text = text.encode("utf-8", "ignore").decode()
    assert pair[0].encode(text) == pair[1].encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000 + "é" * 500, "<|endoftext|>", " \t\r\n ", "東橋" * 3_000, "x" + "​" * 4_000])
def test_long_and_odd_texts(pair, text):
    assert pair[0].encode(text) == pair[1].encode_ordinary(text)


def test_both_files_of_one_vocabulary_agree(pair):
    other = ByteBPE(load("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("abcdeé ,.12\n东") for _ in range(60))
        assert other.encode(s) == pair[0].encode(s)


def test_rank_queue_is_a_priority_queue():
    rng, q = random.Random(5), RankQueue(300_000)
    pushed = sorted((rng.randrange(300_000), i) for i in range(2_000))
    for r, i in random.Random(1).sample(pushed, len(pushed)):
        q.push(r, i)
    out = []
    while (r := q.first()) >= 0:
        out += [(r, i) for i in sorted(q.take(r))]
    assert out == pushed and q.first() == -1


def test_nulls_blanks_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "hi", "x"), (4, "hi", "x"), (None, "hi", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in tokens.encode(df).collect()), key=str)
    by = dict(got)
    assert by[1] == by[2] == () and len(by[3]) > 0 and got.count((4, by[4])) == 2 and by[None] == by[4]
    assert tokens.encode(df.limit(0)).count() == 0 and tokens.encode(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


@pytest.mark.parametrize("name", sorted(tokens.FILES))
def test_every_public_tokenizer(spark, name):
    df = spark.createDataFrame([(1, "One small text."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, tokenizer=name).collect()}
    assert len(got[1]) >= 3 and got[2] == []
