import math
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graftline.llm.bpe import BYTE_BPE_50K, PATTERN, TOKENIZERS, count_table, decode_table, encode_table, encoder, read_ranks
from graftline.llm.mix import Mix, split_tree
from graftline.llm.split import split_table, split_text

BPE = encoder(BYTE_BPE_50K)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(BYTE_BPE_50K), special_tokens={})
TEXTS = [None, "", " ", "\n\n", "a", "don't stop", "Ünïcödé 日本語 текст 😀", "a​b́", "<|endoftext|>", "x" * 5000, "ab" * 3000, " " * 999, "\x00\x07", "12345 67890"]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_equals_merging(text):
    assert BPE.encode(text) == REFERENCE.encode_ordinary(text)


@given(st.text(alphabet="abAB e'st.\n-", max_size=200))
@settings(max_examples=300, deadline=None)
def test_equals_merging_on_few_letters(text):
    assert BPE.encode(text) == REFERENCE.encode_ordinary(text) and BPE.count(text) == len(BPE.encode(text))


def test_other_vocabulary():
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    for t in TEXTS[1:]:
        assert encoder(path).encode(t) == other.encode_ordinary(t)


def test_tables(spark):
    df = spark.createDataFrame([(n, t, "x", 0) for n, t in enumerate(TEXTS)] + [(None, "a", None, None)] * 2, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), list(r.ids)) for r in encode_table(df, "doc_id", "text").collect())
    want = sorted([(n, REFERENCE.encode_ordinary(t or "")) for n, t in enumerate(TEXTS)] + [(-1, REFERENCE.encode_ordinary("a"))] * 2)
    assert got == want
    counts = {r.doc_id: r.n_tokens for r in count_table(df.filter("doc_id is not null"), ["doc_id"], "text").collect()}
    assert counts == {n: len(ids) for n, ids in want if n >= 0}
    assert encode_table(df.limit(0), "doc_id", "text").collect() == []
    back = {r.doc_id: r.text for r in decode_table(encode_table(df, "doc_id", "text"), "doc_id").collect() if r.doc_id is not None}
    assert back == {n: t or "" for n, t in enumerate(TEXTS)}


def test_round_trip_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in encode_table(docs, "doc_id", "text").collect():
        assert REFERENCE.decode(r.ids) == (texts[r.doc_id] or "")


LONG = [
    "word " * 3000,
    "A sentence here. " * 400,
    "\n\n".join(f"# Part {k}\n\n" + "Some words stand here, and more of them!\n" * k for k in range(25)),
    "- item one\n  - sub item\n" * 300,
    "<h1>T</h1><p>one two three</p><ul><li>a</li><li>b</li></ul>" * 120,
    "日本語の文です。とても長い。" * 200,
    "あ" * 2500,
    "x" * 9000,
    "😀é" * 800,
    "a\r\n\r\nb\r\n" * 500,
    "(" * 3000,
]


@pytest.mark.parametrize("limit,overlap", [(512, 32), (64, 8), (40, 0)])
@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_pieces(text, limit, overlap):
    pieces = split_text(text, limit, overlap, BPE)
    assert len(pieces) > 1 and pieces[0][1] == 0 and pieces[-1][2] == len(text) and pieces[-1][4] == "end"
    for _, s, e, n, _ in pieces:
        assert 0 < n == BPE.count(text[s:e]) <= limit
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a[1] < b[1] <= a[2] < b[2]
        if overlap:
            assert b[1] < a[2]
        # rebuilt without the overlap
    assert text == text[: pieces[0][2]] + "".join(text[a[2] : b[2]] for a, b in zip(pieces, pieces[1:], strict=False))


@given(st.text(alphabet="ab B's.\n-日é\t", max_size=400))
@settings(max_examples=200, deadline=None)
def test_pieces_never_exceed_the_limit(text):
    for limit, overlap in ((12, 3), (20, 11)):
        pieces = split_text(text, limit, overlap, BPE)
        assert all(n == BPE.count(text[s:e]) <= limit for _, s, e, n, _ in pieces)
        assert text == "".join(text[(a[2] if a else 0) : b[2]] for a, b in zip([None, *pieces], pieces, strict=False))


@given(st.text(alphabet="ab '\n\t\u00a0\x1c1.é日", max_size=80))
@settings(max_examples=400, deadline=None)
def test_cutting_at_blanks_changes_nothing(text):
    assert BPE.encode(text) == BPE.encode_words(text) == REFERENCE.encode_ordinary(text)


def test_cuts_follow_the_structure():
    text = "\n\n".join("# Part\n\n" + "Some words stand here, and more of them! " * 12 for _ in range(12))
    pieces = split_text(text, 512, 32, BPE)
    assert {p[4] for p in pieces[:-1]} == {"heading"}
    assert all(text[p[2] :].startswith("# Part") for p in pieces[:-1])
    text = "One two three four. " * 300
    assert {p[4] for p in split_text(text, 512, 32, BPE)[:-1]} == {"sentence"}


def test_split_table(spark):
    df = spark.createDataFrame([(n, t, 1) for n, t in enumerate(TEXTS)] + [(50 + n, t, 2) for n, t in enumerate(LONG)], "doc_id long, text string, piece int")
    rows = split_table(df, "doc_id", "text", 128, 16).collect()
    cut = {r.doc_id for r in rows if r.n_pieces > 1}
    assert cut == {n for n, t, _ in df.collect() if t and len(REFERENCE.encode_ordinary(t)) > 128}
    assert {r.doc_id for r in rows} == {n for n, t, _ in df.collect() if t}
    texts = dict(df.select("doc_id", "text").collect())
    assert all(texts[r.doc_id][r.start_char : r.end_char] == r.piece_text for r in rows)
    with pytest.raises(ValueError):
        split_table(df, "doc_id", "text", 16, 16)


def test_split_tree_is_exact():
    rng = np.random.default_rng(0)
    counts = np.array([100, 0, 7, 1234])
    for shards in (1, 2, 7, 64):
        parts = split_tree(counts, shards, rng)
        assert (parts.sum(axis=0) == counts).all() and (parts >= 0).all()
        assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= math.ceil(math.log2(shards) + 1)


MIX = "doc_id long, source string, text string, copy int"


def mixed(spark, **options):
    r = random.Random(8)
    docs = [(n, "big", "word " * r.randint(1, 40), 0) for n in range(1500)] + [(2000 + n, "small", "tiny text", 0) for n in range(20)]
    docs += [(3000 + n, r.choice([None, "other"]), "left out", 0) for n in range(50)] + [(4000, "big", None, 0), (4001, "big", "", 0)]
    targets = [("big", 0.5, 1), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("other", None, 2), ("zero", 0.0, 1)]
    return docs, Mix(spark.createDataFrame(docs, MIX), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), "doc_id", "source", "text", **options)


def test_mix(spark):
    docs, mix = mixed(spark, block_tokens=200, shard_tokens=3000)
    size = {d: BPE.count(t) for d, _, t, _ in docs}
    total = sum(size.values())
    rows = mix.rows.collect()
    assert mix.total == total and all(size[r.doc_id] == r.n_tokens > 0 for r in rows)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    got = {s: sum(r.n_tokens for r in rows if r.source == s) for s in ("big", "small")}
    assert 0.5 * total - 60 <= got["big"] <= 0.5 * total
    have = sum(n for d, n in size.items() if 2000 <= d < 3000)
    assert got["small"] == 3 * have and {r.copy for r in rows if r.source == "small"} == {0, 1, 2}
    shards = {r.shard for r in rows}
    assert len(shards) > 1
    for s in shards:
        assert sorted(r.position for r in rows if r.shard == s) == list(range(1, sum(r.shard == s for r in rows) + 1))
    report = {r.source: r for r in mix.report.collect()}
    assert {s for s, r in report.items() if r.short} == {"small", "absent"}
    assert report["small"].mix_tokens == got["small"] and report["absent"].mix_tokens == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    again = mixed(spark, block_tokens=200, shard_tokens=3000)[1].rows.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_a_fitted_mix_reaches_the_shares(spark):
    _, mix = mixed(spark, block_tokens=20, shard_tokens=200, fit=True)
    report = {r.source: r for r in mix.report.collect()}
    both = report["big"].target_share + report["small"].target_share
    for s in ("big", "small"):
        assert report[s].actual_share == pytest.approx(report[s].target_share / both, abs=0.02)
    assert {s for s, r in report.items() if r.short} == {"absent"}
    assert len(mix.quotas) > 1


def test_mix_without_documents(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(spark.createDataFrame([], MIX), targets, "doc_id", "source", "text")
    assert mix.rows.collect() == [] and mix.report.collect()[0].mix_tokens == 0
    with pytest.raises(ValueError):
        Mix(spark.createDataFrame([], MIX), targets.union(targets), "doc_id", "source", "text")
