"""Token counts and packings against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from chromaloom.llm import packing, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x1c\x85\xa0''’sdmtrevlTHELaé½3１,.!<|>")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_match_library(text):
    assert tokens.counter(BYTE).count(text) == len(BYTE_LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_match_library(text):
    assert np.frombuffer(packing.word_ids(WORD).text_ids(text), "<u4").tolist() == WORD_LIB.encode(text, add_special_tokens=False).ids


def test_counts_of_table(spark, docs, texts):
    got = tokens.count_tokens(docs, BYTE).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        n = len(BYTE_LIB.encode(t or "", add_special_tokens=False).ids)
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len((t or "").encode()), n, n > 512)


def test_very_long_texts(spark, monkeypatch):
    """A text over LONG_TEXT, one without any space, and one of other than Latin-1 characters; rows without an id."""
    long = ["many words, and more: " * 60_000, "x" * 200_000, "größer 한국 " * 20_000]
    own = tokens.counter(BYTE)
    for t in long[:1] + long[2:]:
        assert own.count(t) == len(BYTE_LIB.encode(t, add_special_tokens=False).ids)
    monkeypatch.setattr(tokens, "LONG_TEXT", 10)
    for t in ["a few words", "größer 한국", "<|endoftext|> in a text that is longer"]:
        assert own.count(t) == len(BYTE_LIB.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame([(None, t) for t in long] + [(None, "same")] * 500, "doc_id long, text string").withColumns({"id": F.lit(1), "length": F.lit("x"), "items": F.lit(2)})
    got = packing.pack_documents(df, WORD).toPandas()
    want = [len(WORD_LIB.encode(t, add_special_tokens=False).ids) + 1 for t in long]
    assert got.length.sum() == sum(want) + 500 * 2 and (got.length == 2).sum() >= 500 and got.groupby("sequence_id").length.sum().max() <= 4096
    assert sorted(got.groupby("piece").size().index) == list(range(-(-max(want) // 4096)))


def test_no_rows(empty):
    assert tokens.count_tokens(empty, BYTE).count() == 0
    assert packing.pack_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(docs, texts, capacity):
    got = packing.pack_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), WORD, capacity).toPandas()
    for i, t in enumerate(texts):
        ids = WORD_LIB.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == i].sort_values("piece")
        parts = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        assert own.length.tolist() == [len(p) for p in parts] and own.start.tolist() == [capacity * k for k in range(len(parts))]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.r_[0, np.cumsum(s.length)[:-1]].tolist() and s.length.sum() <= capacity
    assert got.sequence_id.nunique() <= decreasing(got.length.to_numpy(), capacity)


def test_repeated_rows_are_packed_each(docs):
    got = packing.pack_documents(docs, WORD).toPandas()
    assert (got.doc_id == 0).sum() == 2 and got.doc_id.isna().sum() == 1


def decreasing(lengths, capacity=4096):
    """Bins that best-fit-decreasing alone needs."""
    bins = np.zeros(len(lengths), np.int64)
    return len(packing.best_fit(lengths.tolist(), np.argsort(-lengths, kind="stable").tolist(), bins, [], capacity))


def test_genetic_steps_keep_pieces_and_never_lose_bins():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 2500, 400))[::-1].copy()
    best, crossed = packing.evolve(lengths, [], 4096, 1)
    fill = np.bincount(best, weights=lengths)
    assert fill.max() <= 4096 and fill.min() > 0 and len(fill) <= decreasing(lengths) and crossed >= packing.LEAST_GENERATIONS * packing.POPULATION
    again, _ = packing.evolve(lengths, [best], 4096, 2)
    assert len(np.unique(again)) <= len(fill)


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit_decreasing_on_triplets(seed):
    rng = np.random.default_rng(seed)
    long = rng.integers(1557, 2000, 40)
    middle = (4096 - long) // 2 - rng.integers(1, 200, 40)
    lengths = np.sort(np.concatenate([long, middle, 4096 - long - middle]))[::-1].copy()
    best, _ = packing.evolve(lengths, [], 4096, seed)
    assert 40 <= best.max() + 1 < decreasing(lengths)


def fewest(lengths, capacity):
    """Least number of bins, by trying every way."""
    best = len(lengths)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for r in sorted({r for r in room if r >= lengths[i]}):
            k = room.index(r)
            go(i + 1, [*room[:k], r - lengths[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_reach_the_optimum(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(5, 60, rng.integers(8, 13)))[::-1].copy()
    best, _ = packing.evolve(lengths, [], 100, seed)
    assert best.max() + 1 == fewest(lengths.tolist(), 100)


def test_every_shard_evolves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.checkpoint(packing.token_pieces(docs, WORD))
    history = packing.packing_history(pieces, shard_pieces=128).toPandas()
    assert history.crossovers.min() >= packing.LEAST_GENERATIONS * packing.POPULATION and history.n_pieces.sum() == pieces.count() * packing.ISLANDS * packing.EPOCHS
    worst = history.groupby(["shard", "epoch"]).n_bins.min().unstack()
    assert (worst[1] <= worst[0]).all()  # elites are never lost
    got = packing.pack_pieces(pieces, shard_pieces=128).toPandas()
    lengths = got.length.to_numpy()
    assert len(got) == pieces.count() and got.groupby("sequence_id").length.sum().max() <= 4096
    # shards meet again, so that all of them together are about as good as one
    assert -(-lengths.sum() // 4096) <= got.sequence_id.nunique() <= decreasing(lengths) + 1
    whole = packing.pack_pieces(pieces).toPandas()
    assert whole.sequence_id.nunique() <= decreasing(lengths)


def test_equal_rows_are_spread_over_shards(spark):
    rows = packing.checkpoint(spark.range(0, 6000, 1, 4).select(F.lit(None).cast("long").alias("id"), F.lit(7).cast("long").alias("length")))
    sizes = packing.packing_history(rows, 100, 1000).filter("epoch = 0 and island = 0").toPandas().n_pieces
    assert len(sizes) == 6 and sizes.sum() == 6000 and sizes.max() < 1300
    got = packing.pack_pieces(rows, 100, 1000).toPandas()
    assert len(got) == 6000 and got.sequence_id.nunique() == -(-6000 // 14) and (got.groupby("sequence_id").offset.nunique() == got.groupby("sequence_id").size()).all()


def test_parts_with_one_hash_are_told_apart(monkeypatch):
    from chromaloom.llm import _words

    text = "some words, some more; and others"
    want = packing.TextIds(WORD).text_ids(text)
    monkeypatch.setattr(_words.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert packing.TextIds(WORD).text_ids(text) == want


def test_best_fit_picks_the_tightest():
    bins = np.array([0, 1, -1])
    room = packing.best_fit([50, 70, 30], [2], bins, [50, 30], 100)
    assert bins.tolist() == [0, 1, 1] and room == [50, 0]
