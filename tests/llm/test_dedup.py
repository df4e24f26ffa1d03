"""Exact, near and substring dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from chromaloom.llm import exact_dedup, fm_index, simhash, substring
from chromaloom.llm._graph import component_roots
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LOW = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- exact ---


@pytest.mark.parametrize("history", [None, "doc_id % 2 = 0", "true", "false"])
def test_exact(docs, texts, history):
    got = exact_dedup.exact_dedup(docs, None if history is None else F.expr(history)).collect()
    rows = [(r.doc_id, (r.text or "").translate(LOW)) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert len(got) == len(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        own = groups[digest[r.text_sha256]]
        most = max((i for i in own if i is not None), default=None)
        assert r.group_size == len(own) and r.keep_id == most and r.kept == (r.doc_id == most)


@pytest.mark.parametrize("ident", ["concat('d', doc_id)", "cast(null as long)", "cast(doc_id as decimal(9,2))"])
def test_half_of_any_ids_is_history(spark, monkeypatch, ident):
    """String, null and decimal ids: both halves hold about half of the rows, and groups are right."""
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), (F.col("id") % 150).cast("string")).alias("text")).withColumn("doc_id", F.expr(ident))
    sizes, whole = [], exact_dedup.groups_of

    def groups(history, new, shards):
        sizes.append((history.count(), new.count()))
        return whole(history, new, shards)

    monkeypatch.setattr(exact_dedup, "groups_of", groups)
    got = exact_dedup.exact_dedup(rows).collect()
    assert min(sizes[0]) > 100 and sum(sizes[0]) == len(got) == 400
    assert {r.text_sha256: r.group_size for r in got} == {hashlib.sha256(f"text {k}".encode()).hexdigest(): 3 if k < 100 else 2 for k in range(150)}
    if "null" not in ident:
        assert sum(r.kept for r in got) == 150 and all(r.kept == (r.keep_id == r.doc_id) for r in got)


def test_exact_drop(docs, empty):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.text or "").translate(LOW)) for r in kept.collect()) == sorted({(r.text or "").translate(LOW) for r in docs.collect()})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


#: Ids on several texts, repeated rows, null ids and null texts.
SHARED_IDS = [(1, "a b c"), (1, "x y z"), (5, "X y z"), (5, "X y z"), (None, "q"), (None, "x y z"), (None, "q"), (7, None), (7, ""), (3, ""), (9, "a b c")]


def test_one_row_of_each_exact_group_stays(spark):
    df = spark.createDataFrame(SHARED_IDS, "doc_id long, text string")
    want = {}
    for i, t in SHARED_IDS:
        low = (t or "").translate(LOW)
        want[low] = max(want.get(low, -1), -1 if i is None else i)
    got = exact_dedup.drop_exact_copies(df).collect()
    assert sorted(((r.text or "").translate(LOW), -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(want.items())


def test_one_row_of_each_near_group_stays(spark):
    df = spark.createDataFrame(SHARED_IDS, "doc_id long, text string")
    root = brute_components({brute_fingerprint(t) for _, t in SHARED_IDS}, 4)
    want = collections.defaultdict(list)
    for i, t in SHARED_IDS:
        want[root[brute_fingerprint(t)]].append((i is None, i or 0))
    got = simhash.drop_near_copies(df).collect()
    assert sorted((root[brute_fingerprint(r.text)], (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted((k, min(v)) for k, v in want.items())


def test_stored_history(spark, docs, empty, tmp_path):
    """A history stored once gives later tables what exact_dedup of both together gives their rows."""
    old, new = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0 or doc_id is null")
    exact_dedup.store_history(old, str(tmp_path / "h"), 4)
    got = sorted(map(str, exact_dedup.dedup_against(new, str(tmp_path / "h")).collect()))
    both = exact_dedup.exact_dedup(old.union(new)).filter("doc_id % 3 <> 0 or doc_id is null").collect()
    assert got == sorted(map(str, both))
    exact_dedup.store_history(empty, str(tmp_path / "none"), 4)
    assert sorted(map(str, exact_dedup.dedup_against(docs, str(tmp_path / "none")).collect())) == sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    assert exact_dedup.dedup_against(empty, str(tmp_path / "h")).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    own = exact_dedup.PerfectHash(keys)
    assert sorted(own.slots(keys).tolist()) == list(range(5000))
    assert exact_dedup.PerfectHash(keys[:0]).slots(keys).tolist() == [-1] * 5000
    assert exact_dedup.PerfectHash.unpacked(own.packed()).slots(keys).tolist() == own.slots(keys).tolist()


# --- near ---


def brute_fingerprint(text, n=4):
    w = words_of((text or "").translate(LOW))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= radius:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(errors="surrogatepass").decode(errors="replace").encode()) == brute_fingerprint(text.encode(errors="surrogatepass").decode(errors="replace"))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_pair(radius):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(radius)]
    rng = random.Random(radius)
    for _ in range(3000):
        apart = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(apart & m == 0 for m in masks)
    assert all(any(m >> i & 1 for m in masks) for i in range(64))


@pytest.mark.parametrize("big", [simhash.BIG, 3])
def test_links_connect_as_pairs_do(spark, monkeypatch, big):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:25]:  # chains of near ones
        for _ in range(rng.randrange(1, 5)):
            v ^= sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 7)))
            values.add(v)
    if big != simhash.BIG:
        own = np.array(sorted(values), np.uint64)
        a, b = simhash._near_big(own, 4)
        links = [(int(x) & (2**64 - 1), int(y) & (2**64 - 1)) for x, y in zip(a, b, strict=True)]
        assert {frozenset(g) for g in groups_by_links(values, links)} == {frozenset(g) for g in groups_by_root(brute_components(values, 4))}
        return
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in component_roots(simhash.near_links(df, 4)).collect()}
    got = {v: roots.get(v, v) for v in values}
    assert {frozenset(g) for g in groups_by_root(got)} == {frozenset(g) for g in groups_by_root(brute_components(values, 4))}


def groups_by_root(root):
    out = collections.defaultdict(set)
    for v, r in root.items():
        out[r].add(v)
    return out.values()


def groups_by_links(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return groups_by_root({v: find(v) for v in values})


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and got[201] == 200


def test_simhash_groups(docs, empty, texts):
    got = simhash.simhash_groups(docs).collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    root = brute_components({f for _, f in rows}, 4)
    least = collections.defaultdict(list)
    for i, f in rows:
        least[root[f]].append(i)
    assert len(got) == len(rows)
    want = sorted((str(i), f"{f:016x}", str(min((j for j in least[root[f]] if j is not None), default=None))) for i, f in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and simhash.drop_near_copies(empty).count() == 0
    assert sorted(root[brute_fingerprint(r.text)] for r in kept.collect()) == sorted({root[f] for _, f in rows})


# --- substrings ---


def brute_cover(texts, window):
    where = collections.Counter()
    lists = [words_of(t) for t in texts]
    for w in lists:
        where.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if where[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(2, 7))
def test_fm_index_counts(ids, length):
    text = np.array([*ids, 0], np.int64)
    index = fm_index.FmIndex(text, length)
    ends = np.arange(length, len(ids) + 1)
    if not len(ends):
        return
    fail = index.matched(ends, length)
    for e, f in zip(ends.tolist(), fail.tolist(), strict=True):
        def times(a, b):
            return sum(ids[k : k + b - a] == ids[a:b] for k in range(len(ids) - (b - a) + 1))

        assert (f < 0) == (times(e - length, e) >= 2)
        if f >= 0:
            assert times(f, e) < 2 and (f + 1 == e or times(f + 1, e) >= 2)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), min_size=1, max_size=40), min_size=1, max_size=4), st.integers(2, 6))
def test_cover_finds_all_repeats(parts, window):
    text = np.array([x for p in parts for x in [*p, 0]], np.int64)
    start = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    windows = np.maximum(np.array([len(p) for p in parts]) - window + 1, 0)
    part, low, high = fm_index.repeated_cover(fm_index.FmIndex(text, window), start, windows, window)
    count = collections.Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
    for k, p in enumerate(parts):
        got, want = set(), set()
        for a, b in zip(low[part == k].tolist(), high[part == k].tolist(), strict=True):
            got |= set(range(a, b))
        for i in range(len(p) - window + 1):
            if count[tuple(p[i : i + window])] > 1:
                want |= set(range(i, i + window))
        assert got == want


@pytest.mark.parametrize("hot", [substring.HOT, 2])
def test_substring(spark, docs, texts, hot):
    rng = random.Random(3)
    shared = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(n)) for n in (12, 20, 33)]
    rows = [r.text for r in docs.collect()]
    for k in range(24):
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        rows.append("\t".join([own[0], shared[k % 3], own[1], rng.choice(shared + [""]), own[2]]))
    rows += [shared[0] + " tail", "  " + shared[0].replace(" ", "  ") + " tail"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df, 10, 3, hot).collect()}
    assert got == dict(enumerate(brute_cover(rows, 10)))
    assert substring.substring_dedup(df.limit(0), 10, 3).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chromaloom_")]


def test_substring_with_a_passage_far_above_the_threshold(spark):
    """One passage in most texts, cut in several ways and spaced differently, between words of each text's own, and
    texts of one word over and over."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for k in range(300):
        low, high = (0, 40) if k % 3 else (rng.randrange(0, 12), rng.randrange(25, 41))
        own = [[rng.choice("xyz") + str(rng.randrange(4 if k % 5 == 0 else 10**6)) for _ in range(rng.randrange(0, 25))] for _ in range(2)]
        rows.append((" " if k % 2 else "  ").join([*own[0], *passage[low:high], *own[1]]))
    rows += [" ".join(["same"] * n) for n in range(5, 60, 3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = dict(enumerate(brute_cover(rows, 10)))
    for hot in (5, 60):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df, 10, 3, hot).collect()}
        assert got == want


def test_run_lengths():
    assert substring.run_lengths(35, 8) == [8, 15, 22, 29, 35] and substring.run_lengths(10, 3) == [3, 5, 7, 9, 10]


def common_texts(rng, n):
    """Texts that share passages, fillers of one, two and three words, at many lengths and places; some alone."""
    passage = [f"p{i}" for i in range(60)]
    out = []
    for k in range(n):
        own = [f"o{k}x{i}" for i in range(rng.randrange(12))]
        cut = sorted(rng.sample(range(61), 2))
        kind = k % 4
        filler = [["pad"], ["ab", "ac"], ["x", "y", "z"]][k % 3] * 60
        part = passage[cut[0] : cut[1]] if kind == 0 else filler[: rng.randrange(8, 70)] if kind < 3 else passage[cut[0] :] + filler[: rng.randrange(40)]
        out.append(" ".join([*own, *part, *own[:3], *(part if k % 17 == 0 else [])]))
    return out


@pytest.mark.parametrize("hot", [1, 3, 12])
def test_common_passages_and_fillers(spark, hot):
    rng = random.Random(hot)
    rows = list(enumerate(common_texts(rng, 160)))
    rows += [(1000, rows[0][1]), (1001, "once " * 30), (1002, "solo " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df, 10, 3, hot).collect()}
    assert got == dict(zip((i for i, _ in rows), brute_cover([t for _, t in rows], 10), strict=True))


def test_pieces_hold_each_window_once(spark):
    rng = random.Random(5)
    texts = [" ".join(t.split()) for t in common_texts(rng, 80)]
    df = spark.createDataFrame([(i, 100, True, bytearray(t.encode())) for i, t in enumerate(texts)], "tid long, at long, ask boolean, text binary")
    rows = df.mapInArrow(substring._pieces(10, 3), "tid long, at long, ask boolean, text binary, digest binary").collect()
    held = collections.Counter()
    for r in rows:
        w = bytes(r.text).decode().split()
        own = texts[r.tid].split()
        assert 10 <= len(w) < 20 and own[r["at"] - 100 :][: len(w)] == w
        held.update((r.tid, r["at"] - 100 + k) for k in range(len(w) - 9))
    assert held == collections.Counter((i, k) for i, t in enumerate(texts) for k in range(len(t.split()) - 9))


def test_fillers_of_many_lengths_are_few_pieces(spark, monkeypatch):
    """Five thousand texts of one filler, each of another length, far above the threshold: few rows in any shard."""
    rows = [(k, "pad " * (36 + k % 400) + f"end{k}") for k in range(5000)]
    seen, whole = [], substring._judged

    def judged(sharded, window):
        seen.append(sharded.groupBy("shard").count().collect())
        return whole(sharded, window)

    monkeypatch.setattr(substring, "_judged", judged)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(texts, hot=64).collect()}
    assert got == {k: (37 + k % 400, 36 + k % 400) for k, _ in rows}
    assert len(seen) == 2 and max((r["count"] for part in seen for r in part), default=0) < 50
