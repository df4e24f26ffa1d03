"""Host rules, periodic runs and collocations against brute force."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from chromaloom.llm import _transducer, collocations, host_rules, periodic
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


# --- host rules ---


def brute_counts(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


LINES = ["", "a b", "a b\n\na b\na b ", "\n\n x\n x\nx", "# * $ % & | < >", "größe\x0bé\x85z\n" * 3, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + "end", "q " * 8, "q " * 9, "long" * 200 + "\n" + "long" * 200, "a b c d e f g h i\na b c d e f g h j\n"]


def test_counts_of_texts(texts):
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("ab# \n\r\té"), int(n))) for n in rng.integers(0, 300, 60)]
    every = [*texts, *LINES, *made]
    got = host_rules.text_counts(pa.array(every))
    assert [tuple(r) for r in got.tolist()] == [brute_counts(t) for t in every]
    assert host_rules.text_counts(pa.array([], pa.string())).shape == (0, 5)


def test_prior_pulls_small_hosts_and_fails_bad_ones(spark):
    """By hand: most hosts fail a tenth; one large host fails in most, one small host in its only document."""
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(f"h{h}", bad if d < 2 else good) for h in range(30) for d in range(20)]
    rows += [("bad", bad if d < 190 else good) for d in range(200)] + [("small", bad)] + [("small", None)]
    docs = spark.createDataFrame([(i, t, h, 1.0) for i, (h, t) in enumerate(rows)], "doc_id long, text string, host string, docs double")
    got = host_rules.host_rules(docs, F.col("host")).join(docs.select("doc_id", "host"), "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20) and r.kept == (r.n_words >= 20 and r.host != "bad")
    counted = host_rules.measured(docs, F.col("host"))
    rates = {r.host: r for r in host_rules.host_verdicts(counted).collect()}
    n, f = np.array([20] * 30 + [200, 2]), np.array([2] * 30 + [190, 2])
    m = f.sum() / n.sum()
    rho = ((n * (f / n - m) ** 2).sum() / (m * (1 - m)) - 31) / (n.sum() - (n**2).sum() / n.sum() - 31)
    strength = 1 / min(max(rho, 1 / 10_001), 1 / 3) - 1
    assert rates["=small"].rate_short == pytest.approx((2 + m * strength) / (2 + strength), abs=2e-9)
    assert rates["=bad"].rate_short > 0.5 and rates["=small"].host_kept == (rates["=small"].rate_short < 0.5)


@pytest.mark.parametrize("most", [host_rules.MOST_BROADCAST, 0])
def test_host_rules_edges(spark, docs, empty, monkeypatch, most):
    """Nulls, repeated rows, clashing columns, no rows; one host, which has the overall rate; both ways to join."""
    monkeypatch.setattr(host_rules, "MOST_BROADCAST", most)
    got = host_rules.host_rules(docs.withColumn("host", F.lit(1)).withColumn("kept", F.lit("x"))).collect()
    base = {r.doc_id: r.base_failed for r in got}
    assert len(got) == docs.count() and None in base and base[3] and base[2]
    one = host_rules.host_rules(docs, F.lit(None)).collect()
    assert sorted(map(str, (r[:7] for r in one))) == sorted(map(str, (r[:7] for r in got)))
    assert not any(r.kept for r in one)  # most of these texts are short, and they are one host
    assert host_rules.host_rules(empty).count() == 0


# --- periodic runs ---


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            y = x
            while y + q < n and w[y] == w[y + q]:
                y += 1
            part = w[x : y + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((x, len(part), q))
            x = y
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    w = words_of(text)
    if plant:
        import zlib

        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return found, " ".join(x for i, x in enumerate(w) if i not in gone), (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2])


def periodic_texts():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(120):
        w = []
        for _ in range(int(rng.integers(0, 6))):
            part = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 12))).tolist()
            w += (part * 40)[: int(rng.integers(1, 80))]
        out.append(" ".join(f"w{x}" for x in w))
    return out


def test_runs_of_arrays():
    for text in periodic_texts():
        w = words_of(text)
        ids = np.array([int(x[1:]) for x in w], np.int64)
        got = periodic.runs(ids, np.zeros(len(ids), np.int64), np.array([0, len(ids)]))
        assert [tuple(r[1:]) for r in got.tolist()] == brute_runs(w)


def test_long_periods():
    """Periods at, below and above powers of two, whole and cut, with other words around them."""
    for q in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 63, 64, 65, 300):
        for n in (4 * q - 1, 4 * q, 4 * q + 1, 6 * q + q // 2):
            w = [-1, *(list(range(q)) * 7)[:n], -2]
            ids = np.array(w, np.int64) + 2
            got = periodic.runs(ids, np.zeros(len(ids), np.int64), np.array([0, len(ids)]))
            assert [tuple(r[1:]) for r in got.tolist()] == brute_runs(w)


def test_periodic_runs(spark, docs, empty, texts):
    rows = [(i, t) for i, t in enumerate([*texts[:12], *periodic_texts()])] + [(None, "a b " * 9), (5, "a b " * 9), (5, "a b " * 9)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, runs string")
    want = collections.Counter()
    for i, t in rows:
        found, text, summary = brute_row(i, t, False)
        want[(i, *summary, tuple(found), text)] += 1
    got = collections.Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(table).collect())
    assert got == want
    want = collections.Counter()
    for i, t in rows:
        found, text, summary = brute_row(i, t, True)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[(i, *summary, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, periodic.run_digests(table).collect())) == want
    assert periodic.periodic_runs(empty).count() == periodic.run_digests(empty).count() == 0
    assert periodic.run_digests(docs).count() == docs.count()


def test_words_with_one_hash(monkeypatch):
    """Runs and counts stay exact where all words have the same hash."""
    from chromaloom.llm._words import Words

    monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert host_rules.text_counts(pa.array(LINES)).tolist() == [list(brute_counts(t)) for t in LINES]


# --- collocations ---


def brute_phrases(rows, least, share, top):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = collections.Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    most[part] = max(most[part], a)
        own = []
        for p, a in found.items():
            if len(p) == 2 and 100 * most[p] >= share * a:
                continue
            s, _, le, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            own.append((" ".join(p), a, le, r, n[lang], s))
        own.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(own[:top])]
    return sorted(out)


def phrase_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "New", "york", "é", "the\x85x", "a" * 300, "q"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = [(lang, "".join(w + g for w, g in zip(rng.choice(words, int(k)), rng.choice(gaps, int(k)), strict=True))) for lang, k in zip(rng.choice(["en", "de", None, "und", ""], n), rng.integers(0, 60, n), strict=True)]
    return rows + [("en", "hot pair " * 500), ("en", None), ("xx", "one two three"), ("xx", "")]


@pytest.mark.parametrize(("least", "share", "top", "ranges"), [(10, 50, 2000, 4), (1, 60, 7, 1), (3, 100, 2000, 23)])
def test_collocations(spark, monkeypatch, least, share, top, ranges):
    """Several shards a task, few and many ranges, ties in the order, a language called like the null one."""
    monkeypatch.setattr("chromaloom.llm._words.SLICE", 3000)
    rows = phrase_rows(150, least)
    docs = spark.createDataFrame([(t, la, 1, "x") for la, t in rows], "text string, lang string, rank int, phrase string").repartition(5)
    got = collocations.collocations(docs, least, share, top, ranges).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, least, share, top)


def test_collocations_edges(spark, docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.filter("text is null")).count() == 0
    got = collocations.collocations(docs).collect()
    assert sorted(map(tuple, got)) == brute_phrases([(r.lang, r.text) for r in docs.collect()], 10, 50, 2000)


def test_counts_beyond_64_bit_products(spark):
    """1e6 * a * a passes 2**63 from a = 3,037,000 on: scores are whole numbers of any size."""
    parts = [(np.zeros(1, np.int64),) * 2 + (np.array([0]),), *[None] * 3]
    one, two = np.array([0, 0]), np.array([1, 2])
    parts[1] = (one, two, np.array([4_000_000_000, 5_000_000_000]))
    parts[2] = (np.array([0]), np.array([2]), np.array([3_999_999_999]))
    parts[3] = (np.zeros(0, np.int64),) * 3
    blob = _transducer.dump(_transducer.build([b"en", b"x", b"y"], parts))
    table = spark.createDataFrame([(0, 0, bytearray(blob))], collocations.PARTS)
    assert [tuple(r) for r in collocations.scored(table, 1).collect()] == [("en", "x y", 3_999_999_999, 4_000_000_000, 5_000_000_000, 10**6 * 3_999_999_999**2 // (4_000_000_000 * 5_000_000_000))]


def test_transducers():
    """Equal states are kept once; union adds weights; composition finds what is there; bytes come back."""

    def made(grams):
        vocab = sorted({w for g in grams for w in g})
        rows, keys = [], []
        for k in range(4):
            level = sorted({g[: k + 1] for g in grams if len(g) > k})
            keys.append(level)
            parent = [keys[k - 1].index(g[:-1]) if k else 0 for g in level]
            rows.append(tuple(np.array(x, np.int64) for x in (parent, [vocab.index(g[-1]) for g in level], [grams.get(g, 0) for g in level])))
        return _transducer.build(vocab, rows)

    def listed(vocab, rows):
        out, names = {}, [()]
        for parent, label, weight in rows:
            names = [(*names[p], vocab[w]) for p, w in zip(parent.tolist(), label.tolist(), strict=True)]
            out |= dict(zip(names, weight.tolist(), strict=True))
        return out

    rng = np.random.default_rng(3)
    every = []
    for _ in range(4):
        grams = collections.Counter()
        for _ in range(80):
            g = tuple(bytes([97 + int(c)]) for c in rng.integers(0, 4, 4))
            for k in range(1, 5):
                grams[g[:k]] += 1
        t = made(grams)
        assert listed(t.vocab, _transducer.paths(t)) == dict(grams)
        again = _transducer.load(_transducer.dump(t))
        assert again.vocab == t.vocab and listed(again.vocab, _transducer.paths(again)) == dict(grams)
        for level in t.levels:  # minimal: no two states of a level have the same arcs
            states = [tuple(map(tuple, (x[a:b].tolist() for x in (level.label, level.weight, level.target)))) for a, b in zip(level.cuts[:-1], level.cuts[1:], strict=True)]
            assert len(set(states)) == len(states)
        every.append((t, grams))
    total = sum((g for _, g in every), collections.Counter())
    vocab, rows = _transducer.union(t for t, _ in every)
    assert listed(vocab, rows) == dict(total)
    cut = _transducer.kept(vocab, rows, 8)
    assert {g: c for g, c in listed(*cut).items() if len(g) > 1} == {g: c for g, c in total.items() if len(g) > 1 and c >= 8}
    asked = made({g: 1 for _, grams in every[:1] for g in grams} | {(b"a", b"z"): 1, (b"y",): 1})
    found = _transducer.composed(asked, *cut)
    names = listed(asked.vocab, [(p, w, f[0]) for (p, w, _), f in zip(_transducer.paths(asked), found, strict=True)])
    have = listed(*cut)
    assert names == {g: have.get(g, 0) for g in names} and (b"a", b"z") in names


def test_a_shared_sign_does_not_merge_states(monkeypatch):
    monkeypatch.setattr(_transducer, "mixed", lambda x: x * np.uint64(0))
    level = _transducer.Level(np.array([0, 1, 2, 3]), np.array([5, 6, 5]), np.array([1, 1, 1]), np.zeros(3, np.int64))
    merged, number = _transducer._merged_states(level)
    assert number[0] == number[2] != number[1] and len(merged.label) == 2
