"""URL filter, top-k, mixing, quality, WARC and the pipeline."""

import collections
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from chromaloom.llm import mixing, quality, topk, url_filter, warc
from pyspark.sql import functions as F

# --- urls ---

URLS = ["http://A.Example.net/en/x?q#f", "https://example.net/en", "http://example.net/en/", "ftp://x.org/fr/y", "x://org/fr/", "http://myexample.com/de/", "http://example.com/de/1", "no scheme", "", None, "http://net", "http://net/", "http://a.net?x=http://b/", "http://example.com:80/de/"]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("org/fr/", "allow"), (None, "block"), ("bad", "block"), ("net/", "other")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if c.isascii() else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = (None, "allow")
    for rule, verdict in RULES[:4]:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


@pytest.mark.parametrize("most", [url_filter.MOST_BYTES, 0])
def test_urls(spark, most):
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(URLS)], "page_id int, url string, rule string, key int")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, most_bytes=most).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


@pytest.mark.parametrize("most", [url_filter.MOST_BYTES, 0])
def test_urls_in_parts(spark, monkeypatch, most):
    """Repeated rows, a host that many pages share, long hosts and urls, one rule under both verdicts, a rule without a host,
    and rules of many depths and path lengths."""
    monkeypatch.setattr(url_filter, "PART_RULES", 7)
    monkeypatch.setattr(url_filter, "PART_KEYS", 50)
    rng = np.random.default_rng(1)
    rules = [(f"{'x.' * int(d)}host{k}.org/{'p' * int(n)}", "block" if k % 3 else "allow") for k, (d, n) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 30, 40), strict=True))]
    rules += [("both.org/", "block"), ("both.org/", "allow"), ("/only", "block")]
    urls = [f"http://{'x.' * int(d)}host{k}.org/{'p' * int(n)}" for k, d, n in zip(rng.integers(0, 45, 150), rng.integers(0, 4, 150), rng.integers(0, 40, 150), strict=True)]
    urls += ["http://a.both.org/"] * 80 + ["http://" + "a." * 3000 + "host3.org/" + "p" * 20_000, "http:///only/x", "http:///other", None, ""]
    pages = spark.createDataFrame([(i % 170, u, 1) for i, u in enumerate(urls)], "page_id int, url string, part int")
    known = {}
    for r, v in rules:
        known[r] = min(v, known.get(r, v))

    def brute(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host, path = (rest.split("/", 1)[0], "/" + rest.split("/", 1)[1]) if "/" in rest else (rest, "")
        fits = [r for r in known for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        return best, known[best] if best is not None else "allow"

    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "rule string, verdict string"), most_bytes=most).collect()
    assert sorted((str(r.url), str(r.rule), r.verdict) for r in got) == sorted((str(u), *map(str, brute(u))) for u in urls)


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(*url_filter._hashes(F.col("id").cast("string")), "id")
    levels = url_filter.build_cascade(keys.filter("id % 40 = 3").select("h1", "h2"), 500, keys.select("h1", "h2"), 20_000)
    rows = keys.toPandas()
    assert (url_filter._in_cascade(levels, rows[["h1", "h2"]].to_numpy()) == (rows.id % 40 == 3)).all() and len(levels) > 1


# --- top-k ---


@pytest.mark.parametrize("big", [1, 10**8])
def test_topk(spark, big):
    rng = np.random.default_rng(4)
    vectors = (rng.integers(-3, 4, (90, 7)) * (rng.random((90, 7)) < 0.4) * big).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200, None), (None, [1] * 7), (201, []), (202, [1 * big])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = collections.defaultdict(dict)
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 5).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    whole = {i: (v + [0] * 7)[:7] for i, v in rows if i is not None and v is not None}
    for q in (i for i in whole if i % 20 == 0):
        want = sorted(((sum(a * b for a, b in zip(whole[q], v, strict=True)), -i) for i, v in whole.items() if i != q), reverse=True)[:5]
        assert got[q] == {k + 1: (-i, s) for k, (s, i) in enumerate(want)}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_repeated_queries_and_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1 << 16)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-9, 10, (60, 3000))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(vectors)] + [(20, vectors[3].tolist(), 2, "y"), (20, vectors[20].tolist(), 3, "z"), (7, vectors[7].tolist(), 4, "w")]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>, block int, score string")
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), 4).collect()
    for q in (0, 20, 40):
        own = min(v for i, v, _, _ in rows if i == q)
        want = sorted(((-int(np.dot(own, v)), i) for i, v, _, _ in rows if i != q))[:4]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    big = spark.createDataFrame([(0, [2**40] * 9), (1, [2**40] * 9)], "vec_id long, vec array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big, big).collect()


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(topk.quantised(F.col("v"))).collect()] == [[32, -1], None, None, None, None, []]


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(20, [0.1, 0.2]), (21, [0.3, 0.1])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.search_table(df).collect()] == [(20, 1, 21)]


# --- mixing ---


def edf(weights, slots):
    """The slots of each source's blocks, by a plain walk in exact fractions."""
    total, done, out = sum(weights), [0] * len(weights), [[] for _ in weights]
    for t in range(slots):
        ready = [i for i, w in enumerate(weights) if done[i] * total // w <= t]
        pick = min(ready, key=lambda i: (-(-(done[i] + 1) * total // weights[i]), i))
        out[pick].append(t)
        done[pick] += 1
    return out


@pytest.mark.parametrize("weights", [[90] + [1] * 10, [7, 1, 1, 1], [1, 1, 1], [997, 1, 2], [1], [618, 382], [1 + i % 3 for i in range(1200)]])
def test_schedule_stays_within_one_block_of_the_exact_weights(spark, weights):
    names = [f"s{i:04}" for i in range(len(weights))]
    df = spark.createDataFrame(list(zip(names, weights, strict=True)), "src string, weight long")
    counts = df.select("src", F.lit(10**6).alias("docs"))
    plan, period = mixing.mix_plan(df, counts)
    total = sum(weights)
    assert total % period == 0
    rows = {r.src: r for r in plan.collect()}
    slots = {n: [k * period + t for k in range(10) for t in rows[n].at] for n in names}  # ten periods
    assert sorted(t for x in slots.values() for t in x) == list(range(10 * period))
    for n, w in zip(names, weights, strict=True):
        own = np.searchsorted(np.array(slots[n]), np.arange(10 * period + 1))
        assert np.abs(own * total - np.arange(10 * period + 1) * w).max() < total  # in whole numbers: under one block
    if len(weights) < 20:
        assert [rows[n].at for n in names] == edf(weights, period)


def test_schedule_without_a_short_period(spark):
    """Weights with a long period: exact for as many slots as the rows need, or rounded to a period."""
    weights = [314159265, 271828182, 141421356, 57721566]
    df = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "src string, weight long")
    total = sum(weights)
    counts = spark.createDataFrame([("s0", 900), ("s1", 400), ("s2", 300), ("s3", 100)], "src string, docs long")
    plan, period = mixing.mix_plan(df, counts, block_docs=4, most_slots=1000)
    rows = {r.src: r.at for r in plan.collect()}
    n = sum(map(len, rows.values()))
    assert period is None and n == max(-(-(-(-d // 4)) * total // w) for d, w in zip((900, 400, 300, 100), weights, strict=True))
    assert [rows[f"s{i}"] for i in range(4)] == edf(weights, n)
    for i, w in enumerate(weights):
        assert all(abs(sum(t < k for t in rows[f"s{i}"]) * total - k * w) < total for k in range(n + 1))
    many = spark.createDataFrame([("s0", 900), ("s1", 400), ("s2", 300), ("s3", 10**12)], "src string, docs long")
    plan, period = mixing.mix_plan(df, many, block_docs=4, most_slots=1000)
    rows = {r.src: r for r in plan.collect()}
    parts = [rows[f"s{i}"].w for i in range(4)]
    assert period == sum(parts) == 1000 and all(abs(p / 1000 - w / total) <= 1 / 1000 for p, w in zip(parts, weights, strict=True))
    assert [rows[f"s{i}"].at for i in range(4)] == edf(parts, 1000)
    small = mixing.in_parts(spark.createDataFrame([("a", 10**12), ("b", 1), ("c", 1)], "src string, w long"), 10**12 + 2, 100)
    assert sorted(map(tuple, small.collect())) == [("a", 98), ("b", 1), ("c", 1)]


@pytest.mark.parametrize("most", [mixing.MOST_SLOTS, 5000])
def test_skewed_rows_under_weights_with_a_long_period_have_slots(spark, most):
    """One source has five sixths of the rows; the weights' reduced sum is 300,013: every row has a place, blocks keep their
    size, and the order of reading follows the weights while all sources have rows."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50_000, "hot").when(F.col("id") % 2 == 0, "b").otherwise("c").alias("source"))
    weights = {"hot": 100_003, "b": 99_991, "c": 100_019}
    got = mixing.mix_sources(docs, spark.createDataFrame(list(weights.items()), "source string, weight long"), most_slots=most).toPandas()
    assert got.slot.notna().all() and got.slot_pos.between(0, 15).all() and not got.duplicated(["slot", "slot_pos"]).any()
    assert got.groupby(["source", "block"]).size().max() == 16 and got.groupby("slot").source.nunique().max() == 1
    blocks = got.drop_duplicates(["source", "block"])
    last = blocks.groupby("source").slot.max().min()
    for name, w in weights.items():
        own = np.sort(blocks[blocks.source == name].slot.to_numpy())
        t = np.arange(last + 1)
        asked = t * (w / 300_013)
        assert np.abs(np.searchsorted(own, t) - asked).max() < (1 if most > 5000 else 1 + (last + 1) / most)


def test_rounding_of_weights(spark):
    halves = mixing.whole_weights(spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", None), ("d", 0.0), ("e", -1.0), ("b", 0.125)], "src string, weight double"))
    assert {r.src: r.w for r in halves.collect()} == {"a": 4, "b": 3}
    with pytest.raises(ValueError, match="sum over"):
        mixing.mix_plan(spark.createDataFrame([("a", 2**60), ("b", 1)], "src string, weight long"), spark.createDataFrame([], "src string, docs long"))


def test_mix_keeps_every_row(spark, docs, empty):
    mixed = mixing.mix_sources(docs, block_docs=2)
    assert mixed.count() == docs.count() and set(docs.columns) < set(mixed.columns)
    rows = mixed.collect()
    places = [(r.slot, r.slot_pos) for r in rows]
    assert len(set(places)) == len(places) and all(r.slot is not None for r in rows)
    assert mixing.mix_sources(empty).count() == 0
    few = mixing.mix_sources(docs, spark.createDataFrame([("s1", 3.0), (None, 1.0)], "source string, weight double"))
    assert all((r.slot is None) == (r.source not in ("s1", None)) for r in few.collect())
    assert all(r.slot is None and not r.in_mix for r in mixing.mix_sources(docs, spark.createDataFrame([], "source string, weight double")).collect())
    report = {r.source: r for r in mixing.mix_report(mixed).collect()}
    assert sum(r.docs for r in report.values()) == docs.count() == sum(r.in_mix + r.left_out for r in report.values())


def test_null_ids_are_ranked_in_many_buckets(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.array("id").alias("more"))
    mixed = mixing.mix_sources(rows).toPandas()
    assert len(mixed) == 3000 and not mixed.duplicated(["slot", "slot_pos"]).any() and mixed.in_mix.all()


def test_hot_source_is_damped(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    share = {r.source: r["count"] for r in mixing.mix_sources(docs).filter("in_mix").groupBy("source").count().collect()}
    assert 0.3 < share["hot"] / sum(share.values()) < 0.36
    assert sum(n for s, n in share.items() if s != "hot") > 0.97 * 2000


def test_long_tail_keeps_its_documents(spark):
    """Many sources far smaller than a block keep their weights and their documents."""
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("big"), (F.col("id") % 5).cast("string")).alias("source"))
    tail = spark.range(20_000, 23_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("tail"), (F.col("id") % 1200).cast("string")).alias("source"))
    rows = mixing.mix_sources(big.union(tail), block_docs=2).toPandas()
    assert len(rows) == 23_000 and rows.slot.notna().all() and not rows.duplicated(["slot", "slot_pos"]).any()
    weights = spark.createDataFrame([(f"big{i}", 1000.0) for i in range(5)] + [(f"tail{i}", 0.5 + i % 2) for i in range(1200)], "source string, weight double")
    asked = mixing.mix_sources(big.union(tail), weights, block_docs=1).toPandas()
    early = asked[asked.slot < 6000].groupby("source").size()
    for i in range(1200):
        assert abs(early.get(f"tail{i}", 0) - min(6000 * (0.5 + i % 2) / 6200, 3)) < 1
    assert all(abs(early[f"big{i}"] - min(6000 * 1000 / 6200, 4000)) < 1 for i in range(5))


# --- quality ---


def test_quality(spark):
    rng = np.random.default_rng(0)
    stems = ["ren", "tal", "vor", "mi", "ko", "sel", "dra", "un"]

    def good():
        return " ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(60))

    rows = [(i, good() if i % 4 else good().upper().replace(" ", "!! "), int(i % 4 > 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, ""), (5001, None), (None, good())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels, per_class=150).collect()}
    assert len(got) == 1203 and got[5000].score == got[5001].score == 0
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert 200 < len(held) < 400 and np.mean([p == y for p, y in held]) > 0.95
    kept = quality.keep_good(docs, labels, per_class=150)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def brute_terms(text):
    """Term frequencies by plain loops; hashes come from the library's own word hash."""
    import re

    from chromaloom.llm._words import word_slices

    def hashes(parts):
        column = pa.array([" ".join(parts)])
        return next(word_slices(column))[2].hashes().tolist() if parts else []

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    out = np.zeros(quality.TERMS)
    for h in hashes([w.decode() for w in words]):
        out[(h >> 40) % quality.WORDS] += 1 / len(words)
    pieces = [w[i : i + quality.PIECE] for w in words for i in range(0, len(w), quality.PIECE)]
    if all(p.isascii() for p in pieces):
        for h in hashes([p.decode() for p in pieces]):
            out[quality.WORDS + (h >> 40) % quality.PIECES] += 1 / len(pieces)
    for i, w in enumerate(words):
        back = [i - j for j in range(i) if words[j] == w]
        if back:
            out[quality.WORDS + quality.PIECES + min((min(back) - 1).bit_length(), quality.GAPS - 1)] += 1 / len(words)
    return np.sqrt(out)


def test_terms_by_brute_force():
    texts = ["one two two one three one", "", None, "  ", "a", "longer words are cut in pieces of four bytes longer", "x " * 500, "in. " * 3 + "of the in. of"]
    got = quality.term_vectors(pa.array(texts))
    assert np.allclose(got, [brute_terms(t) for t in texts], atol=1e-6)


def brute_score(model, text, labelled_texts):
    """(score, similarities): the vote of the nearest vectors whose text is another, sorted in full."""
    near = np.round(model.latent(quality.term_vectors(pa.array([text])))[0].astype(float) @ model.vectors.T.astype(float), quality.PLACES)
    own = [k for k in range(len(near)) if labelled_texts[k] != (text or "")]
    best = sorted(own, key=lambda k: (-near[k], k))[: quality.NEIGHBOURS]
    vote = np.maximum(near[best], 0) ** quality.SHARPNESS * model.weights[best]
    return ((vote * model.labels[best]).sum() / vote.sum() if vote.sum() else 0), near[own]


def texts_of(model, texts):
    """The text of each vector of a model."""
    known = dict(zip(quality.text_digests(pa.array(texts)), texts, strict=True))
    out = {k: known[d] for d, rows in model.texts.items() for k in rows}
    return [out[k] for k in range(len(model.labels))]


def test_own_labels_do_not_vote(spark):
    """Labels that say nothing: labelled documents score no better by them than others, copies of them included."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(700)]
    texts[600:] = texts[:100]  # under other ids, with labels of their own
    y = rng.integers(0, 2, 700)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas().sort_values("doc_id")
    known = ~got.held_out.to_numpy()
    assert abs(np.corrcoef(got.score[known], y[known])[0, 1]) < 0.15 and got.score.between(0, 1).all()
    assert np.allclose(got.score[600:], got.score[:100], atol=1e-3)
    alone = quality.quality_scores(docs.limit(1), labels)
    assert alone.first().score == 0  # nothing else to be like


def test_neighbours_by_brute_force(spark):
    """Scores from all exact cosines, sorted in full; the labelled texts hold copies, so that many similarities tie."""
    rng = np.random.default_rng(2)
    labelled = [(i, " ".join(rng.choice(["ren", "tal", "vor", "mi", "ko", "se"], 12)) if i % 7 else "same words for all of these", int(rng.random() < 0.5)) for i in range(400)]
    asked = [(1000 + i, " ".join(rng.choice(["ren", "tal", "vor", "mi", "ko", "se"], 9))) for i in range(60)] + [(2000, "same words for all of these"), (2000, "same words for all of these"), (None, "other"), (3000, "y" * 200_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled] + asked, "doc_id long, text string").withColumns({"label": F.lit(1), "terms": F.lit("x"), "score": F.lit(0.5)})
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, quality int")
    model = quality.fit(docs, labels, 100)
    got = quality.quality_scores(docs, labels, per_class=100).collect()
    text = dict((i, t) for i, t, _ in labelled) | dict(asked)
    assert len(got) == len(labelled) + len(asked)
    labelled_texts = texts_of(model, list(text.values()))
    for r in got[::5]:
        want, near = brute_score(model, text[r.doc_id], labelled_texts)
        edge = sorted(near, reverse=True)[quality.NEIGHBOURS - 1]
        if sum(abs(near - edge) < 3 * 10.0**-quality.PLACES) == sum(near == edge):  # no similarity on a rounding border
            assert abs(r.score - want) < 1e-3


def test_repeated_labelled_rows_are_read_once(spark):
    rows = [(i, f"word{i % 5} and text {i}") for i in range(40)] + [(3, "other text")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    assert len(quality.fit(docs, labels).labels) <= 40


# --- WARC ---


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<html><head><title> A &amp; B </title></head><body><p>One</p><script>x</script><!-- c --><p>two &lt;3 <a href='/l?x=1'>link</a></body></html>"), (2, None, None), (3, "http://ü/\r\n", "plain\r\n\r\ntext é"), (None, "u", "")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    found = warc.responses(df)
    made = warc.derivatives(found).collect()
    one = next(r for r in made if r.key == 1)
    assert one.title == "A & B" and one.n_links == 1 and one.conversion_block == "One\ntwo <3 link"
    assert "outlink: /l?x=1" in one.metadata_block and one.source_headers.startswith("HTTP/1.1 200 OK")
    path = str(tmp_path / "w")
    records = warc.warc_records(warc.derivatives(found)).unionByName(warc.response_records(found))
    warc.write_warc(records, path, 2)
    back = warc.read_warc(spark, path).collect()
    assert collections.Counter(r.kind for r in back) == {"metadata": 4, "conversion": 4, "response": 4}
    assert {r.target_uri for r in back} == {"http://a/", "", "http://ü/%0D%0A", "u"}
    ids = {r.record_id for r in back if r.kind == "response"}
    assert all(r.refers_to in ids for r in back if r.kind != "response")
    import hashlib

    assert all(r.block_digest == "sha256:" + hashlib.sha256(r.block).hexdigest() for r in back)
    three = next(r for r in back if r.kind == "conversion" and "%0D" in r.target_uri)
    assert three.block.decode() == "plain\ntext é"
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_warc_headers_gzip_and_bytes(spark, tmp_path):
    """Given HTTP heads and dates reach the metadata record; a url cannot forge a header; gzip and raw bytes are read."""
    import gzip

    pages = [(1, "http://a/\r\nWARC-Type: forged\r\n\r\nx", "<p>t</p>", "HTTP/1.1 404 Not Found\r\nServer: s\r\nX-A: b\rc\r\n\r\n", "2020-02-02T00:00:00Z"), (1, "u", "<p>t</p>", None, None), (1, "u", "<p>t</p>", None, None)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string, headers string, at string").withColumns({"title": F.lit(1), "http": F.lit(2), "links": F.lit(3)})
    found = warc.responses(df, date_col="at", headers_col="headers")
    made = warc.derivatives(found).collect()
    one = next(r for r in made if r.target_uri != "u")
    assert "source-status: HTTP/1.1 404 Not Found\r\nsource-header: Server: s\r\nsource-header: X-A: b%0Dc\r\n" in one.metadata_block and one.date == "2020-02-02T00:00:00Z"
    assert len({r.metadata_id for r in made}) == 2 and len(made) == 3
    records = warc.warc_records(warc.derivatives(found)).unionByName(warc.response_records(found))
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert collections.Counter(r.kind for r in back) == {"metadata": 3, "conversion": 3, "response": 3}
    raw = b"WARC/1.0\r\nWARC-Type:resource\r\nContent-Length: 4\r\nX: \xff\r\n\r\n\xff\x00\r\n\r\n\r\n"
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    assert [(r.kind, bytes(r.block)) for r in warc.read_warc(spark, str(tmp_path / "z"), "*.gz").collect()] == [("resource", b"\xff\x00\r\n")] * 2
    (tmp_path / "z" / "b.warc").write_bytes(raw[:-3])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, str(tmp_path / "z"), "*.warc").collect()


def test_malformed_html(spark):
    cases = {
        "a<script>var x='<p>';": "a",
        "a<!-- b": "a",
        "a<style>p{}": "a",
        """<p title="x > y" id='>'>t</p>""": "t",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        '<b title="x>t': "t",
        "<div " + 'a="b>" ' * 5000 + ">t</div>": "t",
        "x" * 300_000 + "<p>" * 3000: "x" * 300_000,
        "&#8217;caf&eacute;&#x41;": "’caféA",
        "<header>h</header><head>gone</head>": "h",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    got = {r.i: r.t for r in df.select("i", warc.html_text(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


class Reader(HTMLParser):
    """Links and title as the standard library's parser sees them."""

    def __init__(self, html):
        super().__init__()
        self.links, self.title, self.inside = [], None, False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        href = next((v for n, v in attrs if n == "href"), None)
        if tag == "a" and href and href.strip():
            self.links.append(re.sub("[\t\n\r]", "", href).strip(" "))
        self.inside = tag == "title" and self.title is None
        if self.inside:
            self.title = ""

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title += data


LINKED = [
    """<!-- <a href="c1"> --><script>x = "<a href='s1'>"</script><a data-href="wrong" href="right">r</a><a href="/q?a=1&amp;b=2">q</a>""",
    "<!-- <title>hidden</title> --><title>shown &amp; kept</title><title>second</title>",
    "<style>a:after{content:'<a href=x>'}</style><A HREF = 'up' class=b>u</A><a\nhref=plain>p</a><a href=x/y?z=1#f>w</a>",
    """<img alt='<a href="in quotes">'><a title="href=no" href=yes>y</a><a title='>' href="after">a</a><a href="one" href="two">o</a>""",
    """<a name="n">no link</a><a href>none</a><a href="">empty</a><abbr href="abbr">b</abbr><area href="area"><a/href="slash">s</a>""",
    """<a href="tab\tand\nline">t</a><a href="  spaces  ">s</a><a href="caf&eacute;&#233;&#xE9;">c</a><a href="?a=1&b=2&lt=3">l</a>""",
    "<p>text</p><a href='open",
    "",
]


def test_links_and_titles_are_the_parser_s(spark):
    df = spark.createDataFrame([*enumerate(LINKED), (99, None)], "i int, h string")
    got = {r.i: r for r in df.select("i", warc.html_links(F.col("h")).alias("links"), warc.html_title(F.col("h")).alias("title")).collect()}
    for i, page in enumerate(LINKED):
        want = Reader(page)
        links = [x.replace("<=3", "&lt=3") for x in want.links]  # older parsers decode a reference before =, HTML5 does not
        assert got[i].links == links, page
        assert got[i].title == (want.title or "")
    assert got[0].links == ["right", "/q?a=1&b=2"] and got[1].title == "shown & kept" and got[99].links == []
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    table = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    for r in table.select("i", warc.html_links(F.col("h")).alias("links"), warc.html_title(F.col("h")).alias("title")).collect():
        want = Reader(pages[r.i] or "")
        assert r.links == want.links and r.title == " ".join((want.title or "").split())


def test_links_of_hostile_pages(spark):
    pages = ["<a " + 'x="y>" ' * 5000 + "href='far'>f</a>", "<a href='" + "u" * 200_000 + "'>", "<a href=x>" * 5000, "<a " * 20_000]
    got = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", warc.html_links(F.col("h")).alias("links")).orderBy("i").collect()
    assert [r.links for r in got] == [["far"], ["u" * 200_000], ["x"] * 5000, []]


def test_references_in_attributes():
    cases = {"&amp;": "&", "&amp": "&", "a&copy=1": "a&copy=1", "&copyx": "&copyx", "&copy;x": "©x", "&#65;&#x42": "AB", "&unknown; &": "&unknown; &", "&notit;": "&notit;", "": ""}
    assert [warc.decoded_value(v) for v in cases] == list(cases.values())


def test_all_references_are_decoded(spark):
    import html

    names = [f"&{n}" for n in html.entities.html5 if n not in ("nbsp", "nbsp;", "NonBreakingSpace;", "Tab;", "NewLine;")]
    texts = [f"x{n}y" for n in names] + ["&copy; caf&eacute; &#233;&#xE9;&#XE9 &notit; &amp;lt; &unknown; & &#0; &#x110000; &#55296; a&b", "&#8212;&lt;b&gt;"]
    texts = [t for t in texts if not set(html.unescape(t)) & set(" \t\r\n\f")] + texts[-2:]
    df = spark.createDataFrame([(i, f"<title>{t}</title><p>{t}</p>") for i, t in enumerate(texts)], "i int, h string")
    got = df.select("i", warc.html_text(F.regexp_replace("h", "<title>.*</title>", "")).alias("t"), warc.html_title(F.col("h")).alias("n")).collect()
    assert all(r.t == r.n == html.unescape(texts[r.i]) for r in got)
    odd = spark.createDataFrame([("a&nbsp;&#160;b",), ("&#" + "1" * 5000 + ";",), (None,)], "h string")
    assert [r[0] for r in odd.select(warc.html_text(F.col("h"))).collect()] == ["a b", "\ufffd", ""]


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from chromaloom.llm import exact_dedup, simhash

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "source mix", "best-fit packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i == 4:
            own = out.toPandas()
            assert set(own.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()} and own.groupby("sequence_id").length.sum().max() <= 4096
            break
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before
        if i == 1:
            assert after == {r.doc_id for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
        if i == 2:
            assert after == {r.component_id for r in simhash.simhash_groups(docs).collect()}
        docs = kept
    assert corpus_pipeline.run(spark, d).count() == len(own)


def brute_mix(rows):
    """Ids in the mix, by plain loops: rows are (id, source)."""
    import hashlib
    import math

    by = collections.defaultdict(list)
    for i, s in rows:
        by["" if s is None else "=" + s].append((hashlib.md5(str(i).encode()).hexdigest(), i))
    names, total = sorted(by), len(rows)
    raw = [max(1, min(len(by[n]), math.floor((total - len(by[n])) * mixing.MOST_OF_OTHERS))) for n in names]
    w = [max(1, (r * mixing.PARTS + sum(raw) // 2) // sum(raw)) for r in raw]
    w = [x // math.gcd(*w) for x in w]
    period, at = sum(w), edf(w, sum(w))
    slot, ends = {}, []
    for n, own, x in zip(names, at, w, strict=True):
        for rank, (_, i) in enumerate(sorted(by[n])):
            block = rank // mixing.BLOCK_DOCS
            slot[i] = block // x * period + own[block % x]
        ends.append((slot[i], x))
    end = min(e for e, _ in ends if sum(x for f, x in ends if f > e) < mixing.LEAST_LIVE * period)
    return {i for i, s in slot.items() if s <= end}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage, on what the one before it kept, against a plain version of its own."""
    import corpus_pipeline
    from test_dedup import LOW, brute_components, brute_fingerprint

    d, place = "/root/testdata/sf0.001", 0
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{place}")
        kept = spark.read.parquet(f"{tmp_path}/{place}")
        got = sorted(r.doc_id for r in kept.select("doc_id").collect())
        if place == 0:
            model, want = quality.fit(docs, labels), []
            labelled_texts = texts_of(model, [t or "" for _, t, _ in rows])
            for i, t, _ in rows:
                score, _ = brute_score(model, t, labelled_texts)
                want += [i] if score >= 0.7 else []
                assert (score >= 0.7) == (i in got) or abs(score - 0.7) < 0.05, i
            assert len(set(want) ^ set(got)) <= 1
        elif place == 1:
            best = collections.defaultdict(int)
            for i, t, _ in rows:
                low = (t or "").translate(LOW)
                best[low] = max(best[low], i)
            assert got == sorted(best.values())
        elif place == 2:
            root = brute_components({brute_fingerprint(t) for _, t, _ in rows}, 4)
            least = {}
            for i, t, _ in rows:
                k = root[brute_fingerprint(t)]
                least[k] = min(i, least.get(k, i))
            assert got == sorted(least.values())
        else:
            assert set(got) == brute_mix([(i, s) for i, _, s in rows]) and len(got) == len(set(got))
            out = corpus_pipeline.left_out(spark, docs, d)
            assert out.columns == docs.columns and sorted(got + [r.doc_id for r in out.collect()]) == sorted(i for i, _, _ in rows)
            assert sum(r.left_out for r in corpus_pipeline.mix_report(spark, docs, d).collect()) == len(rows) - len(got)
        docs = kept
    asked = corpus_pipeline.mixed(spark, docs, d, spark.createDataFrame([("src0", 3), ("src1", 1)], "source string, weight long"))
    assert {r.source for r in asked.select("source").distinct().collect()} <= {"src0", "src1"}


def test_stages_on_odd_documents(spark, docs):
    """Nulls, copies, repeated rows and columns called like the operators' own pass through every stage unharmed."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    odd = docs.withColumnsRenamed({"slots": "slot"}).withColumns({n: F.col("slot") for n in ("in_mix", "block", "fp", "digest", "id", "old", "src", "score", "root", "bucket")})
    names = odd.columns
    for stage in [s for _, s in corpus_pipeline.STAGES][:4]:
        out = stage(spark, odd, d)
        rows = out.collect()
        assert out.columns == names and {tuple(r) for r in rows} <= {tuple(r) for r in odd.collect()}
        assert stage(spark, odd.limit(0), d).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, odd, d).count() >= odd.count()
