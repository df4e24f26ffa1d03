"""Substring dedup: words that repeat in windows, found by a compressed FM-index per shard.

Equal windows share a sampled run of words (the one with the least hash in the window). Runs that occur once
in the corpus stand for no repeated window. The windows of all other runs, as stretches of text, go to the
shard of their run; a shard indexes its stretches and streams them through backward search, which reports the
intervals whose windows occur at least twice. A window is judged in a shard where all its equals are, so the
union of the reports is exact.

A run that very many windows share is split by what is next to it: those windows are sampled again by longer runs,
up to the window itself, and what occurs once on the way goes. Windows that are still common then are a passage that
stands in very many texts. Its stretches are cut, at places that depend on the words alone, into pieces of under two
windows that share all but one word of a window, so that each window is in one piece; a passage or filler of any length
is then a few pieces, very often. Each piece is indexed once with its count, and backward search adds the counts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, stored, text_bytes
from ._words import samples, word_slices
from .fm_index import FmIndex, repeated_cover

WINDOW, GRAM = 35, 8
#: Words of a shard, about, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 400_000, 48
#: A run that occurs more often is split by longer runs; with a stretch's 49 words, the rest is a quarter of a shard.
HOT, STEPS = 2048, 4
#: Windows of one streamed part.
STREAM = 512
#: Bytes of distinct texts in one bucket, about.
BUCKET_BYTES = 64 << 20


def run_lengths(window: int, gram: int) -> list[int]:
    """Lengths of the runs by which windows are sampled, from gram to the whole window."""
    return sorted({window - (window - gram) * k // STEPS for k in range(STEPS + 1)})


def _distinct_texts(docs: DataFrame, text_col: str, n_bytes: int) -> tuple[DataFrame, str]:
    """((digest, text, copies, tid), table's name): stored in buckets of the digest, so that later joins leave the texts
    where they are. The number of buckets grows with the bytes of the texts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("tid", F.monotonically_increasing_id())
    name, held = f"chromaloom_{uuid.uuid4().hex}", spark.conf.get("spark.sql.shuffle.partitions")
    buckets = max(int(held), min(50_000, -(-n_bytes // BUCKET_BYTES)))
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))  # a task writes whole buckets
    try:
        texts.write.bucketBy(buckets, "digest").format("parquet").saveAsTable(name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    return spark.table(name), name


def _sampled(window: int, gram: int):
    """(tid, at, text, weight) -> (gram, tid, at, n, w): each part's sampled runs, how often it has them, and that times
    the part's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, ats = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, words in word_slices(batch.column(2)):
                found = samples(words.hashes(), words.text, window, gram)
                owner = words.text[found.at]
                order = np.lexsort((found.gram, owner))
                owner, g = owner[order], found.gram[order]
                new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, np.int64)
                n, own = np.diff(np.r_[new, len(g)]), first + owner[new]
                weight = batch.column(3).to_numpy()[own]
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(tids[own]), pa.array(ats[own]), pa.array(n.astype(np.int64)), pa.array(n * weight)], ["gram", "tid", "at", "n", "w"])

    return run


def _unions(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, member) of the unions of intervals [a, b) within each group; member is one interval's number."""
    order = np.lexsort((a, group))
    a, b, group = a[order], b[order], group[order]
    change = np.r_[True, group[1:] != group[:-1]]
    lift = np.cumsum(change) * (int(b.max()) + 1)  # so that one running maximum serves all groups
    reach = np.maximum.accumulate(b + lift)
    at = np.flatnonzero(np.r_[True, a[1:] + lift[1:] > reach[:-1]])
    return a[at], reach[np.r_[at[1:], len(a)] - 1] - lift[at], order[at]


def _stretches(window: int, gram: int, shards: int, level: int):
    """(tid, at, ask, cold, hot, text, weight) -> stretches of text for the shards of the part's cold runs, and, with shard -1
    and single spaces, those of its hot runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - gram + 1
        for batch in batches:
            tids, ats, ask, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 6))
            lists = [(batch.column(i).flatten().to_numpy().view(np.uint64), batch.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for i in (3, 4)]
            base = [np.concatenate([[0], np.cumsum(n)]) for _, n in lists]
            for first, rows, words in word_slices(batch.column(5)):
                h = words.hashes()
                found = samples(h, words.text, window, gram)
                owner, view, out = words.text[found.at], memoryview(words.data), []
                for hot, (g, n) in enumerate(lists):
                    low, high = base[hot][first], base[hot][first + rows]
                    which = np.flatnonzero(_in_pairs(owner, found.gram, np.repeat(np.arange(rows), n[first : first + rows]), g[low:high]))
                    if not len(which):
                        continue
                    a, b = found.starts(which, width)
                    text = owner[which]
                    shard = np.full(len(which), -1) if hot else ((found.gram[which] >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
                    a, end, member = _unions(a, b + window, text * (shards + 1) + shard + 1)
                    text, shard = text[member], shard[member]
                    texts = [bytes(view[s:e]) for s, e in zip(words.start[a].tolist(), words.end[end - 1].tolist(), strict=True)]
                    if hot:
                        texts = [b" ".join(t.split()) for t in texts]
                    begun = np.searchsorted(words.text, text)
                    out.append((shard + (0 if hot else level << 32), tids[first + text], ats[first + text] + a - begun, (end - a).astype(np.int64), texts, ask[first + text], weights[first + text]))
                for shard, tid, at, size, texts, asked, weight in out:
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(tid), pa.array(at, pa.int64()), pa.array(size), pa.array(texts, pa.binary()), pa.array(asked), pa.array(weight)], ["shard", "tid", "at", "size", "stretch", "ask", "weight"])

    return run


def _in_pairs(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Whether each pair (a, b) is among the known pairs."""
    if not len(known_a) or not len(a):
        return np.zeros(len(a), bool)
    values, code = np.unique(np.concatenate([known_b, b]), return_inverse=True)
    key = np.concatenate([known_a, a]) * len(values) + code
    return np.isin(key[len(known_a) :], key[: len(known_a)])


def _reported(window: int):
    """One shard: index all stretches, stream those that ask, report their repeated intervals."""

    def run(key, table):
        number: dict[bytes, int] = {}
        ids, size = [], np.zeros(table.num_rows, np.int64)
        for i, text in enumerate(text_bytes(table.column("stretch").combine_chunks())):
            words = text.split()
            size[i] = len(words)
            ids.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words)))
            ids.append(np.zeros(1, np.int64))
        weight = table.column("weight").to_numpy()
        index = FmIndex(np.concatenate(ids), window, np.repeat(weight, size + 1) if (weight != 1).any() else None)
        del ids, number
        start = np.cumsum(size + 1) - size - 1
        windows = np.where(table.column("ask").to_numpy(zero_copy_only=False), np.maximum(size - window + 1, 0), 0)
        parts = -(-windows // STREAM)
        row = np.repeat(np.arange(len(size)), parts)
        skip = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * STREAM
        part, low, high = repeated_cover(index, start[row] + skip, np.minimum(windows[row] - skip, STREAM), window)
        at = table.column("at").to_numpy()[row[part]] + skip[part]
        return pa.table({"tid": table.column("tid").to_numpy()[row[part]], "low": at + low, "high": at + high})

    return run


def _cleaned(window: int):
    """(digest, text, copies, spans) -> (digest, n_words, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, spans = batch.column(2).to_pylist(), batch.column(3)
            n_words, n_removed, sha = [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                words = text.split()
                n = len(words)
                if copies[i] > 1 and n >= window:
                    words = []
                elif spans[i].is_valid:
                    keep = np.ones(n, bool)
                    for span in spans[i].as_py():
                        keep[span["low"] : span["high"]] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["digest", "n_words", "n_removed", "kept_sha256"])

    return run


def _pieces(window: int, gram: int):
    """(tid, at, ask, text) -> (tid, at, ask, text, digest): the pieces of each stretch, and where they begin in the text.

    Each window has a run of ``gram`` words of least hash. A piece is the windows that follow each other with one such run
    at one place: the last of equal ones, when a new one is to be taken. So it has under two windows' words, and its ends
    depend on what is near alone; where all runs are equal it goes as far as it can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - gram + 1
        for batch in batches:
            tids, ats, ask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for first, _, words in word_slices(batch.column(3)):
                found = samples(words.hashes(), words.text, window, gram)
                if not len(found.at):
                    continue
                least, place, hashes = found.least, found.at, found.gram
                begins, lasts = [], []
                windows = np.flatnonzero(least)
                # the last sampled place in each window that has the window's least hash
                by = np.lexsort((place, hashes))
                key = hashes[by]
                code = np.searchsorted(values := np.unique(key), least[windows])
                line = np.searchsorted(values, key) * (len(least) + window) + place[by]
                last = line[np.searchsorted(line, code * (len(least) + window) + windows + width - 1, "right") - 1] - code * (len(least) + window)
                ends = np.append(np.flatnonzero((np.diff(windows) != 1) | (least[windows][1:] != least[windows][:-1])), len(windows) - 1)  # of one least hash
                at, k = 0, 0
                while at < len(windows):
                    while ends[k] < at:
                        k += 1
                    stop = min(int(ends[k]), at + int(last[at]) - int(windows[at]))
                    begins.append(at)
                    lasts.append(stop)
                    at = stop + 1
                a, end = windows[begins], windows[lasts] + window
                view, text = memoryview(words.data), words.text[a]
                pieces = [bytes(view[s:e]) for s, e in zip(words.start[a].tolist(), words.end[end - 1].tolist(), strict=True)]
                begun = np.searchsorted(words.text, text)
                yield pa.RecordBatch.from_arrays([pa.array(tids[first + text]), pa.array(ats[first + text] + a - begun), pa.array(ask[first + text]), pa.array(pieces, pa.binary()), pa.array([hashlib.sha256(p).digest() for p in pieces], pa.binary())], ["tid", "at", "ask", "text", "digest"])

    return run


_STRETCHES = "shard long, tid long, at long, size long, stretch binary, ask boolean, weight long"


def _sharded(texts: DataFrame, window: int, lengths: list[int], hot: int, first: bool) -> tuple[DataFrame, DataFrame | None]:
    """(stretches in shards, stretches that stay hot at the last length or None) of texts (tid, at, ask, text, weight).

    first: texts is stored in buckets of its column digest, by which it is joined. Where not, texts are distinct pieces of
    common stretches, and what is common among them at the last length goes to the shard of its window."""
    parts, done = texts, []
    for level, gram in enumerate(lengths):
        most_cold = hot if first or level + 1 < len(lengths) else (1 << 63) - 1
        sampled = stored(parts.select("tid", "at", "text", "weight").mapInArrow(_sampled(window, gram), "gram long, tid long, at long, n long, w long"))
        runs = checkpoint(sampled.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).filter("w > 1"))
        total, most = runs.agg(F.coalesce(F.sum(F.when(F.col("n") <= most_cold, F.col("n"))), F.lit(0)), F.max("n")).first()
        shards = max(LEAST_SHARDS, total * (window + 14) // SHARD_WORDS)
        is_hot = F.col("r.n") > most_cold
        lists = sampled.alias("s").join(runs.alias("r"), "gram").groupBy("tid", "at").agg(F.collect_list(F.when(~is_hot, F.col("gram"))).alias("cold"), F.collect_list(F.when(is_hot, F.col("gram"))).alias("hot"))
        if level == 0 and first:
            lists = lists.join(parts.select("tid", "digest"), "tid").select("digest", "cold", "hot")
            asked = parts.join(lists, "digest")
        else:
            asked = parts.join(lists, ["tid", "at"])
        found = stored(asked.select("tid", "at", "ask", "cold", "hot", "text", "weight").mapInArrow(_stretches(window, gram, shards, level), _STRETCHES))
        done.append(found.filter("shard >= 0"))
        left = found.filter("shard < 0").select("tid", "at", "size", "ask", F.col("stretch").alias("text"), "weight")
        if most is None or most <= most_cold:
            return reduce(DataFrame.union, done), None
        parts = left
    return reduce(DataFrame.union, done), parts


def _judged(sharded: DataFrame, window: int) -> DataFrame:
    """Stretches in shards -> (tid, low, high): an index for each shard."""
    return sharded.select("shard", "tid", "at", "stretch", "ask", "weight").groupBy("shard").applyInArrow(_reported(window), "tid long, low long, high long")


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Distinct texts (digest, text, copies, tid) -> (tid, low, high): word intervals covered by windows that
    occur elsewhere. Texts with copies are not asked about (all their windows repeat), but others meet them."""
    own = texts.select("digest", "tid", F.lit(0).cast("long").alias("at"), (F.col("copies") == 1).alias("ask"), "text", F.lit(1).cast("long").alias("weight"))
    lengths = run_lengths(window, gram)
    cold, common = _sharded(own, window, lengths, hot, True)
    spans = _judged(cold, window)
    if common is None:
        return spans
    pieces = stored(common.select("tid", "at", "ask", "text").mapInArrow(_pieces(window, gram), "tid long, at long, ask boolean, text binary, digest binary"))
    distinct = pieces.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("weight"), F.max("ask").alias("ask"))
    distinct = stored(distinct.withColumns({"tid": F.monotonically_increasing_id(), "at": F.lit(0).cast("long")}))
    sharded, _ = _sharded(distinct.select("tid", "at", "ask", "text", "weight"), window, lengths, hot, False)
    found = _judged(sharded, window).join(distinct.select("tid", "digest"), "tid").groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    places = pieces.filter("ask").select("tid", "at", "digest").join(found, "digest").select("tid", "at", F.explode("spans").alias("s"))
    return spans.union(places.select("tid", (F.col("at") + F.col("s.low")).alias("low"), (F.col("at") + F.col("s.high")).alias("high")))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of whole texts left after repeated windows go: (id, n_words, n_removed, kept_sha256).

    One row for each input row, null and repeated ids included. A window is ``window`` words in a row; every
    word of a window that also starts anywhere else, in the same text or another, is removed; windows are
    judged on the input. Words are runs of bytes other than ASCII white space, unchanged. Null, empty and
    blank texts have no words; shorter texts than a window lose none. Of rows with equal text each counts:
    all their windows repeat. Other columns are not read. The table of distinct texts that it keeps in the warehouse
    meanwhile is dropped at the end.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sig = checkpoint(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    n_bytes = sig.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    texts, name = _distinct_texts(docs, text_col, n_bytes)
    try:
        spans = repeated_spans(texts, window, gram, hot).groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        spans = checkpoint(spans.join(texts.select("tid", "digest"), "tid").select("digest", "spans"))
        whole = texts.join(spans, "digest", "left").select("digest", "text", "copies", "spans")
        done = checkpoint(whole.mapInArrow(_cleaned(window), "digest binary, n_words long, n_removed long, kept_sha256 string"))
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return sig.join(done, "digest").select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
