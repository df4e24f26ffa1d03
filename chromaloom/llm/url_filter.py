"""URL filters with a Bloom filter cascade.

Rules are strings of a host and a path prefix, like ``example.net/en/``. A url's keys are each of its host's
suffixes (at label borders) with each prefix of its path that is as long as some rule's path. The cascade's
first level encodes the listed keys, the second the false positives among the corpus's complete key universe,
the third the listed keys that the second takes in, and so on until nothing is wrong: membership of every key
of the corpus is then exact, from a few bits a listed key, and no table of rules is joined. Cascades that are too
large to send are cut by key hash: each part of the keys gets cascades of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, lower_ascii

#: Bytes that both cascades may have to be broadcast; beyond it they are cut by key hash, into parts of PART_RULES
#: listed keys and PART_KEYS keys of pages, about.
MOST_BYTES, PART_RULES, PART_KEYS = 64 << 20, 1 << 20, 1 << 20
MOST_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64, packed
    size: int
    hashes: int

    def has(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for place in _places(h, self.size, self.hashes):
            hit &= (self.bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit


def _places(h: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    """Bit positions of 128-bit hashes (n, 2), by double hashing."""
    a, b = h[:, 0].view(np.uint64), h[:, 1].view(np.uint64) | np.uint64(1)
    for i in range(hashes):
        yield ((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false-positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2)), hashes


def _level(keys: DataFrame, n: int, rate: float, depth: int) -> Level:
    """A Bloom filter over a table of hashes (h1, h2), its bits set and merged by Spark."""
    size, hashes = _shape(n, rate)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _salted(np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1), depth)
            at, bits = _packed(h, size, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    merged = keys.mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(-(-size // 64), np.uint64)
    bits[merged.column("at").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return Level(bits, size, hashes)


def _packed(h: np.ndarray, size: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, bits) of the 64-bit words that hashes set."""
    place = np.unique(np.concatenate([*_places(h, size, hashes)])) if len(h) else np.zeros(0, np.int64)
    at, first = np.unique(place >> 6, return_index=True)
    own = np.uint64(1) << (place & 63).astype(np.uint64)
    return at, np.bitwise_or.reduceat(own, first) if len(at) else np.zeros(0, np.uint64)


def _local_cascade(listed: np.ndarray, universe: np.ndarray) -> list[Level]:
    """The levels for listed hashes within a universe, both (n, 2), in one task's memory."""
    def level(h: np.ndarray, rate: float, depth: int) -> Level:
        size, hashes = _shape(len(h), rate)
        bits = np.zeros(-(-size // 64), np.uint64)
        at, own = _packed(_salted(h, depth), size, hashes)
        bits[at] = own
        return Level(bits, size, hashes)

    if not len(listed):
        return []
    levels = [level(listed, _first_rate(len(listed), len(universe)), 0)]
    known = set(map(tuple, listed.tolist()))
    wrong = universe[levels[0].has(_salted(universe, 0))]
    wrong = wrong[[tuple(x) not in known for x in wrong.tolist()]] if len(wrong) else wrong
    inside = listed
    for depth in range(1, MOST_LEVELS):
        if not len(wrong):
            return levels
        levels.append(level(wrong, 0.5, depth))
        inside, wrong = wrong, inside[levels[-1].has(_salted(inside, depth))]
    raise RuntimeError(f"the cascade has not ended after {MOST_LEVELS} levels")


def _first_rate(n_listed: int, n_universe: int) -> float:
    """The false-positive rate of the first level that makes the whole cascade smallest, about."""
    return min(0.5, max(2.0**-30, n_listed / (math.sqrt(2) * max(1, n_universe))))


def _salted(h: np.ndarray, depth: int) -> np.ndarray:
    """Other hashes at each level: a level's errors must not follow from the last one's."""
    x = h.view(np.uint64) + np.uint64(depth * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).view(np.int64)


def _in_cascade(levels: Sequence[Level], h: np.ndarray) -> np.ndarray:
    """Exact for every key of the universe: the depth of the first level that a key misses tells which."""
    out, left = np.zeros(len(h), bool), np.arange(len(h))
    for depth, level in enumerate(levels):
        hit = level.has(_salted(h[left], depth))
        out[left[~hit]] = depth % 2 == 1
        left = left[hit]
    out[left] = len(levels) % 2 == 1
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def build_cascade(listed: DataFrame, n_listed: int, universe: DataFrame, n_universe: int) -> list[Level]:
    """Levels for listed keys within a universe, both tables of hashes (h1, h2).

    The universe is read once: only what passes the first level, about n_listed / sqrt(2) keys more than the
    listed, is kept for the others.
    """
    if not n_listed:
        return []
    levels = [_level(listed, n_listed, _first_rate(n_listed, n_universe), 0)]

    def passed(df: DataFrame, depth: int, level: Level) -> DataFrame:
        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
                yield batch.filter(pa.array(level.has(_salted(h, depth))))

        return df.mapInArrow(only, "h1 long, h2 long")

    inside = listed
    wrong = checkpoint(passed(universe, 0, levels[0]).distinct().join(listed, ["h1", "h2"], "left_anti"))
    for depth in range(1, MOST_LEVELS):
        n = wrong.count()
        if not n:
            return levels
        levels.append(_level(wrong, n, 0.5, depth))
        inside, wrong = wrong, checkpoint(passed(inside, depth, levels[-1]))
    raise RuntimeError(f"the cascade has not ended after {MOST_LEVELS} levels")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict added; columns of pages with these names are replaced.

    rules: (rule, verdict), a host, then a path from the first ``/`` on, and ``allow`` or ``block``. A rule
    fits its host and all subdomains where the path starts with the rule's; the longest rule wins, and of the
    same rule listed under both verdicts ``allow``. Elsewhere rule is null and verdict is the default: the
    cascade finds no key listed. Null urls and urls without :// have empty host and path and fit no rule with
    a host. Rules that are null or have no ``/`` or another verdict are ignored; repeated ones count once.
    """
    spark = pages.sparkSession
    rules = rules.filter(F.col("rule").contains("/") & F.col("verdict").isin("allow", "block"))
    rules = rules.select(F.concat(lower_ascii(F.substring_index("rule", "/", 1)), F.expr("substr(rule, instr(rule, '/'))")).alias("rule"), "verdict")
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict"))  # allow sorts before block
    rule_host = F.substring_index("rule", "/", 1)
    shape = rules.agg(F.sort_array(F.collect_set(F.length("rule") - F.length(rule_host))).alias("lengths"), F.sort_array(F.collect_set(F.size(F.split(rule_host, r"\.")))).alias("depths")).first()
    # keys are made only as rules can be: of the labels and path lengths that some rule has
    lengths, depths = (F.lit(x) if x else F.array().cast("array<int>") for x in (shape["lengths"], shape["depths"]))
    host, path = url_parts(F.col(url_col))
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(depths, lambda d: d <= F.size(labels)), lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    base = base.withColumn("__keys", keys)
    universe = base.select(F.explode("__keys").alias("key")).select(*_hashes(F.col("key")))
    n_universe = base.agg(F.sum(F.size("__keys"))).first()[0] or 0
    counts = {r["verdict"]: r["count"] for r in rules.groupBy("verdict").count().collect()}
    sizes = sum(_shape(n, _first_rate(n, n_universe))[0] / 8 + 2 * n for n in counts.values())
    if sizes > most_bytes:
        return _in_parts(base, rules, default, sum(counts.values()), n_universe)
    cascades = {v: build_cascade(rules.filter(F.col("verdict") == v).select(*_hashes(F.col("rule"))), n, universe, n_universe) for v, n in counts.items()}
    sent = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("struct<i: int, verdict: string>")
    def judge(h1, h2, size):
        import pandas as pd

        n = np.fromiter((len(x) for x in h1), np.int64, len(h1))
        h = np.stack([np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in (h1, h2)], axis=1)
        long = np.concatenate([*size, np.zeros(0, np.int64)]).astype(np.int64)
        row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best, which, verdict = np.full(len(n), -1, np.int64), np.full(len(n), -1, np.int64), np.full(len(n), None, object)
        for v, levels in sorted(sent.value.items()):  # allow first: it keeps a tie
            hit = np.flatnonzero(_in_cascade(levels, h)) if levels else np.zeros(0, np.int64)
            for k in hit.tolist():
                if long[k] > best[row[k]]:
                    best[row[k]], which[row[k]], verdict[row[k]] = long[k], place[k], v
        return pd.DataFrame({"i": which.astype(np.int32), "verdict": verdict})

    hashed = [F.transform("__keys", lambda k: F.xxhash64(k)), F.transform("__keys", lambda k: F.xxhash64(F.lit("second"), k)), F.transform("__keys", lambda k: F.length(k).cast("long"))]
    out = base.withColumn("__found", judge(*hashed))
    found = F.when(F.col("__found.i") >= 0, F.get("__keys", F.col("__found.i")))
    return out.withColumns({"rule": found, "verdict": F.coalesce(F.col("__found.verdict"), F.lit(default))}).drop("__keys", "__found")


def _in_parts(base: DataFrame, rules: DataFrame, default: str, n_rules: int, n_keys: int) -> DataFrame:
    """The way for cascades too large to broadcast. Keys and rules are dealt by key hash into parts of bounded size; a part
    with many keys (a host that a third of the pages share) is cut further by page, and its rules go to each piece. Every
    piece builds the cascades of its rules over its own keys, which are its universe, and looks those keys up."""
    rows = checkpoint(base.withColumn("__row", F.monotonically_increasing_id()))  # row numbers must not change
    parts = max(1, -(-n_rules // PART_RULES))
    pieces = max(1, -(-n_keys // (parts * PART_KEYS)))
    part = F.pmod("h1", F.lit(parts)).alias("part")
    keys = rows.select("__row", F.posexplode("__keys").alias("place", "key")).select("__row", "place", F.length("key").alias("size"), *_hashes(F.col("key")))
    keys = keys.select(part, F.pmod(F.xxhash64("__row"), F.lit(pieces)).alias("piece"), "__row", "place", "size", "h1", "h2")
    listed = rules.select("verdict", *_hashes(F.col("rule"))).select(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"), "verdict", "h1", "h2")

    def judged(key, rules: pa.Table, keys: pa.Table) -> pa.Table:
        def hashes(t: pa.Table) -> np.ndarray:
            return np.stack([t.column(c).to_numpy() for c in ("h1", "h2")], axis=1) if t.num_rows else np.zeros((0, 2), np.int64)

        asked = hashes(keys)
        universe = np.unique(asked, axis=0) if len(asked) else asked
        out = []
        for verdict in ("allow", "block"):
            own = hashes(rules.filter(pa.array(np.array(rules.column("verdict").to_pylist(), object) == verdict, pa.bool_()))) if rules.num_rows else asked[:0]
            levels = _local_cascade(own, universe)
            hit = keys.filter(pa.array(_in_cascade(levels, asked))) if levels else keys.slice(0, 0)
            out.append(pa.table({"__row": hit.column("__row"), "place": hit.column("place"), "size": hit.column("size"), "verdict": pa.array([verdict] * hit.num_rows, pa.string())}))
        return pa.concat_tables(out)

    hits = listed.groupBy("part", "piece").cogroup(keys.groupBy("part", "piece")).applyInArrow(judged, "__row long, place int, size int, verdict string")
    best = hits.groupBy("__row").agg(F.max_by(F.struct("place", "verdict"), F.struct("size", F.col("verdict") == "allow")).alias("__best"))
    out = rows.join(best, "__row", "left")
    return out.withColumns({"rule": F.get("__keys", F.col("__best.place")), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))}).drop("__keys", "__row", "__best")
