"""Runs of periodic words by a dictionary of basic factors.

Factors are runs of 2**k words; level k gives equal factors of a text equal names, each level from pairs of the last.
At each level the next occurrence of a factor within twice its length is its successor. Where successors follow each
other at one distance, the occurrences are an arithmetic progression, and its difference is proposed as a period:
the place is extended both ways as far as words one period apart are equal, and runs that several levels or
progressions propose are kept once.

A run of period q and four periods holds, at the level whose factors are q to 2q - 1 words long, three occurrences q
apart of its first factor, none nearer, as its period is the smallest; so every run is proposed. Places whose factor
occurs once are left out of all higher levels: a longer factor there occurs once too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._factors import exact_ids, named
from ._words import Words, word_slices

#: The least words of a run, and the least periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def proposals(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of progressions of three or more successors, one for each stretch of neighbouring places."""
    at = np.arange(len(ids))
    names = named(text, ids)
    none = np.zeros(0, np.int64)
    found, size = [(none, none)], 1
    while len(at):
        order = np.argsort(names, kind="stable")  # equal factors of a text together, in the order of their places
        same = names[order][1:] == names[order][:-1]
        if not same.any():
            break
        gap = np.where(same, at[order][1:] - at[order][:-1], 0)  # to the next occurrence
        steady = np.flatnonzero((gap[:-1] == gap[1:]) & (gap[:-1] > 0) & (gap[:-1] <= 2 * size))
        place, period = at[order][:-2][steady], gap[:-1][steady]
        by = np.lexsort((place, period))
        place, period = place[by], period[by]
        first = np.ones(len(place), bool)
        first[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
        found.append((place[first], period[first]))
        # the next level: pairs of factors that each occur again, in one text
        again = np.zeros(len(names), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at, names = at[again], names[again]
        right = np.searchsorted(at, at + size)
        right[right == len(at)] = 0
        pair = at[right] == at + size
        pair &= text[at] == text[at[right]]
        at, names = at[pair], named(names[pair], names[right[pair]])
        size *= 2
    place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((place, period))
    return place[by], period[by]


def _equal_steps(ids: np.ndarray, at: int, period: int, step: int, end: int) -> int:
    """How many words from ``at`` on, forwards or backwards up to ``end``, equal the one a period later."""
    have, size = 0, 16
    left = (end - at) * step
    while have < left:
        n = min(size, left - have)
        lo = at + have if step > 0 else at - have - n + 1
        differ = ids[lo : lo + n] != ids[lo + period : lo + period + n]
        if differ.any():
            return have + int(differ.argmax() if step > 0 else differ[::-1].argmax())
        have, size = have + n, size * 2
    return have


def runs(ids: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of all runs, starts counted in the text; ordered by text, start, period."""
    out, period, end = [], -1, -1
    for place, q in zip(*(x.tolist() for x in proposals(ids, text)), strict=True):
        if q == period and place + q < end:
            continue  # in the run just extended
        t = int(text[place])
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        start = place - _equal_steps(ids, place - 1, q, -1, lo - 1)
        period, end = q, place + q + _equal_steps(ids, place, q, 1, hi - q)
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((t, start - lo, end - start, q))
    return np.array(sorted(out, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def _found(words: Words, rows: int, change: Callable[[int, int], np.ndarray | None]) -> tuple[list[tuple], list[list[tuple]], list[bytes]]:
    """Each text's summary, runs and text without the runs' repeats. change(row, words) gives the words to take
    instead, as numbers of words, or None."""
    bounds = np.searchsorted(words.text, np.arange(rows + 1))
    source = np.arange(len(words.text))
    for row in range(rows):
        lo, n = int(bounds[row]), int(bounds[row + 1] - bounds[row])
        other = change(row, n)
        if other is not None:
            source[lo : lo + n] = lo + other
    ids = exact_ids(words)[0][source]
    all_runs = runs(ids, words.text, bounds)
    cover = np.zeros(len(ids) + 1, np.int64)
    first = bounds[all_runs[:, 0]] + all_runs[:, 1]
    np.add.at(cover, first + all_runs[:, 3], 1)
    np.add.at(cover, first + all_runs[:, 2], -1)
    kept = np.cumsum(cover)[:-1] == 0
    cuts = np.searchsorted(all_runs[:, 0], np.arange(rows + 1))
    data = words.data.tobytes()
    start, end = words.start[source].tolist(), words.end[source].tolist()
    sums, lists, texts = [], [], []
    for row in range(rows):
        own = all_runs[cuts[row] : cuts[row + 1], 1:]
        best = max(own.tolist(), key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sums.append((len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None))
        lists.append([tuple(r) for r in own.tolist()])
        texts.append(b" ".join([data[start[i] : end[i]] for i in (bounds[row] + np.flatnonzero(kept[bounds[row] : bounds[row + 1]])).tolist()]))
    return sums, lists, texts


def planted(seed: int, n: int) -> np.ndarray | None:
    """The words to take in a text of n words with this seed: in a tenth of texts the tail repeats with one period."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def _scan(docs: DataFrame, id_col: str, text_col: str, plant: bool, names: list[str], types: str, row: Callable) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["id", *names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [zlib.crc32(s.encode()) for s in batch.column(2).to_pylist()] if plant else []
            for first, rows, words in word_slices(batch.column(1)):
                change = (lambda r, n: planted(seeds[first + r], n)) if plant else (lambda r, n: None)  # noqa: B023
                made = [row(*x) for x in zip(*_found(words, rows, change), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), out_types, strict=True))], fields)

    out_types = [_arrow(f.dataType) for f in T._parse_datatype_string(types).fields]
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _as_text(F.col(id_col)).alias("seed"))
    out = read.mapInArrow(scan, f"id {kind}, {types}")
    return out.withColumnRenamed("id", id_col)


def _as_text(ident: Column) -> Column:
    return F.coalesce(ident.cast("string"), F.lit(""))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


SUMMARY = ["n_runs", "start", "length", "period", "exponent_milli"]
SUMMARY_TYPES = "n_runs long, start long, length long, period long, exponent_milli long"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, n_runs, start, length, period, exponent_milli, runs, collapsed).

    Words are runs of characters other than ASCII white space. A run is a stretch of words with smallest period q, of
    at least max(LEAST_WORDS, LEAST_PERIODS * q) words, that no neighbour extends; start to exponent_milli are of the
    longest (ties: the first, then the smaller period), null where there is none. runs: all of them, (start, length,
    period), by start, then period. collapsed: the text's words, joined by one space, without those that a run holds
    after its first period. Null and empty texts have no words, no runs and an empty text; repeated rows and null ids
    are rows like any others; other columns are not read. A text is searched whole, by one task.
    """

    names = [*SUMMARY, "runs", "collapsed"]
    types = f"{SUMMARY_TYPES}, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def row(summary: tuple, own: list[tuple], text: bytes) -> tuple:
        return (*summary, [dict(zip(("start", "length", "period"), r, strict=True)) for r in own], text.decode())

    return _scan(docs, id_col, text_col, False, names, types, row)


def run_digests(docs: DataFrame, plant: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """periodic_runs with the digests of runs and of the collapsed text in place of both: (id, n_runs, start, length,
    period, exponent_milli, runs_sha256, collapsed_sha256).

    plant: make the tail of a tenth of the texts periodic first (``planted`` by the crc32 of the id as text; of an
    empty text for a null id), which gives a corpus known runs."""

    def row(summary: tuple, own: list[tuple], text: bytes) -> tuple:
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        return (*summary, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())

    return _scan(docs, id_col, text_col, plant, [*SUMMARY, "runs_sha256", "collapsed_sha256"], f"{SUMMARY_TYPES}, runs_sha256 string, collapsed_sha256 string", row)


def _crc_table() -> list[int]:
    def entry(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    return [entry(b) for b in range(256)]


def run_digests_sql(levels: int = 18, table: str = "documents") -> str:
    """DuckDB SQL for run_digests, for ids that are not null and occur once, and texts of under 2**(levels + 1) words:
    names of factors by doubling; a run of period q is a stretch of places whose factor of q to 2q - 1 words has its
    next occurrence q words on."""
    names = ["f0 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY word) AS name FROM v)"]
    for k in range(levels - 1):
        names.append(f"""
p{k} AS (SELECT doc_id, i, name, lead(name, {1 << k}) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM f{k}),
f{k + 1} AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY name, other) AS name FROM p{k} WHERE other IS NOT NULL)""")
    steps = " UNION ALL ".join(f"SELECT doc_id, i, {1 << k} AS size, lead(i) OVER (PARTITION BY doc_id, name ORDER BY i) - i AS q FROM f{k}" for k in range(levels))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, xor(list_reduce(
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM {table}),
cut AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS changed FROM w),
tail AS (SELECT *, CASE WHEN changed THEN g % n END AS a, CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM cut),
v0 AS (SELECT doc_id, words, a, p, unnest(range(n)) AS i FROM tail),
v AS (SELECT doc_id, i, words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM v0),
{",".join(names)},
steps AS ({steps}),
near AS (SELECT doc_id, i, size, q, i - row_number() OVER (PARTITION BY doc_id, size, q ORDER BY i) AS part FROM steps WHERE q <= size AND 2 * q > size),
runs AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + q + size AS length, q AS period FROM near GROUP BY doc_id, size, q, part
  HAVING max(i) - min(i) + q + size >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q)),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min([start, length, period], [-length, start, period]) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM v ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256 FROM w LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
