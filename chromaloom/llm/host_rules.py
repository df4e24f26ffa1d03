"""Host-level quality rules: failures of document rules are counted by host, their rates are shrunk with a beta prior
that is fitted to all hosts, and each host's verdict is joined back to its documents.

A small host with a few bad documents is pulled towards what hosts are like; a host fails when a shrunk rate reaches
the limit, and then all its documents go. Texts are read once; what is stored between the steps is a few numbers a
document. Counts are aggregated in each task before they meet, and hosts are one row each from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored
from ._factors import exact_ids, window_names
from ._words import Words, is_space, word_slices

#: Words of a repeated window, as a power of two; the least words of a text; percents of repeated words and of symbols.
WINDOW_DOUBLINGS, LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS = 3, 20, 30, 10
#: A host fails a rule at this shrunk rate; decimal places to which shrunk rates count.
MOST_RATE, PLACES = 0.5, 9
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
#: Rows up to which the table of failing hosts is broadcast; above, it is joined by host and salt.
MOST_BROADCAST, SALTS = 100_000, 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Document rules, each a failure: what base_failed joins, and one more that counts for hosts only.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeated": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * word_chars",
}


def _lines(words: Words, rows: int, offsets: np.ndarray) -> Words:
    """The lines of a slice's texts that have a word."""
    ends = np.flatnonzero(words.data == 10)
    start = np.unique(np.concatenate([ends + 1, offsets[:-1]]))
    start = start[start < len(words.data)]
    end = np.minimum(np.append(start[1:], len(words.data)), len(words.data))
    end = end - (words.data[end - 1] == 10)
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has], end[has]
    return Words(words.data, start, end, np.searchsorted(offsets, start, "right") - 1)


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks each text has."""
    total = np.append(np.int32(0), np.cumsum(marks, dtype=np.int32))
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(column: pa.Array) -> np.ndarray:
    """COUNTS of each text of an Arrow column, (texts, 5); nulls have none."""
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for first, rows, words in word_slices(column):
        here = out[first : first + rows]
        here[:, 0] = np.bincount(words.text, minlength=rows)
        offsets = words.offsets
        here[:, 1] = _sums(~is_space(words.data) & ((words.data & 0xC0) != 0x80), offsets)
        here[:, 2] = _sums(_SYMBOL[words.data], offsets)
        if not len(words.start):
            continue
        lines = _lines(words, rows, offsets)
        ids, _ = exact_ids(lines)
        distinct = np.unique((lines.text << np.int64(31)) | ids) >> np.int64(31)
        here[:, 3] = np.bincount(lines.text, minlength=rows) - np.bincount(distinct, minlength=rows)
        ids, _ = exact_ids(words)
        names = window_names(ids, words.text, WINDOW_DOUBLINGS)
        at = np.flatnonzero(names >= 0)
        again = at[np.bincount(names[at])[names[at]] > 1]
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + (1 << WINDOW_DOUBLINGS), -1)
        here[:, 4] = np.bincount(words.text[np.cumsum(cover)[:-1] > 0], minlength=rows)
    return out


def measured(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, host, the five counts), one row each; a null host is one host of its own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in counts.T)], ["id", "host", *COUNTS])

    named = F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), named.alias("host"), F.col(text_col).alias("text"))
    return read.mapInArrow(count, f"id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """(host, docs, a count of failures for each rule) -> the same with rate_<rule> columns.

    The prior is fitted by moments: with overall rate m and the weighted spread S of the hosts' rates about it, the
    correlation of two documents of a host is (S / (m (1 - m)) - (H - 1)) / (N - sum(n^2) / N - (H - 1)), and the
    prior's strength is its inverse less one. Rates of hosts that are all alike go to m; one host alone has m.
    """
    share = [F.sum(r).alias(f"all_{r}") for r in rules]
    total = hosts.agg(F.sum("docs").alias("all_docs"), F.count("*").cast("double").alias("n_hosts"), F.sum(F.col("docs").cast("double") * F.col("docs")).alias("squares"), *share)
    with_total = hosts.crossJoin(F.broadcast(total))  # one row
    mean = {r: F.col(f"all_{r}") / F.col("all_docs") for r in rules}
    spread = with_total.agg(*(F.sum(F.col("docs") * F.pow(F.col(r) / F.col("docs") - mean[r], 2)).alias(f"spread_{r}") for r in rules))
    rows = with_total.crossJoin(F.broadcast(spread))  # one row
    free = F.col("n_hosts") - 1
    room = F.col("all_docs") - F.col("squares") / F.col("all_docs") - free

    def rate(r: str) -> Column:
        noise = mean[r] * (1 - mean[r])
        alike = F.when((noise > 0) & (room > 0), (F.col(f"spread_{r}") / noise - free) / room).otherwise(0.0)
        bounded = F.greatest(F.lit(1 / (1 + MOST_STRENGTH)), F.least(alike, F.lit(1 / (1 + LEAST_STRENGTH))))
        strength = 1 / bounded - 1
        return F.round((F.col(r) + mean[r] * strength) / (F.col("docs") + strength), PLACES)

    return rows.select("host", "docs", *rules, *(rate(r).alias(f"rate_{r}") for r in rules))


def host_verdicts(counted: DataFrame, rules: dict[str, str] = RULES, most_rate: float = MOST_RATE) -> DataFrame:
    """Rows with a host and counts -> (host, docs, failures, rates, host_kept), one row for each host."""
    fails = [F.count_if(F.expr(e)).alias(r) for r, e in rules.items()]
    rates = shrunk_rates(counted.groupBy("host").agg(F.count("*").alias("docs"), *fails), list(rules))
    kept = F.lit(True)
    for r in rules:
        kept = kept & (F.col(f"rate_{r}") < most_rate)
    return rates.withColumn("host_kept", kept)


def host_rules(docs: DataFrame, host: Column | None = None, rules: dict[str, str] = RULES, base: tuple[str, ...] = ("short", "repeated"), most_rate: float = MOST_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    host: a column with each document's host or domain; default: its source. kept is false where the text fails a
    rule of ``base`` itself, or where its host's shrunk rate of any rule reaches most_rate. A null or empty text has
    no words and fails as short; a null host is one host of its own; repeated rows and null ids count like any others;
    other columns are not read.
    """
    counted = stored(measured(docs, F.col("source") if host is None else host, id_col, text_col))
    bad = host_verdicts(counted, rules, most_rate).filter("not host_kept").select(F.col("host").alias("__bad"))
    bad = stored(bad)
    failed = F.lit(False)
    for r in base:
        failed = failed | F.expr(rules[r])
    if bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        rows = counted.join(F.broadcast(bad), F.col("host") == F.col("__bad"), "left")
    else:  # many failing hosts: a hot host's rows are dealt over SALTS tasks, each of which has its verdict
        many = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = counted.withColumn("__dealt", F.pmod(F.xxhash64("id", *COUNTS), F.lit(SALTS)).cast("int"))
        rows = salted.join(many, (F.col("host") == F.col("__bad")) & (F.col("__dealt") == F.col("__salt")), "left")
    return rows.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & F.col("__bad").isNull()).alias("kept"))


def host_rules_sql(table: str = "documents", host: str = "source", most_rate: float = MOST_RATE) -> str:
    """DuckDB SQL for host_rules with its default rules, for ids that are not null and occur once."""
    size = 1 << WINDOW_DOUBLINGS
    rate = ", ".join(
        f"""round(({r} + all_{r} / all_docs * s_{r}) / (docs + s_{r}), {PLACES}) AS rate_{r}""" for r in RULES
    )
    strength = ", ".join(
        f"""1 / greatest(1 / {1 + MOST_STRENGTH}, least(CASE WHEN all_{r} BETWEEN 1 AND all_docs - 1 AND room > 0
      THEN (spread_{r} / (all_{r} / all_docs * (1 - all_{r} / all_docs)) - n_hosts + 1) / room ELSE 0 END, 1 / {1 + LEAST_STRENGTH})) - 1 AS s_{r}""" for r in RULES
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce('=' || {host}, '') AS host, coalesce(text, '') AS text FROM {table}),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS pos FROM w WHERE len(words) >= {size}),
hashed AS (SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + {size - 1}), ' ')) AS h FROM starts),
often AS (SELECT doc_id, pos FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS r FROM (SELECT doc_id, unnest(range(pos, pos + {size})) AS i FROM often) GROUP BY doc_id),
c AS (SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
hosts AS (SELECT host, count(*)::DOUBLE AS docs, {", ".join(f"count(*) FILTER ({e})::DOUBLE AS {r}" for r, e in RULES.items())} FROM c GROUP BY host),
total AS (SELECT sum(docs) AS all_docs, count(*)::DOUBLE AS n_hosts, sum(docs * docs) AS squares, {", ".join(f"sum({r}) AS all_{r}" for r in RULES)} FROM hosts),
spread AS (SELECT {", ".join(f"sum(docs * ({r} / docs - all_{r} / all_docs) ** 2) AS spread_{r}" for r in RULES)} FROM hosts, total),
prior AS (SELECT *, {strength} FROM (SELECT *, all_docs - squares / all_docs - n_hosts + 1 AS room FROM total, spread)),
rates AS (SELECT host, {rate} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b AS base_failed, NOT b AND {" AND ".join(f"rate_{r} < {most_rate}" for r in RULES)} AS kept
FROM (SELECT *, {RULES["short"]} OR {RULES["repeated"]} AS b FROM c) JOIN rates USING (host)"""
