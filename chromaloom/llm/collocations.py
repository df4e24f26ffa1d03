"""Phrase collocations by weighted acyclic automata.

Each task counts the n-grams of its texts in shards of bounded size and builds, from the sorted n-grams, one weighted
automaton for each range of prefixes: the hash of a language and the first two words (of a single word: the hash of
both) decides the range. Automata of a range meet in one task, which makes their union and adds the weights. Paths
with a weight under the least count are then cut: a part of a phrase occurs at least as often as the phrase, so all
counts that a score needs are still there. Parts of a phrase lie in other ranges: each range sends an automaton of
the parts it asks for, which is composed with the range that has them, and the answers come back the same way.
A frequent first word is spread over many ranges, as ranges are cut by two words; a frequent phrase is one path.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, stored
from ._factors import exact_ids
from ._transducer import DEPTH, Transducer, build, composed, dump, kept, load, paths, union
from ._words import mixed, word_slices

#: The least count of a phrase; percent of a phrase's occurrences in a longer one at which it goes; phrases of a language.
LEAST, SHARE, TOP = 10, 50, 2000
#: Name of the null language; the score of a cut is SCALE * a * a / (l * r).
NO_LANG, SCALE = "und", 1_000_000
#: Bytes that part pieces, and all bytes that part words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Ranges for each shuffle partition.
RANGES_PER_PARTITION = 2

_GAPS, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAPS[list(BREAKS + b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(UPPER.encode())] = list(LOWER.encode())


def _hashes(vocab: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 13) for w in vocab], np.uint64)


def _ranges(langs: np.ndarray, first: np.ndarray, second: np.ndarray | None, n: int) -> np.ndarray:
    """The prefix range of words, or of pairs of words, from the hashes of their parts."""
    h = mixed(langs + mixed(first))
    if second is not None:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + second)
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _counted(keys: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their counts, the number of each key; -1 where not whole)."""
    distinct, of, count = np.unique(keys[whole], return_inverse=True, return_counts=True)
    number = np.full(len(keys), -1, np.int64)
    number[whole] = of
    return distinct, count.astype(np.int64), number


def _with_names(words: list[bytes], names: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Sorted words with a few sorted names put in, and the places of the names and of the words."""
    at = [bisect.bisect_left(words, x) for x in names]
    new = [i == len(words) or words[i] != x for i, x in zip(at, names, strict=True)]
    before = np.cumsum([0, *new])
    place = np.arange(len(words)) + before[np.searchsorted(at, np.arange(len(words)), "right")]
    both, last = [], 0
    for i, x, n in zip(at, names, new, strict=True):
        both += [*words[last:i], x] if n else words[last:i]
        last = i
    return both + words[last:], np.array(at) + before[:-1], place


def _shard(langs: list[bytes], column: pa.Array, n_ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, automaton) of the n-grams of some texts, in shards of one slice of words each."""
    names = sorted(set(langs))
    place = {w: i for i, w in enumerate(names)}
    of_text = np.array([place[x] for x in langs], np.int64)
    for first_text, rows, words in word_slices(column, _GAPS):
        if not len(words.start):
            continue
        words = type(words)(_LOWER[words.data], words.start, words.end, words.text, words.offsets)
        ids, first = exact_ids(words)
        listed = [words.data[words.start[i] : words.end[i]].tobytes() for i in first.tolist()]
        order = sorted(range(len(listed)), key=listed.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocab, ids = [listed[i] for i in order], rank[ids]
        size = len(vocab)
        breaks = np.cumsum(_BREAK[words.data], dtype=np.int32)[words.start].astype(np.int64)  # a word's first byte is no break
        piece = breaks + words.text  # of neighbouring words, equal only within one piece of one text
        near = np.append(piece[1:] == piece[:-1], False)
        lang = of_text[first_text + words.text]
        uni, f1, n1 = _counted(lang * size + ids, np.ones(len(ids), bool))
        pairs, f2, n2 = _counted(n1 * size + np.append(ids[1:], 0), near)
        triples, f3, _ = _counted(n2 * size + np.concatenate([ids[2:], np.zeros(min(2, len(ids)), np.int64)]), near & np.append(near[1:], False))
        hl, hv = _hashes(names), _hashes(vocab)
        lang1, w1 = uni // size, uni % size
        p2, w2 = pairs // size, pairs % size
        p3, w3 = triples // size, triples % size
        r1 = _ranges(hl[lang1], hv[w1], None, n_ranges)
        r2 = _ranges(hl[lang1[p2]], hv[w1[p2]], hv[w2], n_ranges)
        r3 = r2[p3]
        by1, by2, by3 = (np.argsort(r, kind="stable") for r in (r1, r2, r3))
        cut1, cut2, cut3 = (np.searchsorted(r[by], np.arange(n_ranges + 1)) for r, by in ((r1, by1), (r2, by2), (r3, by3)))
        for r in range(n_ranges):
            own, two, three = by1[cut1[r] : cut1[r + 1]], by2[cut2[r] : cut2[r + 1]], by3[cut3[r] : cut3[r + 1]]
            one = np.union1d(own, p2[two])
            if not len(one):
                continue
            weight = np.where(r1[one] == r, f1[one], 0)
            zero, at0 = np.unique(lang1[one], return_inverse=True)
            used = np.unique(np.concatenate([w1[one], w2[two], w3[three]]))
            mine, lang_label, to = _with_names([vocab[i] for i in used.tolist()], [names[i] for i in zero.tolist()])
            label = lambda w: to[np.searchsorted(used, w)]  # noqa: B023, E731
            yield r, dump(build(mine, [
                (np.zeros(len(zero), np.int64), lang_label, np.bincount(at0, weight, len(zero)).astype(np.int64)),
                (at0, label(w1[one]), weight),
                (np.searchsorted(one, p2[two]), label(w2[two]), f2[two]),
                (np.searchsorted(two, p3[three]), label(w3[three]), f3[three]),
            ]))


PARTS = "range int, source int, part binary"


def _part_rows(rows: list[tuple]) -> pa.Table:
    ranges, sources, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"range": pa.array(ranges, pa.int32()), "source": pa.array(sources, pa.int32()), "part": pa.array(blobs, pa.binary())})


def count_shards(docs: DataFrame, n_ranges: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs -> (range, source, part): automata of shards by prefix range; weights are counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, blob in _shard([x.encode() for x in batch.column(0).to_pylist()], batch.column(1), n_ranges):
                yield from _part_rows([(r, 0, blob)]).to_batches()

    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(count, PARTS)


def united(parts: DataFrame, least: int) -> DataFrame:
    """(range, source, part) -> one automaton for each range: the union of its parts, without paths under ``least``."""

    def unite(table: pa.Table) -> pa.Table:
        blobs = table.column("part").to_pylist()
        vocab, rows = union(map(load, blobs))
        return _part_rows([(table.column("range")[0].as_py(), 0, dump(build(*kept(vocab, rows, least))))])

    return parts.groupBy("range").applyInArrow(unite, PARTS)


def _asked(vocab: list[bytes], rows: list, n_ranges: int) -> list[tuple[int, bytes]]:
    """(range, automaton) of the parts that a range's phrases need from other ranges or its own. Single words have
    weight 0; the last two words of a phrase of three have the greatest count of such a phrase."""
    (_, lang, _), (p1, w1, _), (p2, w2, _), (p3, w3, f3) = rows
    size = max(1, len(vocab))
    lang_of1 = lang[p1] if len(p1) else lang[:0]
    lang2, lang3 = lang_of1[p2], lang_of1[p2][p3]
    first2 = w1[p2]
    single = np.unique(np.concatenate([lang2 * size + first2, lang2 * size + w2, lang3 * size + first2[p3], lang3 * size + w3]))
    key = (lang3 * size + w2[p3], w3)
    by = np.lexsort((key[1], key[0]))
    a, b, f = key[0][by], key[1][by], f3[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    most = np.maximum.reduceat(f, np.flatnonzero(new)) if len(f) else f
    a, b = a[new], b[new]
    h = _hashes(vocab)
    r1 = _ranges(h[single // size], h[single % size], None, n_ranges)
    r2 = _ranges(h[a // size], h[a % size], h[b], n_ranges)
    none = np.zeros(0, np.int64)
    out = []
    for r in np.unique(np.concatenate([r1, r2])).tolist():
        own, two = single[r1 == r], np.flatnonzero(r2 == r)
        one = np.union1d(own, a[two])
        zero, at0 = np.unique(one // size, return_inverse=True)
        tree = [
            (np.zeros(len(zero), np.int64), zero, np.zeros(len(zero), np.int64)),
            (at0, one % size, np.zeros(len(one), np.int64)),
            (np.searchsorted(one, a[two]), b[two], most[two]),
            (none, none, none),
        ]
        used = np.unique(np.concatenate([x[1] for x in tree]))
        tree = [(p, np.searchsorted(used, w), f) for p, w, f in tree]
        out.append((r, dump(build([vocab[i] for i in used.tolist()], tree))))
    return out


#: What a row of a range is: its own automaton, a question of another range, an answer, pairs that a longer phrase covers.
OWN, COVERED = -1, -2


def scored(ranges: DataFrame, n_ranges: int, share: int = SHARE) -> DataFrame:
    """Automata by range -> (lang, phrase, a, l, r, score) of all phrases that no longer phrase covers."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = load(row["part"])
                rows = [(r, row["range"], blob) for r, blob in _asked(t.vocab, paths(t), n_ranges)]
                yield from _part_rows(rows).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        own = [load(x["part"]) for x in table.to_pylist() if x["source"] == OWN]
        here = table.column("range")[0].as_py()
        vocab, rows = (own[0].vocab, paths(own[0])) if own else ([], [(np.zeros(0, np.int64),) * 3] * DEPTH)
        most = np.zeros(len(rows[2][0]), np.int64)  # of a longer phrase that holds a pair
        np.maximum.at(most, rows[3][0], rows[3][2])
        out = []
        for x in table.to_pylist():
            if x["source"] == OWN:
                continue
            asked = load(x["part"])
            tree, found = paths(asked), composed(asked, vocab, rows)
            at = found[2][1]
            np.maximum.at(most, at[at >= 0], tree[2][2][at >= 0])
            out.append((x["source"], here, dump(build(asked.vocab, [(p, w, f[0]) for (p, w, _), f in zip(tree, found, strict=True)]))))
        parent, label, weight = rows[2]
        covered = 100 * most >= share * weight
        none = np.zeros(0, np.int64)
        marks = [(rows[0][0], rows[0][1], rows[0][2] * 0), (rows[1][0], rows[1][1], rows[1][2] * 0), (parent[covered], label[covered], np.ones(int(covered.sum()), np.int64)), (none, none, none)]
        return _part_rows([*out, (here, COVERED, dump(build(vocab, marks)))])

    def score(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        own = [load(x["part"]) for x in parts if x["source"] == OWN]
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        if not own:
            return pa.table([pa.array([], k) for k in kinds], columns)
        t = own[0]
        tree = paths(t)
        (_, lang, _), (p1, w1, _), (p2, w2, f2), (p3, w3, f3) = tree
        vocab = t.vocab
        known_vocab, known = union(load(x["part"]) for x in parts if x["source"] >= 0)
        gone = composed(t, *_tree([load(x["part"]) for x in parts if x["source"] == COVERED]))[2][0] > 0
        lang2 = lang[p1][p2]
        places = _Counts(known_vocab, known, vocab)
        first, second = w1[p2], w2
        one, two = places.word(lang2, first), places.word(lang2, second)
        rows = []
        for i in np.flatnonzero(~gone).tolist():
            a, le, r = int(f2[i]), int(one[i]), int(two[i])
            rows.append((vocab[lang2[i]], vocab[first[i]] + b" " + vocab[second[i]], a, le, r, SCALE * a * a // (le * r)))
        last, rest = places.word(lang2[p3], w3), places.pair(lang2[p3], second[p3], w3)
        for i, p in enumerate(p3.tolist()):
            a = int(f3[i])
            cuts = [(SCALE * a * a // (le * r), k, le, r) for k, (le, r) in enumerate(((int(one[p]), int(rest[i])), (int(f2[p]), int(last[i]))))]
            s, _, le, r = min(cuts)
            rows.append((vocab[lang2[p]], b" ".join([vocab[first[p]], vocab[second[p]], vocab[w3[i]]]), a, le, r, s))
        made = zip(*rows, strict=True) if rows else [()] * 6
        return pa.table([pa.array([x.decode() for x in c] if k == pa.string() else c, k) for c, k in zip(made, kinds, strict=True)], columns)

    own = ranges.withColumn("source", F.lit(OWN))
    replies = own.union(ranges.mapInArrow(ask, PARTS)).groupBy("range").applyInArrow(answer, PARTS)
    return own.union(replies).groupBy("range").applyInArrow(score, "lang string, phrase string, a long, l long, r long, score long")


def _tree(parts: list[Transducer]) -> tuple[list[bytes], list]:
    return parts[0].vocab, paths(parts[0])


class _Counts:
    """Counts of words and pairs in a tree of answers, asked for by the labels of another vocabulary."""

    def __init__(self, vocab: list[bytes], rows: list, asked: list[bytes]) -> None:
        place = {w: i for i, w in enumerate(vocab)}
        self.to = np.array([place.get(w, -1) for w in asked], np.int64)
        self.size, self.rows = max(1, len(vocab)), rows

    def _find(self, level: int, parent: np.ndarray, label: np.ndarray) -> np.ndarray:
        have = self.rows[level][0] * self.size + self.rows[level][1]
        key = parent * self.size + self.to[label]
        at = np.searchsorted(have, key)
        if len(key) and (at.max(initial=0) >= len(have) or (have[at] != key).any()):
            raise RuntimeError("a part of a phrase has no count")
        return at

    def _word(self, lang: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._find(1, self._find(0, np.zeros(len(lang), np.int64), lang), word)

    def word(self, lang: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.rows[1][2][self._word(lang, word)]

    def pair(self, lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.rows[2][2][self._find(2, self._word(lang, first), second)]


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, n_ranges: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    Texts are lower-cased (A-Z) and cut into pieces at BREAKS, pieces into words at spaces and tabs. a is a phrase's
    count, l and r the counts of its parts at the cut with the lowest score, n the language's words. Phrases that
    occur under ``least`` times are none, nor those of which ``share`` percent lie in one longer phrase. Order: score
    and count, greatest first, then the phrase in byte order. A null language is NO_LANG, null and empty texts have no
    words, repeated rows count each, other columns are not read; no rows give none. n_ranges: prefix ranges, two for
    each shuffle partition by default.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(united(count_shards(docs, n_ranges, text_col, lang_col), least))

    def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                t = load(blob)
                _, label, weight = paths(t)[0]
                yield pa.RecordBatch.from_arrays([pa.array([t.vocab[i].decode() for i in label.tolist()], pa.string()), pa.array(weight, pa.int64())], ["lang", "n"])

    n = ranges.mapInArrow(languages, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = scored(ranges, n_ranges, share).withColumn("__part", F.pmod(F.hash("phrase"), F.lit(64)))
    first = found.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__place") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, share: int = SHARE, top: int = TOP, table: str = "documents") -> str:
    """DuckDB SQL for collocations."""
    return f"""
WITH t AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {table}),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS x FROM t),
p AS (SELECT lang, x, unnest(range(1, len(x) + 1)) AS i FROM w),
g1 AS (SELECT lang, x[i] AS w1, count(*) AS f FROM p GROUP BY ALL),
g2 AS (SELECT lang, x[i] AS w1, x[i + 1] AS w2, count(*) AS f FROM p WHERE i + 1 <= len(x) GROUP BY ALL),
g3 AS (SELECT lang, x[i] AS w1, x[i + 1] AS w2, x[i + 2] AS w3, count(*) AS f FROM p WHERE i + 2 <= len(x) GROUP BY ALL),
ns AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang),
c3 AS (SELECT * FROM g3 WHERE f >= {least}),
longer AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY ALL),
c2 AS (SELECT g2.* FROM g2 LEFT JOIN longer USING (lang, w1, w2) WHERE f >= {least} AND 100 * coalesce(most, 0) < {share} * f),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM c2 c JOIN g1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN g1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f FROM c3 c JOIN g1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN g2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f FROM c3 c JOIN g2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN g1 y ON y.lang = c.lang AND y.w1 = c.w3),
scores AS (SELECT *, ({SCALE}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM scores JOIN ns USING (lang) QUALIFY rank <= {top}"""
