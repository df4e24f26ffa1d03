"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights; a term is a component. A block of candidates is inverted into
postings (term -> candidates and weights); a block of query rows scatters its weighted postings, one term at
a time, into a dense array of scores; each block then selects its best, and a merge ranks them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint

#: Candidates and queries that meet in one task, at most, and bytes of either as a matrix; and the part of them whose
#: scores are dense at once.
CANDIDATE_BLOCK, QUERY_BLOCK, BLOCK_BYTES, SCORE_ROWS, SCORE_QUERIES = 8192, 65536, 32 << 20, 1024, 256


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector or a component is null or not finite."""
    wide = vector.cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(table: pa.Table, terms: int) -> np.ndarray:
    """Integer weights (rows, terms); short vectors have zero weights at the end."""
    column = table.column("vec").combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), terms), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy()
    return out


def _scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Dense scores (rows, queries) of one block: each term's weighted postings are added in turn."""
    scores = np.zeros((rows, len(queries)), queries.dtype)
    part = np.empty_like(scores)
    for term, (ids, weights) in enumerate(postings):
        has = queries[:, term] != 0
        if not len(ids) or not has.any():
            continue
        if has.mean() > 0.5:  # mostly used terms: zero weights add nothing
            product = np.multiply.outer(weights, queries[:, term], out=part[: len(ids)])
            if len(ids) == rows:
                scores += product
            else:
                scores[ids] += product
        else:
            scores[np.ix_(ids, np.flatnonzero(has))] += np.multiply.outer(weights, queries[has, term])
    return scores


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of each query's k best, (queries, k): higher scores first, then smaller rows."""
    rows, by_query = len(scores), np.ascontiguousarray(scores.T)
    if scores.dtype == np.int32:  # score and row in one number, so that a partition keeps the tie rule
        both = by_query * np.int64(rows) + np.arange(rows - 1, -1, -1)
        both = np.partition(both, rows - k, axis=1)[:, rows - k :] if rows > k else both
        both = np.sort(both, axis=1)[:, ::-1]
        return rows - 1 - both % rows, both // rows
    order = np.argsort(-by_query, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(by_query, order, 1)


def _search(k: int):
    def block(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        if not candidates.num_rows or not queries.num_rows:
            return none
        terms = max(int(x.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for x in (candidates, queries))
        candidates = candidates.sort_by("id")
        ids, qids = candidates.column("id").to_numpy(), queries.column("id").to_numpy()
        c, q = _matrix(candidates, terms), _matrix(queries, terms)
        most = int(np.abs(c).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, terms)
        if most >= 2**63 - 1:
            raise ValueError("scores may pass 64 bits")
        kind = np.int32 if most < 2**31 - 1 else np.int64
        c, q, lowest = c.astype(kind), q.astype(kind), np.iinfo(kind).min + 1
        best_id, best_score = [np.zeros((len(qids), 0), np.int64)], [np.zeros((len(qids), 0), np.int64)]
        for at in range(0, len(ids), SCORE_ROWS):
            own = c[at : at + SCORE_ROWS]
            postings = [(hit := np.flatnonzero(own[:, t]), own[hit, t]) for t in range(terms)]
            found_id, found_score = [], []
            for first in range(0, len(qids), SCORE_QUERIES):
                asked = qids[first : first + SCORE_QUERIES]
                scores = _scores(q[first : first + SCORE_QUERIES], postings, len(own))
                same = np.searchsorted(ids[at : at + SCORE_ROWS], asked)
                while len(hit := np.flatnonzero((same < len(own)) & (ids[np.minimum(at + same, len(ids) - 1)] == asked))):
                    scores[same[hit], hit] = lowest  # the query's own row, and any that repeats its id
                    same[hit] += 1
                top, score = _best(scores, k)
                found_id.append(ids[at + top])
                found_score.append(score.astype(np.int64))
            best_id.append(np.concatenate(found_id))
            best_score.append(np.concatenate(found_score))
            if len(best_id) > 8 or at + SCORE_ROWS >= len(ids):
                all_id, all_score = np.concatenate(best_id, axis=1), np.concatenate(best_score, axis=1)
                order = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                best_id, best_score = [np.take_along_axis(all_id, order, 1)], [np.take_along_axis(all_score, order, 1)]
        keep = best_score[0] != lowest
        return pa.table({"query_id": np.broadcast_to(qids[:, None], keep.shape)[keep], "vec_id": best_id[0][keep], "score": best_score[0][keep]})

    return block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """Each query's k highest integer inner products: (query_id, rank, vec_id, score), all exact.

    vectors, queries: (id, array of whole numbers). Every row but those with the query's own id is a
    candidate; ties go to the smaller id; repeated candidate rows count each. A query id that is repeated is one
    query, with the least of its vectors. Rows with a null id or vector take no part; an empty vector scores zero, and
    a shorter one has zeros at its end. Weights whose products may pass 64 bits are an error. Other columns are not
    read. Queries and candidates meet in blocks whose bytes are bounded, so memory does not grow with either table.
    """
    wide = F.col(vec_col).cast("array<long>").alias("vec")
    c = vectors.select(F.col(id_col).cast("long").alias("id"), wide).dropna()
    q = queries.select(F.col(id_col).cast("long").alias("id"), wide).dropna().groupBy("id").agg(F.min("vec").alias("vec"))

    def blocks(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
        count, terms = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        n = max(1, -(-count // max(SCORE_QUERIES, min(most, BLOCK_BYTES // (8 * max(1, terms or 1))))))
        return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    c, n_c = blocks(c, CANDIDATE_BLOCK)
    q, n_q = blocks(q, QUERY_BLOCK)
    c = c.select("id", "vec", F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"))
    q = q.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), F.col("block").alias("q"))
    found = c.groupBy("c", "q").cogroup(q.groupBy("c", "q")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_table(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """top_k of quantised vectors, the queries being every row whose id is divisible by ``every``; no rows give none."""
    rows = checkpoint(embeddings.select(F.col(id_col).alias("vec_id"), quantised(F.col(vec_col), scale).alias("vec")).filter("vec is not null and vec_id is not null"))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
