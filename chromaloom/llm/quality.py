"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its hashed words, the hashed pieces of its words, and the gaps at which its words recur;
frequencies are square-rooted and weighted by inverse document frequency. A truncated singular value decomposition
of the labelled texts gives the latent axes. The labelled vectors, a bounded number, are broadcast; every document
is compared with all of them in blocks by exact cosine products, and its nearest neighbours vote by similarity. A
labelled text that equals the document's does not vote, so that no label is an input of its own document's score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_bytes
from ._words import Words, word_slices

#: Hashed words, hashed pieces of PIECE bytes, and gaps between a word and its next copy (1, 2, 3-4, 5-8, ... words).
WORDS, PIECES, GAPS, PIECE = 1024, 1024, 16, 4
TERMS = WORDS + PIECES + GAPS
#: Latent axes; neighbours that vote; power of a similarity in its vote; decimal places to which similarities count.
AXES, NEIGHBOURS, SHARPNESS, PLACES = 64, 15, 8, 5
#: Labelled texts of each class that the fit takes at most: the bound of what is collected and broadcast.
PER_CLASS = 2048
#: Documents compared at once.
BLOCK = 512


def term_vectors(column: pa.Array) -> np.ndarray:
    """Square roots of term frequencies, (texts, TERMS); zero for texts without words. Words are runs of bytes other
    than ASCII white space, all of them. Call it with BLOCK texts or so."""
    out = np.zeros((len(column), TERMS), np.float32)
    for first, rows, words in word_slices(column):
        size, h = words.end - words.start, words.hashes()
        parts = -(-size // PIECE)
        word = np.repeat(np.arange(len(size)), parts)
        start = words.start[word] + PIECE * (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts))
        pieces = Words(words.data, start, np.minimum(start + PIECE, words.end[word]), words.text[word])
        order = np.lexsort((h, words.text))  # stable: copies of a word in one text, in their order
        copy = (h[order][1:] == h[order][:-1]) & (words.text[order][1:] == words.text[order][:-1])
        gap = np.minimum(np.ceil(np.log2((order[1:] - order[:-1])[copy])), GAPS - 1).astype(np.int64)
        n_words, n_pieces = (np.maximum(np.bincount(w.text, minlength=rows), 1)[:, None] for w in (words, pieces))
        at = 0
        for text, term, terms, n in (
            (words.text, (h >> np.uint64(40)).astype(np.int64) % WORDS, WORDS, n_words),
            (pieces.text, (pieces.hashes() >> np.uint64(40)).astype(np.int64) % PIECES, PIECES, n_pieces),
            (words.text[order[1:][copy]], gap, GAPS, n_words),
        ):
            out[first : first + rows, at : at + terms] = np.bincount(text * terms + term, minlength=rows * terms).reshape(rows, terms) / n
            at += terms
    return np.sqrt(out)


def _block_vectors(column: pa.Array) -> Iterator[np.ndarray]:
    for at in range(0, len(column), BLOCK):
        yield term_vectors(column.slice(at, BLOCK))


def text_digests(column: pa.Array) -> list[bytes]:
    """By which equal texts are told; null is empty."""
    return [hashlib.blake2b(t, digest_size=16).digest() for t in text_bytes(column)]


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # (terms,)
    axes: np.ndarray  # (terms, axes)
    vectors: np.ndarray  # (labelled, axes), of length 1
    labels: np.ndarray  # 0 or 1, both in the order of the ids
    weights: np.ndarray  # of a vote: the class's share of all labels over its share of the vectors
    texts: dict[bytes, list[int]] = field(default_factory=dict)  # rows of the vectors by their text's digest

    def latent(self, terms: np.ndarray) -> np.ndarray:
        v = (terms * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours with other texts; 0 for texts without terms."""
        terms = term_vectors(column)
        if not len(self.labels):
            return np.zeros(len(terms))
        near = self.latent(terms) @ self.vectors.T
        for i, digest in enumerate(text_digests(column)):
            near[i, self.texts.get(digest, [])] = -2
        n = near.shape[1]
        k = min(NEIGHBOURS, n)
        # similarity and row in one number: of equal similarities the labelled text with the smaller id counts
        both = np.rint(near * 10.0**PLACES).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        top = n - 1 - np.partition(both, n - k, axis=1)[:, n - k :] % n
        top.sort(axis=1)
        vote = np.maximum(np.round(np.take_along_axis(near, top, 1).astype(np.float64), PLACES), 0) ** SHARPNESS * self.weights[top]
        total = vote.sum(axis=1)
        score = np.where(total > 0, (vote * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300), 0)
        return np.where(terms.any(axis=1), np.clip(score, 0, 1), 0)


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; of an empty text for a null id."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows outside the held-out fold: of each class the per_class with the least md5(id).

    Of an id labelled twice the lower label counts, of one with several texts the least text; null labels and ids are
    ignored. The shares of the classes come from all labels of the training folds.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(F.col(id_col)) != 2))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == c).orderBy(F.md5(F.col("id").cast("string")), "id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # 2 * per_class rows at most
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = read.schema["id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for block in _block_vectors(batch.column(2)) for r in block.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary()), pa.array(text_digests(batch.column(2)), pa.binary())], ["id", "label", "terms", "text"])

    got = read.mapInArrow(terms, f"id {kind}, label int, terms binary, text binary").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = got.column("label").to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(got.column("terms").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    keep = x.any(axis=1)
    x, y = x[keep], y[keep]
    texts: dict[bytes, list[int]] = {}
    for i, digest in enumerate(d for d, k in zip(got.column("text").to_pylist(), keep.tolist(), strict=True) if k):
        texts.setdefault(digest, []).append(i)
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, y)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    axes = _leading_axes(x * idf, AXES)
    raw = Model(idf, axes, np.zeros((0, 1), np.float32), y, y)
    total = sum(share.values())
    weights = np.array([share.get(int(c), 0) / total / max(1, (y == c).sum()) for c in (0, 1)])[y.astype(int)]
    return Model(idf, axes, raw.latent(x).astype(np.float32), y, weights / weights.max(), texts)


def _leading_axes(x: np.ndarray, n: int) -> np.ndarray:
    """Right singular vectors of the n largest singular values, by subspace iteration from a fixed start."""
    n = min(n, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(n + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    small = np.linalg.svd(x @ q, full_matrices=False)[2]
    return (q @ small.T)[:, :n].astype(np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Scores of whole texts: (id, held_out, score, predicted), one row for each input row.

    Only the text is scored, and labelled texts equal to it do not vote. Null, empty and blank texts score 0; without any labelled text all score 0. Of labelled
    texts that are equally near, those with smaller ids vote. Repeated rows score alike. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, id_col, text_col, label_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sent.value.scores(own.column(1)), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (fold_of(F.col("id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that quality_scores gives the threshold or more, all columns kept, and as many of equal rows as
    there are; rows are scored where they are read. Null and empty texts go (unless the threshold is 0); without labels
    all rows score 0; a null id has no label."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, id_col, text_col, label_col))
    place = docs.columns.index(text_col)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                yield own.filter(pa.array(sent.value.scores(own.column(place)) >= threshold))

    return docs.mapInArrow(only, docs.schema)
