"""SimHash near-duplicates with covering locality-sensitive hashing.

Covering LSH for radius r gives each of the 64 bit positions a nonzero vector of r + 1 bits; for each nonzero
v of r + 1 bits, the mask keeps the positions whose vector has an odd product with v. Any r positions have
some v that masks all of them out, so two fingerprints within the radius agree under at least one mask. No
pair is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint, row_key, rows_that_stay, text_bytes
from ._graph import component_roots

SEED = 42
#: Shingles hashed at once; bounds the memory of very long texts.
CHUNK = 1 << 16
#: Buckets above this are cut up by value blocks before members are compared.
BIG = 2048


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text; no words give zero."""
    words = text.lower().split()  # of bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[: len(words) - shingle + 1], ends[shingle - 1 :]
    del words
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        h = [digest(joined[s:e], SEED) for s, e in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, fp long) for each row; a null text is empty and has fingerprint zero. digest: sha256 of the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "digest", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).mapInArrow(of, f"id {kind}, digest binary, fp long")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def covering_masks(radius: int) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks, as signed 64-bit integers."""
    n = (1 << radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _near(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints of one bucket: each linked member with the least of its group.

    Walks each group from its first member, comparing with those not reached yet: links of m members are
    m - 1 rows at most, never all pairs.
    """
    out_a, out_b, left = [], [], values
    while len(left) > 1:
        seed, left = left[0], left[1:]
        group, queue = [seed], [seed]
        while queue and len(left):
            hit = np.bitwise_count(left ^ queue.pop()) <= radius
            if hit.any():
                found = left[hit]
                left = left[~hit]
                group.extend(found)
                queue.extend(found)
        if len(group) > 1:
            members = np.array(group, np.uint64).view(np.int64)
            least = members.min()
            members = members[members != least]
            out_a.append(members)
            out_b.append(np.full(len(members), least))
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _near_big(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As _near for a big bucket: of radius + 1 blocks of bits, linked members agree in one at least."""
    edges, parts = [], radius + 1
    for part in range(parts):
        low, high = 64 * part // parts, 64 * (part + 1) // parts
        key = (values >> np.uint64(low)) & np.uint64((1 << high - low) - 1)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        edges += [_near(run, radius) for run in np.split(values[order], cuts) if len(run) > 1]
    return (np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])) if edges else _near(values[:1], radius)


def _bucket_links(radius: int):
    """Sorted (k, fp) rows -> links; a bucket may span Arrow batches."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the open bucket, put together once

        def whole(more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            parts = [*tail, *more]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

        def close(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
            if len(k) < 2:
                return None
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            two = start[size == 2]
            near = np.bitwise_count(f[two] ^ f[two + 1]) <= radius
            x, y = f[two][near].view(np.int64), f[two + 1][near].view(np.int64)
            a, b = [np.maximum(x, y)], [np.minimum(x, y)]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                members = f[s : s + n]
                x, y = (_near_big if n > BIG else _near)(members, radius)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last bucket of a batch may go on in the next
            if cut or (tail and tail[0][0][0] != k[0]):
                if (done := close(*whole([(k[:cut], f[:cut])]))) is not None:
                    yield done
                tail = []
            tail.append((k[cut:], f[cut:]))
        if tail and (done := close(*whole([]))) is not None:
            yield done

    return links


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what pairs within the radius connect."""
    keys = [F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).alias("k"), F.col("fp")) for i, m in enumerate(covering_masks(radius))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("x")).select("x.k", "x.fp")
    dealt = rows.repartition("k").sortWithinPartitions("k", "fp")
    return dealt.mapInArrow(_bucket_links(radius), T.StructType([T.StructField(c, T.LongType()) for c in "ab"])).distinct()


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: (id, fingerprint, component_id).

    One row for each input row. fingerprint: 16 lower-case hex digits; component_id: the least id reachable
    over fingerprints that differ in at most radius bits. A null, empty or blank text has fingerprint zero,
    which links like any other. Equal fingerprints are one node, so copies cost nothing. Rows with a null id
    belong to groups but never name them (a group of null ids alone has a null component_id). Buckets have
    no cap. Other columns are not read.
    """
    sig = checkpoint(fingerprints(docs, shingle, id_col, text_col).select("id", "fp"))
    nodes = sig.groupBy("fp").agg(F.min("id").alias("least"))
    members = _members(nodes, radius)
    # tables of their own, so that the join of a hot root, and of a hot fingerprint below, can be split
    named = checkpoint(members.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = members.join(named, "root").select("fp", "component_id")
    known = checkpoint(nodes.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = sig.join(known, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(nodes: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp, ...) that have links, each with its component's root."""
    roots = component_roots(near_links(nodes.select("fp"), radius))
    members = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    return checkpoint(members.join(nodes, "fp"))


def drop_near_copies(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that with the least id (a null id comes last; of the same id on several
    texts the least digest; of rows that agree in both, one). All columns are kept.

    Groups are decided over distinct fingerprints, each with its best (id, digest): rows meet by those two alone."""
    sig = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    nodes = sig.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    nodes = checkpoint(nodes)
    members = _members(nodes, radius)
    grouped = members.groupBy("root").agg(F.min("best").alias("best")).select("best")
    alone = nodes.join(members.select("fp"), "fp", "left_anti").select("best")
    stay = checkpoint(grouped.union(alone).select(row_key(F.col("best.id"), F.lower(F.hex("best.digest"))).alias("__stay")))
    return rows_that_stay(docs, row_key(F.col(id_col), F.lower(F.hex(text_digest(F.col(text_col))))), stay)
