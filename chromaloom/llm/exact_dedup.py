"""Exact dedup with a minimal perfect hash over historical distinct digests.

The historical digests are cut into shards by their first bytes; each shard has a minimal perfect hash whose
slots hold the full digest, the winner's locator (its id) and the number of copies. New digests are
pre-aggregated, looked up and compared byte by byte with the slot: members join the slot's group, all others
form groups of their own.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, lower_ascii, row_key, rows_that_stay

#: Distinct digests of a shard, about; the least number of shards keeps many tasks busy on small inputs.
SHARD_ROWS, LEAST_SHARDS = 50_000, 256
#: Room of each level of the hash, as slots for each key still to place.
ROOM = 2


def _mixed(key: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, another one at each level."""
    x = key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level, keys alone in their place take it and the
    others go on to the next; a key's slot is the rank of its place among all places taken."""

    def __init__(self, keys: np.ndarray):
        self.levels, self.n, left = [], len(keys), keys
        base = 0
        while len(left):
            room = max(64, ROOM * len(left))
            place = (_mixed(left, len(self.levels)) % np.uint64(room)).astype(np.int64)
            taken = np.bincount(place, minlength=room) == 1
            self.levels.append((room, taken, base + np.cumsum(taken) - taken))
            base += int(taken.sum())
            left = left[~taken[place]]

    def packed(self) -> list[dict]:
        """The levels as rows: their room, and which places are taken as bits."""
        return [{"room": room, "taken": np.packbits(taken).tobytes()} for room, taken, _ in self.levels]

    @classmethod
    def unpacked(cls, levels: list[dict]) -> PerfectHash:
        own, base = cls(np.zeros(0, np.uint64)), 0
        for x in levels:
            taken = np.unpackbits(np.frombuffer(x["taken"], np.uint8), count=x["room"]).astype(bool)
            own.levels.append((x["room"], taken, base + np.cumsum(taken) - taken))
            base += int(taken.sum())
        own.n = base
        return own

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that is not in the set any slot, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (room, taken, rank) in enumerate(self.levels):
            place = (_mixed(keys[open_], level) % np.uint64(room)).astype(np.int64)
            hit = taken[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        return out


def _digests(column: pa.Array) -> np.ndarray:
    """32-byte digests as an (n, 32) array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _keys(digests: np.ndarray, at: int) -> np.ndarray:
    return digests[:, at : at + 8].copy().view("<u8").ravel()


def _hashed(history: pa.Table) -> tuple[PerfectHash, int, pa.Table]:
    """(hash, byte at which a digest's key begins, the rows in the order of their slots)."""
    digests = _digests(_column(history, "digest"))
    for at in (8, 16, 24, 0):  # eight bytes of the digest are the key; others if two digests agree in them
        keys = _keys(digests, at)
        if len(np.unique(keys)) == len(keys):
            break
    else:
        raise ValueError("distinct digests that agree in every eight bytes")
    own = PerfectHash(keys)
    order = np.zeros(own.n, np.int64)
    order[own.slots(keys)] = np.arange(own.n)
    return own, at, history.select(["digest", "winner", "copies"]).take(pa.array(order))


def _looked_up(own: PerfectHash, at: int, slots: pa.Table, new: pa.Table) -> pa.Table:
    """All groups of a shard: slots with what new members add to them, and the new ones that are in no slot."""
    held, fresh = _digests(_column(slots, "digest")), _digests(_column(new, "digest"))
    slot = own.slots(_keys(fresh, at))
    member = slot >= 0
    member[member] = (held[slot[member]] == fresh[member]).all(axis=1)
    winner, copies = _column(slots, "winner").to_pylist(), _column(slots, "copies").to_numpy().copy()
    joined = new.filter(pa.array(member))
    for i, w, n in zip(slot[member].tolist(), joined.column("winner").to_pylist(), joined.column("copies").to_pylist(), strict=True):
        copies[i] += n
        if w is not None and (winner[i] is None or w > winner[i]):
            winner[i] = w
    merged = pa.table({"digest": slots.column("digest"), "winner": pa.array(winner, slots.schema.field("winner").type), "copies": pa.array(copies, pa.int64())})
    return pa.concat_tables([merged, new.filter(pa.array(~member)).select(["digest", "winner", "copies"])])


def _meet(key, history: pa.Table, new: pa.Table) -> pa.Table:
    """One shard: build the hash over history's digests, look the new ones up, return all groups."""
    return _looked_up(*_hashed(history), new)


def _summed(df: DataFrame, shards: int) -> DataFrame:
    """(id, digest) -> (digest, winner, copies, shard) of the distinct digests."""
    g = df.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("copies"))
    return g.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def _signed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, digest) of each row, and more columns."""
    digest = F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    return docs.select(F.col(id_col).alias("id"), digest.alias("digest"), *more)


def store_history(docs: DataFrame, path: str, shards: int = LEAST_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the perfect hash of docs' distinct digests as Parquet, a row for each shard: the levels of the hash, and in
    the order of the slots the full digests, their winners and copies. Take shards so that each has about SHARD_ROWS.

    No rows, null ids and texts, and repeated rows are as in exact_dedup. An existing table is an error."""

    def build(key, history):
        own, at, slots = _hashed(history)
        columns = {n: [_column(slots, n).to_pylist()] for n in ("digest", "winner", "copies")}
        kinds = {"digest": pa.list_(pa.binary()), "winner": pa.list_(history.schema.field("winner").type), "copies": pa.list_(pa.int64())}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "shards": pa.array([shards], pa.int32()), "at": pa.array([at], pa.int32()), "levels": pa.array([own.packed()], pa.list_(pa.struct([("room", pa.int64()), ("taken", pa.binary())])))} | {n: pa.array(columns[n], kinds[n]) for n in columns})

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"shard int, shards int, at int, levels array<struct<room: bigint, taken: binary>>, digest array<binary>, winner array<{kind}>, copies array<long>"
    _summed(_signed(docs, id_col, text_col), shards).groupBy("shard").applyInArrow(build, out).write.parquet(path)


def dedup_against(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """exact_dedup of docs against a stored history: the rows of docs alone, with the winners and sizes of groups that may
    begin in the history. A row of docs stays only if its id is larger than the history's; the history is not changed."""
    history = docs.sparkSession.read.parquet(path)
    shards = (history.agg(F.max("shards")).first()[0]) or LEAST_SHARDS
    sig = checkpoint(_signed(docs, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def meet(key, stored: pa.Table, new: pa.Table) -> pa.Table:
        kinds = {"digest": pa.binary(), "winner": new.schema.field("winner").type, "copies": pa.int64()}
        if not stored.num_rows:
            return new.select(["digest", "winner", "copies"])
        row = stored.to_pylist()[0]
        slots = pa.table({n: pa.array(row[n], k) for n, k in kinds.items()})
        return _looked_up(PerfectHash.unpacked(row["levels"]), row["at"], slots, new)

    groups = history.groupBy("shard").cogroup(_summed(sig, shards).groupBy("shard")).applyInArrow(meet, f"digest binary, winner {kind}, copies long")
    return _labelled(sig, groups, id_col)


def _labelled(sig: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    return sig.join(groups, "digest").select(
        F.col("id").alias(id_col),
        F.col("winner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.coalesce(F.col("id") == F.col("winner"), F.col("copies") == 1).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def groups_of(history: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, copies) of all groups, from two tables (id, digest). Distinct digests only reach a shard."""
    kind = history.schema["id"].dataType.simpleString()
    a, b = _summed(history, shards).groupBy("shard"), _summed(new, shards).groupBy("shard")
    return a.cogroup(b).applyInArrow(_meet, f"digest binary, winner {kind}, copies long")


def exact_dedup(docs: DataFrame, is_history: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact copies of whole texts, after lower-casing A-Z only: (id, keep_id, group_size, kept, text_sha256).

    One row for each input row. is_history marks the rows whose digests make the perfect hash (default: the
    lower half of the id range, or half of the rows by hash where ids are no whole numbers or all null); the result is the same whatever it marks. The largest id of equal texts
    stays; a null id never wins over another and where all are null, all of that group have kept false but
    for groups of one. A null text equals an empty one. Of repeated rows with the winning id, each has kept
    true. Other columns are not read.
    """
    sig = checkpoint(_signed(docs, id_col, text_col, *([is_history.alias("old")] if is_history is not None else [])))
    n, low, high = sig.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if is_history is None:
        half = F.col("id") <= F.lit(low + (high - low) // 2) if isinstance(low, int) else F.pmod(F.xxhash64("id", "digest"), F.lit(2)) == 0
        sig = sig.withColumn("old", half)
    old = F.coalesce(F.col("old"), F.lit(False))
    groups = groups_of(sig.filter(old), sig.filter(~old), max(LEAST_SHARDS, n // SHARD_ROWS))
    return _labelled(sig, groups, id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts: one that carries the winning id and the group's text.

    Rows are told apart by id and digest, so an id that stands on several texts loses the rows of those that it does
    not win; of rows that agree in both, one stays. A group of null ids alone keeps one row. Null, empty and long
    texts are as in exact_dedup; all columns are kept.
    """
    found = exact_dedup(docs, None, id_col, text_col)
    stay = found.filter(F.col("kept") | F.col("keep_id").isNull()).select(row_key(F.col(id_col), F.col("text_sha256")).alias("__stay")).distinct()
    digest = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    return rows_that_stay(docs, row_key(F.col(id_col), digest), stay)
