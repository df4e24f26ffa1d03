"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most a sequence's length. Pieces are dealt evenly into shards of about
SHARD_PIECES; several islands evolve packings of each shard, from packings in random order. Crossover injects
whole well-filled bins of one parent into the other, drops the bins that hold the same pieces, and best-fits the
displaced ones. Between epochs each island's elite migrates to the next island of its shard. The bins that a
shard leaves open meet those of other shards and evolve again, until one shard holds all that are open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint
from ._words import Words

CAPACITY, END_ID = 4096, 1
SHARD_PIECES, ISLANDS, EPOCHS = 2048, 2, 2
#: Individuals of an island, generations of an epoch, and those it runs even if no packing can have fewer bins.
POPULATION, GENERATIONS, LEAST_GENERATIONS = 6, 8, 3
#: Generations of few pieces, at most.
MOST_GENERATIONS = 300
#: A bin filled less is open: it meets other shards' open bins. Rounds in which they do, at most.
FULL, ROUNDS = 0.98, 3
#: Islands of a task, about, and tasks at most.
ISLANDS_A_TASK, MOST_TASKS = 4, 20_000
#: Parts of texts that a Python worker remembers (about 100 MB at most), and the longest of them.
KEEP_PARTS, KEEP_LEN = 1 << 19, 48
#: Characters of text that are cut at once, and parts that one call tokenises.
SLICE_CHARS, TOGETHER = 1 << 20, 4096

#: Classes of lower-cased Latin-1 characters: 0 white space, 1 letter, 2 number, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E), 0x85, 0xA0]] = 0
_CLASS[[i for i in range(256) if chr(i).isalpha()]] = 1
_CLASS[[*b"0123456789", 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2


def part_borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the parts that the vocabulary's pattern cuts lower-cased Latin-1 text into:
    runs of letters, single numbers, runs of other characters, and 's 't 'm 'd 're 've 'll where an apostrophe stands
    alone before letters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.concatenate([_CLASS[data], np.zeros(3, np.uint8)])
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    start = np.zeros(n + 3, bool)
    start[:n] = kind[:n] > 0
    start[1:n] &= (kind[1:n] != kind[: n - 1]) | (kind[1:n] == 2)
    i = np.flatnonzero(start[:n] & (data[:n] == 0x27) & (kind[1 : n + 1] == 1))
    one, two = data[i + 1], data[i + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, size in ((i[short], 2), (i[long & ~short], 3)):
        start[hit + 1] = False
        start[hit + size] |= kind[hit + size] == 1
    first = np.flatnonzero(start[:n])
    border = np.append(np.flatnonzero(start[:n] | (kind[:n] == 0)), n)
    return first, border[np.searchsorted(border, first, "right")]


class TextIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes. No token spans two parts of a text, so the
    distinct parts of a slice of texts (found by a hash, then compared byte by byte) are tokenised once and put
    together again."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a part
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, by few calls: a part's last token says that it is one."""
        out = []
        for at in range(0, len(parts), TOGETHER):
            own = parts[at : at + TOGETHER]
            ids = self.ids(" ".join(own))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own):
                raw = ids.tobytes()
                out += [raw[4 * s : 4 * e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += [self.ids(p).tobytes() for p in own]
        return out

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts."""
        data = np.frombuffer(b" ".join(texts), np.uint8)
        text_end = np.cumsum([len(t) + 1 for t in texts])
        first, end = part_borders(data)
        words = Words(data, first, end, first)
        _, where, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if not words.equal(where[inverse]):  # two parts share a hash
            return [self.ids(t.decode("latin-1")).tobytes() for t in texts]
        if len(self.known) >= KEEP_PARTS:
            self.known.clear()
        parts = [data[s:e].tobytes() for s, e in zip(first[where].tolist(), end[where].tolist(), strict=True)]
        new = [p for p in parts if p not in self.known]
        here = dict(zip(new, self.encoded([p.decode("latin-1") for p in new]), strict=True))
        self.known.update((p, x) for p, x in here.items() if len(p) <= KEEP_LEN)
        own = [here[p] if p in here else self.known[p] for p in parts]
        flat, size = np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int64)
        n = size[inverse]
        upto = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[inverse] - (upto - n), n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], upto])[np.searchsorted(first, text_end)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def texts_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as the tokenizer gives them. Texts with other than Latin-1 characters, which may need
        normalising, or with special strings in them go to it whole."""
        plain = [i for i, t in enumerate(texts) if _is_latin(t) and not any(s in t for s in self.special)]
        done = dict(zip(plain, self._latin([texts[i].lower().encode("latin-1") for i in plain]) if plain else [], strict=True))
        return [done[i] if i in done else self.ids(t).tobytes() for i, t in enumerate(texts)]

    def text_ids(self, text: str) -> bytes:
        return self.texts_ids([text])[0]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _slices(texts: Iterator[str], most: int) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters."""
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


@cache
def word_ids(path: str) -> TextIds:
    """One table of parts for each vocabulary file in a Python worker."""
    return TextIds(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and an end id, cut into pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = (t.as_py() or "" for t in batch.column(1))
            for i, raw in enumerate(ids for part in _slices(texts, SLICE_CHARS) for ids in own.texts_ids(part)):
                ids = memoryview(raw + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], order: list[int], bins: np.ndarray, room: list[int], capacity: int) -> list[int]:
    """Put the pieces of ``order`` where they leave the least room: bins (piece -> bin) and room are changed."""
    by_room: dict[int, list[int]] = {}
    free = 0  # bit r: some bin has r left
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            free |= 1 << r
    for i in order:
        n = lengths[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(0)
        room[b] = r = r - n
        bins[i] = b
        if r:
            by_room.setdefault(r, []).append(b)
            free |= 1 << r
    return room


class Packing:
    """One individual: the bin of each piece. Better: fewer bins, then fuller ones (mean square of the fill)."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.bins = np.unique(bins, return_inverse=True)[1]
        self.fill = np.bincount(self.bins, weights=lengths).astype(np.int64)
        self.worth = (-len(self.fill), float(((self.fill / capacity) ** 2).mean()) if len(self.fill) else 0.0)


def crossover(a: Packing, b: Packing, lengths: np.ndarray, plain: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Inject well-filled bins of a into b, drop b's bins that hold the same pieces, best-fit the displaced."""
    full = np.argsort(-a.fill, kind="stable")[: max(1, len(a.fill) * 3 // 4)]
    chosen = full[rng.random(len(full)) < rng.uniform(0.2, 0.8)]
    injected = np.isin(a.bins, chosen)
    dropped = np.isin(b.bins, np.unique(b.bins[injected]))
    bins = np.where(injected, a.bins + len(b.fill), b.bins)
    displaced = np.flatnonzero(dropped & ~injected)
    bins[displaced] = -1
    kept, new = np.unique(bins, return_inverse=True)
    new = new - (len(kept) > 0 and kept[0] == -1)
    room = (capacity - np.bincount(new[new >= 0], weights=lengths[new >= 0]).astype(np.int64)).tolist() if (new >= 0).any() else []
    best_fit(plain, displaced[np.argsort(-lengths[displaced], kind="stable")].tolist(), new, room, capacity)
    return Packing(lengths, new, capacity)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, generations: int | None = None, least: int = LEAST_GENERATIONS) -> tuple[np.ndarray, int]:
    """(bins of the best packing, crossovers) of one island. It begins with the elites given and packings in random
    order, and stops early only after ``least`` generations and where no packing can have fewer bins. Individuals of
    equal worth make room for new ones in random order; few pieces, which cost little, get more generations."""
    rng, plain = np.random.default_rng(seed), lengths.tolist()
    bound = -(-int(lengths.sum()) // capacity)
    own = [Packing(lengths, e, capacity) for e in elites]
    crossed = 0
    for generation in range(generations or max(GENERATIONS, min(MOST_GENERATIONS, GENERATIONS * SHARD_PIECES // max(1, len(lengths))))):
        own = list({p.worth: p for p in sorted(own, key=lambda p: p.worth, reverse=True)[:population]}.values())
        while len(own) < population:
            bins = np.zeros(len(lengths), np.int64)
            best_fit(plain, rng.permutation(len(lengths)).tolist(), bins, [], capacity)
            own.append(Packing(lengths, bins, capacity))
        own.sort(key=lambda p: p.worth, reverse=True)
        if len(own[0].fill) < 2 or generation >= least and len(own[0].fill) == bound:
            break
        pairs = [sorted(rng.choice(population, 2, replace=False).tolist()) for _ in range(population)]
        own += [crossover(own[i], own[j], lengths, plain, capacity, rng) for i, j in pairs]
        crossed += population
    return max(own, key=lambda p: p.worth).bins, crossed


_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("epoch", pa.int32()), ("lengths", pa.list_(pa.int64())), ("elite", pa.list_(pa.int64())), ("n_bins", pa.int64()), ("crossovers", pa.int64())])


def _epoch(capacity: int):
    """(shard, island, epoch, lengths, elite, migrant) -> _STATE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                elites = [np.array(r[c], np.int64) for c in ("elite", "migrant") if r[c] is not None]
                best, crossed = evolve(lengths, elites, capacity, (r["shard"] * 31 + r["island"]) * 31 + r["epoch"])
                rows.append({n: r[n] for n in ("shard", "island", "epoch", "lengths")} | {"elite": best.tolist(), "n_bins": int(best.max()) + 1, "crossovers": crossed})
            yield pa.RecordBatch.from_pylist(rows, _STATE)

    return run


def _evolved(held: DataFrame, n: int, capacity: int, islands: int, epochs: int) -> list[DataFrame]:
    """n shards (shard, items with length and seq, the piece's bin so far or null) -> each epoch's islands (_STATE)."""
    tasks = max(1, min(MOST_TASKS, -(-n * islands // ISLANDS_A_TASK)))  # islands are small and slow: not to be merged
    state = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("lengths"), F.when(F.forall("items.__seq", lambda x: x.isNotNull()), F.col("items.__seq")).alias("elite"))
    state = state.withColumn("migrant", F.lit(None).cast("array<long>"))
    out, done = "shard long, island int, epoch int, lengths array<long>, elite array<long>, n_bins long, crossovers long", []
    for epoch in range(epochs):
        asked = state.select("shard", "island", F.lit(epoch).alias("epoch"), "lengths", "elite", "migrant").repartition(tasks, "shard", "island")
        done.append(checkpoint(asked.mapInArrow(_epoch(capacity), out)))
        moved = done[-1].select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
        state = done[-1].join(moved, ["shard", "island"])
    return done


def _placed(columns: list[str]):
    """(items, elite, shard) -> the items' columns, and each piece's bin, offset and the bin's fill."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["shard", "elite"]).to_pylist()):
                items = batch.column("items")[i].values
                length, bins = items.field("length").to_numpy(), np.array(r["elite"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(length[order])
                first = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
                begun = np.repeat((ends - length[order])[first], np.diff(np.r_[first, len(order)]))
                offset = np.zeros(len(order), np.int64)
                offset[order] = ends - length[order] - begun
                fill = np.bincount(bins, weights=length).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(items.field(c) for c in columns), pa.array((r["shard"] << 24) + bins), pa.array(offset), pa.array(fill[bins])], [*columns, "__seq", "__offset", "__fill"])

    return place


def _dealt(rows: DataFrame, shard, columns: list[str]) -> DataFrame:
    """Rows grouped into shards, the longest pieces first."""
    own = rows.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(F.struct(F.col("length").alias("__by"), *columns, "__seq")), asc=False).alias("items"))
    return checkpoint(own)


def _numbered(pieces: DataFrame, shard_pieces: int) -> tuple[DataFrame, int]:
    """Checkpointed pieces as rows without a bin, in shards by row number: equal rows are spread like any others."""
    n = max(1, -(-pieces.count() // shard_pieces))
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    return _dealt(pieces.withColumn("__seq", F.lit(None).cast("long")), row, pieces.columns), n


def packing_history(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(epoch, shard, island, n_pieces, crossovers, n_bins) of the first round that pack_pieces runs."""
    held, n = _numbered(checkpoint(pieces), shard_pieces)
    done = _evolved(held, n, capacity, islands, epochs)
    return reduce(DataFrame.union, done).select("epoch", "shard", "island", F.size("lengths").alias("n_pieces"), "crossovers", "n_bins")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """Checkpointed pieces (with a length column) plus sequence_id and offset. No sequence is longer than the
    capacity. Equal rows are separate pieces; no rows give no rows."""
    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", __seq long, __offset long, __fill long"
    held, n = _numbered(pieces, shard_pieces)
    closed = []
    for again in range(rounds):
        best = _evolved(held, n, capacity, islands, epochs)[-1].groupBy("shard").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))
        placed = checkpoint(held.join(best, "shard").mapInArrow(_placed(columns), schema))
        done = placed.select(*columns, ((F.lit(again).cast("long") * (1 << 60)) + F.col("__seq")).alias("sequence_id"), F.col("__offset").alias("offset"), "__fill")
        left = placed.filter(F.col("__fill") < int(FULL * capacity))
        last = again + 1 == rounds or n == 1
        closed.append((done if last else done.filter(F.col("__fill") >= int(FULL * capacity))).drop("__fill"))
        if last:
            break
        n = max(1, -(-left.count() // shard_pieces))
        # whole bins move on, so that what they were is one of the packings that evolve
        held = _dealt(left, F.pmod(F.xxhash64("__seq"), F.lit(n)), columns)
    return reduce(DataFrame.unionByName, closed)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces of whole texts: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is the end id alone. Only documents above the capacity are cut. Rows with a null or
    repeated id are packed like any other. Other columns are not read.
    """
    pieces = checkpoint(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col))
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)
