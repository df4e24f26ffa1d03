"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; each pre-token's bytes form a linked list of symbols, and a heap holds the
adjacent pairs by merge rank. The lowest-rank pair is popped and merged again and again; the count is the
initial symbols minus the merges, and no identifiers are emitted.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published pre-token pattern of byte-level BPE.
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern for texts of Latin-1 characters only, with the classes spelled out: letters, numbers, white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pre-tokens of at most KEEP_LEN characters are remembered, up to KEEP_MANY of them in one Python worker.
KEEP_LEN, KEEP_MANY = 48, 1 << 19
#: Longer texts are walked token by token and never held as one list of tokens.
LONG_TEXT = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, as byte-level BPE files spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class MergeCounter(dict):
    """Pre-token -> its number of tokens. A missing pre-token is merged and, if short, remembered."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        ids = model["vocab"]
        self.symbol = [0] * 256
        for char, byte in _byte_alphabet().items():
            self.symbol[byte] = ids[char]
        self.width = max(ids.values()) + 1
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] * self.width + ids[b]] = (rank, ids[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern, self.latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)

    def merged(self, token: str) -> int:
        """Tokens of one pre-token."""
        symbol = [self.symbol[b] for b in token.encode()]
        n = count = len(symbol)
        if n < 2:
            return n
        merges, width = self.merges, self.width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := merges.get(symbol[i] * width + symbol[i + 1]):
                heap.append((hit[0], i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            hit = merges.get(symbol[i] * width + symbol[j])
            if hit is None or hit[0] != rank:  # the pair has gone since it was pushed
                continue
            symbol[i], symbol[j] = hit[1], -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := merges.get(symbol[i] * width + symbol[k]):
                    heapq.heappush(heap, (hit[0], i))
            if (h := before[i]) >= 0 and (hit := merges.get(symbol[h] * width + symbol[i])):
                heapq.heappush(heap, (hit[0], h))
        return count

    def __missing__(self, token: str) -> int:
        count = self.merged(token)
        if len(token) <= KEEP_LEN:
            if len(self) >= KEEP_MANY:
                self.clear()
            self[token] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            pattern = self.latin if _is_latin(part) else self.pattern
            tokens = pattern.findall(part) if len(part) < LONG_TEXT else (m.group() for m in pattern.finditer(part))
            total += sum(map(self.__getitem__, tokens))
        return total


@cache
def counter(path: str) -> MergeCounter:
    """One counter for each vocabulary file in a Python worker."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: (id, n_bytes, n_tokens, over_limit).

    One row for each input row, repeated rows and null ids included. A null or empty text has 0 bytes and 0
    tokens. Other columns are not read. Memory is bounded by the longest text and by KEEP_MANY pre-tokens.
    vocabulary: path, known to every executor, of a byte-level BPE file.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            n = [own.count(s.as_py() or "") for s in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = read.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
