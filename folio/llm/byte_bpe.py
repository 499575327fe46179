"""Byte-level BPE: encoding and decoding by a file of ranks, without the tokenizer's own library.

A text is cut by the public pattern. The distinct cuts of a batch that have no known ids yet are laid out in padded
matrices, one row each, in buckets of like length. Each round looks up the ranks of all neighbouring pairs in a hash
table, merges every row's leftmost pair of minimum rank, closes the gap, and drops rows that have no pair left. Cuts of
more than ``MATRIX_BYTES`` bytes would make such rounds quadratic: they are merged one by one with a heap, to the same
ids. Decoding gathers the bytes of all ids of a batch at once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.pieces import PieceIds, gather

#: Longest cut that goes through the matrices.
MATRIX_BYTES = 256

_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of their merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == -1
            at = todo[free]
            self.keys[slots[at]] = keys[at]  # of several at one slot the last one stays
            won = self.keys[slots[todo]] == keys[todo]
            self.ranks[slots[todo[won]]] = ranks[todo[won]]
            todo = todo[~won]
            slots[todo] = (slots[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``_NONE`` for pairs that don't merge."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slots, found = self._slot(keys), np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slots]
            hit = held == keys[todo]
            found[todo[hit]] = self.ranks[slots[hit]]
            going = ~hit & (held != -1)
            todo, slots = todo[going], (slots[going] + 1) & (len(self.keys) - 1)
        return found.reshape(left.shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(merged, np.int32))
        self.merge = dict(zip(keys, merged))
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.pieces = PieceIds(self.cut, lambda cuts: self.encode_cuts([c.encode() for c in cuts]))

    def merge_rows(self, cuts: list[bytes]) -> list[np.ndarray]:
        """The ids of cuts of like length, by rounds over one padded matrix."""
        lengths = np.array([len(c) for c in cuts], np.int64)
        width = int(lengths.max())
        matrix = np.full((len(cuts), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        matrix[inside] = self.byte[np.frombuffer(b"".join(cuts), np.uint8)]
        done: list[np.ndarray | None] = [None] * len(cuts)
        rows = np.arange(len(cuts))
        while len(rows):
            left, right = matrix[:, :-1], matrix[:, 1:]
            rank = np.full(left.shape, _NONE, np.int32)
            real = right >= 0
            rank[real] = self.pairs.find(left[real], right[real])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                for row, ids, size in zip(rows[over], matrix[over], lengths[over]):
                    done[row] = ids[:size].copy()
                matrix, lengths, rows, at, best = matrix[~over], lengths[~over], rows[~over], at[~over], best[~over]
                if not len(rows):
                    break
            matrix[np.arange(len(rows)), at] = best
            columns = np.arange(matrix.shape[1] - 1)
            columns = columns + (columns > at[:, None])
            matrix = np.take_along_axis(matrix, columns, axis=1)
            lengths = lengths - 1
            matrix = np.pad(matrix[:, : int(lengths.max())], ((0, 0), (0, 1)), constant_values=-1)
        return done

    def merge_long(self, cut: bytes) -> np.ndarray:
        """The ids of one long cut: a heap of (rank, place) over a linked list of parts."""
        ids = self.byte[np.frombuffer(cut, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        find = self.merge.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := find(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := find(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_cuts(self, cuts: list[bytes]) -> list[np.ndarray]:
        done: list[np.ndarray | None] = [None] * len(cuts)
        buckets: dict[int, list[int]] = {}
        for i, cut in enumerate(cuts):
            whole = self.ranks.get(cut)
            if whole is not None:
                done[i] = np.array([whole], np.int32)
            elif len(cut) > MATRIX_BYTES:
                done[i] = self.merge_long(cut)
            else:
                buckets.setdefault((len(cut) + 3) // 4, []).append(i)
        for size, members in buckets.items():
            step = max(1, (1 << 20) // (4 * size))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self.merge_rows([cuts[i] for i in part])):
                    done[i] = ids
        return done

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last one's end)."""
        return self.pieces.encode(texts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) per row: the ids of each whole text; null and empty texts have none.

    ``path`` names the file of ranks, which every worker's machine must have. doc_id may be null or repeated; other
    columns are ignored. A map over rows: no shuffle.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                ids, ends = own.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the bytes of the ids. Null ids give null; an id outside the ranks is an error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                given = part.column(part.schema.get_field_index(ids))
                done = [None if x is None else own.decode(x.to_numpy(zero_copy_only=False)).tobytes() for x in (given[i].values for i in range(len(given)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], [*part.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return encoded.mapInArrow(each, StructType([*encoded.schema.fields]).add("decoded", BinaryType()))
