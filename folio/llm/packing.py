"""Lexical retrieval packing: sequences of related documents, found by BM25 in sharded inverted indexes.

The documents of a shard are indexed by their token ids. A seed document opens a window; the index returns its unused
neighbours, best first, and they fill the window one by one. The last one is cut where the window ends, and its rest
seeds the next window, so windows are full. A shard is a run of documents of one input partition: building shards
needs no shuffle, a partition of any size is packed shard by shard in bounded memory, and a lost task packs its own
partition again to the same sequences. What is left at a partition's end goes into sequences whose lengths are powers
of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.pieces import PieceIds, gather

WINDOW, SEPARATOR = 2048, 1
#: A shard ends at so many documents or tokens. Terms count up to this share of its documents: all of them do.
SHARD_DOCS, SHARD_TOKENS, COMMON = 512, 4_000_000, 1.0
#: Terms in a larger share of the documents are scored by rows over all documents, at most so many cells; the others by postings.
DENSE, CELLS = 0.1, 8_000_000
K1, B = 1.2, 0.75

_CUT = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall
#: Signs at a word's end, which the tokenizer divides from a letter or digit in any case: with a space between, words
#: with and without them are one.
_TAIL = re.compile(r"[.,;:!?#$%*&|](?<=[0-9A-Za-zß-öø-ÿ].)[.,;:!?#$%*&|]*(?=[ \n]|\Z)")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def pieces(path: str) -> PieceIds:
    """The tokenizer in ``path``; it drops white space and never merges over it, so texts are encoded word by word.

    Words go through the library many at a time, with a special token, which nothing merges with, between them; a word
    that holds a character of that token's ends goes alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    between = next((t for t in own.get_added_tokens_decoder().items() if t[1].special), None)

    def alone(words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in own.encode_batch(words, add_special_tokens=False)]

    def encode(words: list[str]) -> list[np.ndarray]:
        if between is None:
            return alone(words)
        number, sign = between[0], between[1].content
        odd = {i for i, w in enumerate(words) if sign[0] in w or sign[-1] in w}
        plain = [w for i, w in enumerate(words) if i not in odd]
        done: list[np.ndarray] = []
        for e in own.encode_batch_fast([sign.join(plain[at : at + 256]) for at in range(0, len(plain), 256)], add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            cuts = np.flatnonzero(ids == number)
            done += [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]
        rest, single = iter(done), iter(alone([words[i] for i in sorted(odd)]))
        return [next(single) if i in odd else next(rest) for i in range(len(words))] if odd else done

    return PieceIds(lambda text: _CUT(_TAIL.sub(r" \g<0>", text)), encode)


class Index:
    """BM25 inverted index of one shard: ``flat`` holds the ids of its documents, ``ends`` their borders."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray) -> None:
        n, sizes = len(ends) - 1, np.diff(ends)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        keys, tf = np.unique(flat.astype(np.int64) * n + owner, return_counts=True)
        term, doc = np.divmod(keys, n)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        df = np.diff(np.concatenate([first, [len(term)]]))
        slot = np.repeat(np.arange(len(first)), df)
        told = (df > 1) & (df <= max(2, COMMON * n))
        often = np.argsort(-df, kind="stable")[: CELLS // max(1, n)]
        often = often[told[often] & (df[often] > max(2, DENSE * n))]
        weight = np.log1p((n - df + 0.5) / (df + 0.5))[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(1.0, sizes.mean())))
        self.n, self.first, self.df, self.doc, self.weight = n, first, df, doc, weight
        self.row, self.rows = np.full(len(first), -1), np.zeros((len(often), n))
        self.row[often] = np.arange(len(often))
        row = self.row[slot]
        self.rows[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        kept = told[slot]
        order = np.argsort(doc[kept], kind="stable")
        self.terms = slot[kept][order]
        self.bounds = np.searchsorted(doc[kept][order], np.arange(n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best score first, ties in order."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[terms]
        terms, scores = terms[row < 0], self.rows[row[row >= 0]].sum(0)
        docs = gather(self.doc, self.first[terms], self.df[terms])
        if len(docs):
            scores += np.bincount(docs, gather(self.weight, self.first[terms], self.df[terms]), self.n)
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Packs the shards of one partition; ``rows`` are finished pieces, the open window's pieces wait."""

    def __init__(self, partition: int) -> None:
        self.next, self.rows = partition << 40, []
        self.open: list[tuple[int | None, int, int, np.ndarray]] = []  # document, start, its tokens, ids
        self.filled = 0

    def _close(self, waiting: list, length: int) -> list:
        """Write the first ``length`` ids of the waiting pieces as one sequence; what is beyond them goes on waiting."""
        offset, rest = 0, []
        for doc, start, total, ids in waiting:
            take = min(len(ids), length - offset)
            if take:
                self.rows.append((doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, self.next, offset))
            if take < len(ids):
                rest.append((doc, start + take, total, ids[take:]))
            offset += take
        self.next += 1
        return rest

    def _place(self, doc: int | None, start: int, ids: np.ndarray) -> int:
        """Put what fits of a document behind the open window; returns how many ids that were."""
        take = min(WINDOW - self.filled, len(ids) - start)
        self.open.append((doc, start, len(ids), ids[start : start + take]))
        self.filled += take
        if self.filled == WINDOW:
            self.open, self.filled = self._close(self.open, WINDOW), 0
        return take

    def shard(self, docs: list[int | None], flat: np.ndarray, ends: np.ndarray) -> None:
        index = Index(flat, ends)
        own = [np.append(flat[ends[i] : ends[i + 1]], np.int32(SEPARATOR)) for i in range(len(docs))]
        unused = np.ones(len(docs), bool)
        queue: list[int] = []
        for at in range(len(docs)):
            seed = at
            while seed is not None and unused[seed]:
                unused[seed] = False
                start, opened = 0, self.filled == 0
                while start < len(own[seed]):
                    opened = opened or self.filled == 0
                    start += self._place(docs[seed], start, own[seed])
                    opened = opened and self.filled > 0
                if opened or not queue:
                    queue = index.neighbours(seed, unused)[::-1].tolist() if self.filled else []
                while queue and not unused[queue[-1]]:
                    queue.pop()
                seed = queue.pop() if queue else None

    def finish(self) -> None:
        for bit in range(WINDOW.bit_length() - 1, -1, -1):
            if self.filled >> bit & 1:
                self.open = self._close(self.open, 1 << bit)
        self.filled = 0


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts in the document and in its sequence.

    Every document is its ids and a separator; null and empty texts are the separator alone. Rows with equal or null
    doc_id are documents of their own; other columns are ignored; an empty table has no pieces.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, encoder = Packer(TaskContext.get().partitionId()), pieces(path)
        ids: list = []
        flats, ends = [], [0]

        def rows() -> pa.RecordBatch:
            done, packer.rows = packer.rows, []
            columns = zip(*done) if done else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.partition(" ")[0] for f in SCHEMA.split(", ")])

        def packed() -> pa.RecordBatch:
            packer.shard(ids, np.concatenate(flats), np.array(ends))
            del ids[:], flats[:], ends[1:]
            return rows()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat, own = encoder.encode(part.column(1).to_pylist())
                flats.append(flat)
                ends.extend((own[1:] + ends[-1]).tolist())
                ids.extend(part.column(0).to_pylist())
                if len(ids) >= SHARD_DOCS or ends[-1] >= SHARD_TOKENS:
                    yield packed()
        if ids:
            yield packed()
        packer.finish()
        yield rows()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, SCHEMA)
