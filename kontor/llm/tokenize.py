"""Encoding of a corpus with a byte-level BPE vocabulary (problem 7).

Method: pair occurrence index. The distinct pieces of a batch become linked lists of symbols; an index maps
each adjacent pair to all its positions; the ranks that occur are taken in ascending order from a heap, all
positions of the rank's pair are merged from left to right, and only the lists next to a merge are updated.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces kept per Python worker; a full cache is emptied, which costs time but changes no result.
CACHE_PIECES = 300_000


def default_vocabulary() -> str:
    return os.path.join(os.environ.get("KONTOR_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of this kind: printable bytes stand for
    themselves, the others for the letters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairIndexEncoder:
    """Byte-level BPE over batches of pieces."""

    # Fixed value: the published pattern that splits text before the merges.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: str):
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.byte_ids = [ids[x] for x in byte_letters()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        self.split = regex.compile(self.PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def merge_all(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; all pieces share one index of pair occurrences."""
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts: list[int] = []
        for piece in pieces:
            at = len(sym)
            raw = piece.encode("utf-8", "surrogatepass")
            n = len(raw)
            starts.append(at)
            sym.extend(self.byte_ids[b] for b in raw)
            nxt.extend(range(at + 1, at + n))
            nxt.append(-1)
            prv.append(-1)
            prv.extend(range(at, at + n - 1))
        index: dict[int, list[int]] = {}
        pair_of: dict[int, tuple[int, int, int]] = {}
        heap: list[int] = []
        ranks = self.ranks

        def note(i: int, j: int) -> None:
            found = ranks.get((sym[i], sym[j]))
            if found:
                rank = found[0]
                if rank in index:
                    index[rank].append(i)
                else:
                    index[rank] = [i]
                    pair_of[rank] = (sym[i], sym[j], found[1])
                    heapq.heappush(heap, rank)

        for i, j in enumerate(nxt):
            if j >= 0:
                note(i, j)
        while heap:
            rank = heapq.heappop(heap)
            a, b, made = pair_of.pop(rank)
            for i in sorted(index.pop(rank)):
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue  # a neighbour was merged since the position was noted
                k = nxt[j]
                sym[i], sym[j], nxt[i] = made, -1, k
                if k >= 0:
                    prv[k] = i
                    note(i, k)
                if prv[i] >= 0:
                    note(prv[i], i)
        out = []
        for at in starts:
            row = []
            while at >= 0:
                row.append(sym[at])
                at = nxt[at]
            out.append(row)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = list({p for row in split for p in row} - self.known.keys())
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list({p for row in split for p in row})
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.known.update(zip(part, self.merge_all(part), strict=True))
        known = self.known
        return [[x for p in row for x in known[p]] for row in split]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> PairIndexEncoder:
    return PairIndexEncoder(vocabulary)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every row: columns ``id_col`` and ``ids`` (array<int>), without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts have an empty array; a null
    id is kept; repeated rows are encoded each. Narrow: no shuffle, each partition is encoded where it is
    read. The vocabulary (about 1.5 MB, fixed) is read once per Python worker.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([df.select(id_col).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            texts = pdf.iloc[:, 1].tolist()
            for k in range(0, max(1, len(texts)), 500):  # bounds the Python lists held at once
                yield pd.DataFrame({id_col: pdf.iloc[k : k + 500, 0], "ids": encoder_rows(enc, texts[k : k + 500])})

    def encoder_rows(enc: PairIndexEncoder, texts: list) -> list:
        return enc.encode([t if isinstance(t, str) else None for t in texts])

    return df.select(F.col(id_col), F.col(text_col)).mapInPandas(run, schema)
