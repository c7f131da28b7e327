"""Passages of evaluation items in a corpus (problem 8).

Method: Wu and Manber's multi-pattern search. The test strings are the three-word windows of all items; a table of
shifts by block of letters skips places where none can end, a table by suffix block selects the strings to test, and
direct comparison confirms them. Confirmed places are then chained word by word: a passage may have replaced words and
one insertion.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.session import cut

#: Items searched for in one pass over the corpus; more items take more passes.
ITEMS_A_PASS = 20_000
#: The last search that this Python worker built, by the number of its block.
BUILT: dict[str, Leaks] = {}
WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});|­|[​-‍﻿⁠]|-\r?\n\s*(?=[a-zäöüß])")
BREAK = re.compile(r"</?(?:p|br|div|li|td|tr|h\d|ul|ol)\b[^<>]{0,200}>", re.I)


def normal_words(text: str | None) -> list[str]:
    """Words without case, accents, markup and punctuation; ae, oe and ue as their first letter, as the accents went."""
    if not text:
        return []
    if "<" in text or "&" in text or "­" in text or "​" in text or "-\n" in text or "-\r" in text or "‍" in text or "⁠" in text or "﻿" in text:
        text = MARKUP.sub(lambda m: "" if m[0][0] in "-­​‌‍﻿⁠" else "" if m[0][0] == "<" else " ", BREAK.sub(" ", text))
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return WORD.findall(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normal_words_of(texts: pd.Series) -> pd.Series:
    return pd.Series([normal_words(t) for t in texts])


class WuManber:
    """Search for many strings at once; ``find`` yields (place, string number) for every occurrence."""

    def __init__(self, strings: list[str], block: int = 3):
        self.strings, self.block = strings, block
        self.m = m = min(map(len, strings))
        if m < block:
            raise ValueError("strings are shorter than a block")
        self.most = m - block + 1
        self.shift: dict[str, int] = {}
        self.suffix: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, s in enumerate(strings):
            for i in range(self.most):
                part = s[i : i + block]
                self.shift[part] = min(self.shift.get(part, self.most), self.most - 1 - i)
            self.suffix[s[m - block : m]][s[:block]].append(k)
        self.suffix = {k: dict(v) for k, v in self.suffix.items()}

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        m, block, shift, most, strings = self.m, self.block, self.shift, self.most, self.strings
        end, n = m, len(text)
        while end <= n:
            part = text[end - block : end]
            step = shift.get(part, most)
            if step:
                end += step
                continue
            at = end - m
            for k in self.suffix[part].get(text[at : at + block], ()):
                if text.startswith(strings[k], at):
                    yield at, k
            end += 1


class Leaks:
    """Finds the items whose passages a text holds. ``items``: (item, its words)."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int, share: float, gap: int):
        self.least, self.share, self.gap = least, share, gap
        self.words = {i: w for i, w in items if len(w) >= 3}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            for p in range(len(w) - 2):
                at[f" {w[p]} {w[p + 1]} {w[p + 2]} "].append((i, p))
        self.places = list(at.values())
        self.search = WuManber(list(at)) if at else None

    def hits(self, words: list[str]) -> dict[int, set[int]]:
        """Diagonals (place in the text less place in the item) of the windows of each item that the text holds."""
        found: dict[int, set[int]] = defaultdict(set)
        if self.search is None or len(words) < 3:
            return found
        starts: dict[int, int] | None = None
        for place, k in self.search.find(f" {' '.join(words)} "):
            if starts is None:
                starts, pos = {}, 0
                for n, w in enumerate(words):
                    starts[pos] = n
                    pos += len(w) + 1
            n = starts[place]
            for item, p in self.places[k]:
                found[item].add(n - p)
        return found

    def of(self, text: str | None) -> list[tuple[int, int, int, list[int], list[str]]]:
        """(item, words of its longest passage, words of it found in place, the places of the passage's words in the text and
        the words) of each item with a passage that no other item here outdoes."""
        words = normal_words(text)
        hits = self.hits(words)
        out = []
        for i, diagonals in hits.items():
            for size, got, at in self.passages(words, i, diagonals):
                mine, there = [self.words[i][p] for p, _ in at], [t for _, t in at]
                if got == size or not self.outdone(i, mine, there, words, hits):
                    out.append((i, size, got, there, mine))
                    break
        return out

    def outdone(self, item: int, mine: list[str], there: list[int], words: list[str], hits: dict[int, set[int]]) -> bool:
        """Whether another item speaks against a passage (see :func:`told_apart`)."""
        return any(told_apart(mine, there, words, self.words[j], d) for j, d in hits.items() if j != item)

    def passages(self, words: list[str], item: int, diagonals: set[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """Longest stretches of the item with enough words found, straight or with one insertion in the text: their words,
        those found, and the (place in the item, place in the text) of each; the longest first."""
        mine, n = self.words[item], len(words)
        rows = {d: [0 <= p + d < n and words[p + d] == w for p, w in enumerate(mine)] for d in diagonals}
        tries = [(row, len(mine), d, d) for d, row in rows.items()]
        order = sorted(rows)
        for x, d in enumerate(order):
            for e in order[x + 1 :]:
                if e - d > self.gap:
                    break
                a, b = rows[d], rows[e]
                score = best = sum(b)
                cut_at = 0
                for s in range(len(mine)):
                    score += a[s] - b[s]
                    if score > best:
                        best, cut_at = score, s + 1
                if 0 < cut_at < len(mine):
                    tries.append((a[:cut_at] + b[cut_at:], cut_at, d, e))
        found = []
        for row, cut_at, d, e in tries:
            if sum(row) < self.least * self.share:
                continue
            sums = [0]
            for r in row:
                sums.append(sums[-1] + r)
            ends = [p for p, r in enumerate(row) if r]
            most: tuple[int, int, int] | None = None
            for i in ends:
                for j in reversed(ends):
                    size = j - i + 1
                    if size < self.least or (most and size <= most[0]):
                        break
                    if sums[j + 1] - sums[i] >= self.share * size:
                        most = (size, i, j)
                        break
            if most:
                size, i, j = most
                found.append((size, sums[j + 1] - sums[i], [(p, p + (d if p < cut_at else e)) for p in range(i, j + 1)]))
        return sorted(found, key=lambda f: (f[0], f[1]), reverse=True)


def told_apart(mine: list[str], there: list[int], words: list[str], other: list[str], diagonals: set[int]) -> bool:
    """Whether the text speaks against a passage because of another item with words in the same place: more than half of the
    words in which the two items differ there are missing. So wording that both share stands for neither, while an equal
    item differs in none and takes nothing away."""
    differ = missing = 0
    for word, t in zip(mine, there, strict=True):
        if not any(0 <= t - d < len(other) and other[t - d] == word for d in diagonals):
            differ += 1
            missing += words[t] != word
    return 2 * missing > differ


def searcher(number: str, sent, least: int, share: float, gap: int) -> Leaks:
    """The search for one broadcast block of items, built once by a Python worker and not again by each task."""
    if number not in BUILT:
        BUILT.clear()
        BUILT[number] = Leaks(sent.value, least, share, gap)
    return BUILT[number]


def leaked(docs: DataFrame, items: DataFrame, least: int = 12, share: float = 0.75, gap: int = 12) -> DataFrame:
    """doc_id, item_id, words, found: items of which a document holds a passage of ``least`` successive words or more.

    At least ``share`` of the passage's words are found in place; one insertion of up to ``gap`` words may interrupt it. A
    passage found word by word always counts, whoever else has it, and equal items leak together; one with replaced words
    counts unless another item speaks against it (:func:`told_apart`), however many items there are. Whole texts are
    searched where they are read; no shuffle but a distinct of the few results. The items are a test set of bounded size:
    they are read in blocks of ``ITEMS_A_PASS`` and broadcast, each searched in a pass of its own; with several passes the
    documents with a passage of replaced words are read again for rivals of other blocks. Null and empty texts hold
    nothing; repeated rows give one row.
    """
    spark = docs.sparkSession
    ids = [docs.select("doc_id").schema[0], items.select("item_id").schema[0]]
    told = [T.StructField("words", T.IntegerType()), T.StructField("found", T.IntegerType()), T.StructField("there", T.ArrayType(T.IntegerType())), T.StructField("mine", T.ArrayType(T.StringType()))]
    said = cut(items.select("item_id", "text").where("item_id is not null and text is not null").distinct().select("item_id", normal_words_of("text").alias("said")))
    passes = max(1, -(-said.count() // ITEMS_A_PASS))
    blocks = []
    for k in range(passes):
        block = [(r.item_id, r.said) for r in said.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()]
        blocks.append((uuid4().hex, spark.sparkContext.broadcast(block)))

    def passages(batches: Iterator[pd.DataFrame], number: str, sent) -> Iterator[pd.DataFrame]:
        search = searcher(number, sent, least, share, gap)
        for pdf in batches:
            rows = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for x in search.of(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "found", "there", "mine"])

    def undone(batches: Iterator[pd.DataFrame], number: str, sent) -> Iterator[pd.DataFrame]:
        search = searcher(number, sent, least, share, gap)
        for pdf in batches:
            words = [normal_words(t) for t in pdf["text"]]
            stays = [not search.outdone(i, list(m), list(a), w, search.hits(w)) for i, m, a, w in zip(pdf["item_id"], pdf["mine"], pdf["there"], words, strict=True)]
            yield pdf.drop(columns="text")[stays]

    texts = docs.select("doc_id", "text").where("text is not null")
    out = None
    for number, sent in blocks:
        part = texts.mapInPandas(partial(passages, number=number, sent=sent), T.StructType(ids + told))
        out = part if out is None else out.unionByName(part)
    if passes > 1:
        out = cut(out)
        open_ = out.where("found < words")
        for number, sent in blocks:
            open_ = cut(open_.join(texts, "doc_id").mapInPandas(partial(undone, number=number, sent=sent), T.StructType(ids + told)))
        out = out.where("found = words").unionByName(open_)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "found")).alias("b")).select("doc_id", "item_id", "b.words", "b.found")
