"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Items fall into classes by length, each within a factor of two. For a class, texts are cut
into overlapping passages that are long enough for an item's copy to lie wholly in one;
their length follows from the class alone, so an item's score in a text depends on no other
item but through the counts of words. Every passage queries an inverted index of the items;
impacts are BM25 weights divided by the item's own score, so a passage that holds all of an
item scores 1. All items at or above the threshold are retrieved, and kept if both the
question's and the answer's word trigrams occur in the passage.

Postings stand in blocks of items, and the index keeps each term's largest impact in each
block where it occurs. A passage's terms bound its score in a block by the sum of those;
only blocks that could reach the threshold are opened, and searched by WAND: terms in the
order of their next item, the pivot being the first at which their bounds reach the
threshold, items before it are skipped. Before that, terms whose impacts sum to at most
half the threshold in every item are non-essential, and a passage that lacks half the
threshold from the others is ruled out at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

BLOCK_BYTES = 2_000_000
#: Items of one index; with more text, several indexes are built and queried in turn.
INDEX_BYTES = 8_000_000
THRESHOLD, OVERLAP, GRAM = 0.6, 0.5, 3
K1, B = 1.2, 0.75
ITEMS = 4  # of one block of the index
SPAN = 4  # length of a passage in the most words of its class; passages overlap by one such length
SHORTEST = 8  # words up to which items share the first class
_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def word_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and numbers."""
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = X.char_classes()[cps] > X.NUMBER
    starts = np.flatnonzero(X.run_starts(kind, X._text_starts(offsets, len(cps))))
    ends = np.append(starts[1:], len(cps))
    own = ~kind[starts]
    return starts[own], ends[own]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the first word of each text."""
    lowered = [t.lower() for t in texts]
    cps, offsets = X.code_points(lowered)
    starts, ends = word_spans(cps, offsets)
    return X.slice_hashes(cps, starts, ends), np.searchsorted(starts, offsets)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a test item: the answer is the last sentence or line, the question what stands before."""
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.strip())]
    if not cuts:
        return text, text
    return text.strip()[: cuts[-1]], text.strip()[cuts[-1] :]


def _grams(words: np.ndarray) -> np.ndarray:
    return X.ngram_hashes(words, min(GRAM, len(words))) if len(words) else words


def class_of(n_words: int) -> int:
    """The most words of the class of an item: a power of two."""
    return max(SHORTEST, 1 << max(n_words - 1, 0).bit_length())


class Index:
    """Postings in blocks with their largest impacts, over items of one class."""

    def __init__(self, items: list[tuple], longest: int, frequency: dict[int, int], n_items: int, mean_words: float):
        """items: (id, words, question grams, answer grams)."""
        self.ids = [i for i, *_ in items]
        self.question, self.answer = [q for _, _, q, _ in items], [a for *_, a in items]
        self.longest = longest
        postings: dict[int, list[tuple[int, float]]] = {}
        for item, (_, own, *_) in enumerate(items):
            weight = {
                t: np.log1p((n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(own) / mean_words))
                for t, c in Counter(own.tolist()).items()
            }
            total = sum(weight.values())
            for t, w in weight.items():
                postings.setdefault(t, []).append((item, w / total))
        self.terms = np.array(sorted(postings), np.uint64)
        lists = [postings[t] for t in self.terms.tolist()]
        self.items = np.array([i for x in lists for i, _ in x], np.int32)
        self.impacts = np.array([w for x in lists for _, w in x])
        size = np.array([len(x) for x in lists], np.int64)
        term = np.repeat(np.arange(len(lists)), size)
        # Entries: a term in a block, with the place of its first posting there and its largest impact.
        block = self.items // ITEMS
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.entry_at = np.flatnonzero(new)
        self.entry_end = np.append(self.entry_at[1:], len(term))
        self.entry_block = block[self.entry_at]
        self.entry_top = np.maximum.reduceat(self.impacts, self.entry_at) if len(term) else np.zeros(0)
        self.entries = np.searchsorted(term[self.entry_at], np.arange(len(lists) + 1))
        used, self.essential = np.zeros(len(items)), np.append(np.maximum.reduceat(self.impacts, np.cumsum(size) - size) if len(term) else [], 0.0)
        start = np.cumsum(size) - size
        for k in np.argsort(-size, kind="stable").tolist():
            own, impacts = self.items[start[k] : start[k] + size[k]], self.impacts[start[k] : start[k] + size[k]]
            if (used[own] + impacts).max() <= THRESHOLD / 2:
                used[own] += impacts
                self.essential[k] = 0.0

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The term number of each word, or the number of terms."""
        at = np.searchsorted(self.terms, words)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == words[known]
        return np.where(known, at, len(self.terms))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose summed impacts over the distinct terms reach the threshold."""
        least, out = THRESHOLD - 1e-9, []
        first, last = self.entries[terms], self.entries[terms + 1]
        count = last - first
        entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        block, top = self.entry_block[entry], self.entry_top[entry]
        for b in np.flatnonzero(np.bincount(block, top) >= least - 1e-4).tolist():
            here = np.flatnonzero(block == b)
            cursors = []
            for e, bound in zip(entry[here].tolist(), top[here].tolist()):
                own = slice(self.entry_at[e], self.entry_end[e])
                items = self.items[own].tolist()
                cursors.append([items[0], bound, 0, items, self.impacts[own].tolist()])
            out += self._wand(cursors, (b + 1) * ITEMS, least)
        return out

    @staticmethod
    def _wand(cursors: list, hi: int, least: float) -> list[tuple[int, float]]:
        """WAND over one block of items, with the block's own largest impacts as bounds."""
        out = []
        while True:
            cursors = sorted((c for c in cursors if c[0] < hi), key=itemgetter(0))
            bound = 1e-4
            for k, c in enumerate(cursors):
                bound += c[1]
                if bound >= least:
                    break
            else:
                return out
            pivot = target = cursors[k][0]
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            if cursors[0][0] == pivot:
                score = sum(c[4][c[2]] for c in cursors[: k + 1])
                if score >= least:
                    out.append((pivot, score))
                target = pivot + 1
            for c in cursors[: k + 1]:
                if c[0] < target:
                    items = c[3]
                    c[2] = at = bisect_left(items, target, c[2])
                    c[0] = items[at] if at < len(items) else hi

    def passages(self, words: np.ndarray, first: np.ndarray):
        """(text, start, end, distinct terms) of the passages that could hold an item."""
        terms = self.lookup(words)
        mass = np.concatenate([[0.0], np.cumsum(self.essential[terms])])
        least, step, length = THRESHOLD / 2 - 1e-6, (SPAN - 1) * self.longest, SPAN * self.longest
        likely = np.flatnonzero(mass[first[1:]] - mass[first[:-1]] >= least)
        for i in likely.tolist():
            a, b = int(first[i]), int(first[i + 1])
            starts = np.arange(a, max(a + 1, b - self.longest), step)
            stops = np.minimum(starts + length, b)
            enough = mass[stops] - mass[starts] >= least
            for s, e in zip(starts[enough].tolist(), stops[enough].tolist()):
                own = np.unique(terms[s:e])
                yield i, s, e, own[own < len(self.terms)]


def leaks(indexes: list[Index], texts: list[str]) -> list[tuple]:
    """(text, item id, score, question overlap, answer overlap) of the best passage for each pair."""
    words, first = word_hashes(texts)
    out = []
    for index in indexes:
        best: dict = {}
        for i, s, e, terms in index.passages(words, first):
            hits = index.search(terms)
            grams = {n: X.ngram_hashes(words[s:e], n) for n in range(1, GRAM + 1)} if hits else {}
            for item, score in hits:
                found = []
                for part in (index.question[item], index.answer[item]):
                    found.append(max(np.isin(part, g).mean() for g in grams.values()) if len(part) else 1.0)
                if min(found) >= OVERLAP and (min(found), score) > best.get((i, item), ((0, 0),))[0]:
                    best[i, item] = ((min(found), score), score, *found)
        out += [(i, index.ids[item], *rest[1:]) for (i, item), rest in best.items()]
    return out


def build_indexes(benchmark: DataFrame, answer: str | None = None) -> list[list[Index]]:
    """Indexes of all items, by class, in shards of about INDEX_BYTES of text; counts of words are those of all items."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer"),
    )

    def terms(batches):
        for batch in batches:
            texts = [f"{t}\n{a or ''}" for t, a in zip(batch.column("text").to_pylist(), batch.column("answer").to_pylist())]
            words, first = word_hashes(texts)
            bags = [np.unique(words[a:b]).view(np.int64).tolist() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.int64())), pa.array(np.diff(first), pa.int64()), batch.column("item_id")], ["terms", "n", "item_id"])

    bags = items.mapInArrow(terms, "terms array<long>, n long, item_id long")
    size, count = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0))), F.lit(0)), F.count("*")).first()
    if not count:
        return []
    mean = bags.agg(F.avg("n")).first()[0] or 1.0
    shards = -(-size // INDEX_BYTES) or 1
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    spread = bags.select("item_id", F.explode("terms").alias("term"))
    frequency = spread.groupBy("term").count()
    out = []
    for k in range(shards):
        rows = sorted(map(tuple, items.where(shard == k).collect()), key=str)
        words = [word_hashes([t if a is None else f"{t}\n{a}"])[0] for _, t, a in rows]
        needed = np.unique(np.concatenate(words)).view(np.int64).tolist() if words else []
        wanted = _terms_table(benchmark, needed)
        counts = {r[0] % 2**64: r[1] for r in frequency.join(F.broadcast(wanted), "term").collect()} if needed else {}
        classes: dict[int, list] = {}
        for (item, text, given), own in zip(rows, words):
            if len(own):
                question, reply = split_item(text) if given is None else (text, given)
                classes.setdefault(class_of(len(own)), []).append((item, own, *(_grams(word_hashes([x])[0]) for x in (question, reply))))
        out.append([Index(classes[c], c, counts, count, mean) for c in sorted(classes)])
    return out


def _terms_table(like: DataFrame, terms: list[int]) -> DataFrame:
    """A shard's terms, of at most INDEX_BYTES of text, as a table."""
    import pandas as pd

    return like.sparkSession.createDataFrame(pd.DataFrame({"term": terms}), "term long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, score, question_overlap, answer_overlap.

    One row per pair of a row of ``docs`` and an item; documents without a leak have none.
    Null and empty texts hold nothing; an empty item leaks nowhere; repeated rows and items
    give repeated results; a null doc_id stays null; other columns are ignored; an empty
    ``docs`` or ``benchmark`` gives an empty result. Very long texts are searched whole.
    ``answer`` names a column with an item's answer; without it the last sentence of an
    item is its answer.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found: list[DataFrame] = []
    for indexes in build_indexes(benchmark, answer):
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches, held=held):
            for block in X.text_blocks(batches, BLOCK_BYTES):
                ids = block.column("doc_id").to_pylist()
                hits = leaks(held.value, [t or "" for t in block.column("text").to_pylist()])
                columns = [[ids[h[0]] for h in hits], [h[1] for h in hits], *([float(h[c]) for h in hits] for c in (2, 3, 4))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found.append(docs.mapInArrow(run, _FOUND))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged.

    Rows with a null or empty text stay, and so do all rows if ``benchmark`` is empty;
    repeated rows go or stay together; see ``find_leaks`` for the rest.
    """
    for indexes in build_indexes(benchmark, answer):
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches, held=held):
            for block in X.text_blocks(batches, BLOCK_BYTES):
                keep = np.ones(block.num_rows, bool)
                keep[[f[0] for f in leaks(held.value, [t or "" for t in block.column("text").to_pylist()])]] = False
                yield block.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
