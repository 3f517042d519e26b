"""Token counts by byte-pair merging with a heap and a linked list.

Each distinct word of a block is merged once: its symbols form a doubly linked list, a
heap holds the adjacent pairs by rank and place, and the lowest is merged until none is
left. A word's count is its symbols less its merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from .byte_bpe import distinct_pieces

BLOCK_BYTES = 3_000_000
CACHED_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 characters stay, the rest follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class WordCounter:
    """Counts the tokens of words for a vocabulary file with word-end merges."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        model = json.loads(content)
        self.normalizer = Tokenizer.from_str(content).normalizer
        self.lowers = {"NFC", "Replace", "Lowercase"} >= {n["type"] for n in (model["normalizer"] or {}).get("normalizers", [{"type": ""}])}
        merges = model["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model["model"].get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.vocab = model["model"]["vocab"]
        self.special = [t["content"] for t in model["added_tokens"]]
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            known = self.cache[word] = self._merge(word)
        return known

    def normal(self, text: str) -> str:
        """The library's normal form; of plain ASCII only case and white space can differ, and white space is dropped later."""
        if self.lowers and text.isascii():
            return text.lower()
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _merge(self, word: str) -> int:
        parts = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        parts = [p for p in parts if p in self.vocab]
        n = len(parts)
        if n < 2:
            return n
        ranks = self.ranks
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # one of the two has been merged since
            merges += 1
            parts[i] = left + right
            parts[j] = ""
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return n - merges


@lru_cache(2)
def _counter(content: str) -> WordCounter:
    return WordCounter(content)


def _counts(held):
    def run(batches):
        counter = _counter(held.value)
        special = re.compile("|".join(map(re.escape, counter.special))) if counter.special else None
        for block in X.text_blocks(batches, BLOCK_BYTES):
            texts = [t or "" for t in block.column("text").to_pylist()]
            extra = np.zeros(len(texts), np.int64)
            pieces, of = [], []
            for i, text in enumerate(texts):
                parts = special.split(text) if special and "<|" in text else [text]
                extra[i] = len(parts) - 1
                pieces += map(counter.normal, parts)
                of += [i] * len(parts)
            cps, offsets = X.code_points(pieces)
            starts, ends = X.word_bpe_pieces(cps, offsets)
            tokens = extra
            if len(starts):
                words, index = distinct_pieces(cps, starts, ends, "".join(pieces))
                sizes = np.fromiter(map(counter.count, words), np.int64, len(words))
                doc = np.array(of)[np.searchsorted(offsets, starts, "right") - 1]
                tokens = extra + np.bincount(doc, weights=sizes[index], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(pc.fill_null(pc.binary_length(block.column("text")), 0), pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """Tokens of ``text`` in every row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Strings of special tokens inside texts count as one token each, as the library takes
    them by default. A null or empty text has 0 bytes and 0 tokens; repeated rows, null
    doc_ids and very long texts are counted like any other; other columns are ignored; an
    empty table gives an empty result.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts(held), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
