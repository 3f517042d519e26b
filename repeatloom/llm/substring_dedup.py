"""Substring dedup: a count-min prefilter over windows of words, then exact grouping.

Texts are dealt once into blocks; the three passes over blocks read that one exchange.

1. Each block sketches its windows into the cells of a count-min sketch (two rows, about
   CELLS_PER_WINDOW cells per window) and deals the cells it touched, sorted and
   delta-coded, to cell ranges. A range merges the partition sketches and tells each
   block which of its cells count two or more. A merged count is never less than the
   true one, so no repeated window is lost.
2. Windows whose cells all count two or more are estimated repeated. Only those are dealt,
   once per block, by a 128-bit fingerprint and grouped exactly.
3. Blocks mark the words that the windows found repeated cover and return what is left.

A window that a third of all documents share costs one row per block in each pass. A block
deals at most FAN rows in a pass: beyond as many ranges, nodes in between merge the sketches,
or the windows, of FAN blocks for a share of the ranges, ask on, and hand the answers back.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import _staging
from ._staging import levels, parts, replayable, text_bytes

WINDOW = 35
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000
CELLS_PER_WINDOW = 16
ROWS = 2

U64 = np.uint64
_DEALT = pa.schema([("key", pa.int64()), ("bkey", pa.int64()), ("payload", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _rows(batches) -> pa.Table:
    """A block's documents in the order of their row number."""
    return pa.Table.from_batches(list(batches)).sort_by("uid")


class _Block:
    """Words of a block and the fingerprints of its windows."""

    def __init__(self, table: pa.Table, window: int):
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.words = X.ByteWords(self.texts)
        self.window = window
        first = self.words.first
        counts = np.maximum(np.diff(first) - window + 1, 0)
        self.at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())

    def fingerprint(self, seed: int) -> np.ndarray:
        return X.ngram_hashes(self.words.hashes(seed), self.window, seed)[self.at] if len(self.at) else np.zeros(0, U64)


def cells(fingerprint: np.ndarray, row: int, bits: int) -> np.ndarray:
    return X.mix(fingerprint + U64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(64 - bits)


def _by_range(values: np.ndarray, bits: int, buckets: int) -> list[int]:
    bounds = [-(-(b << bits) // buckets) for b in range(1, buckets)]
    return [0, *np.searchsorted(values, np.array(bounds, U64)).tolist(), len(values)]


def _packed(value: np.ndarray, many: np.ndarray) -> bytes:
    return struct.pack("<I", len(value)) + np.packbits(many).tobytes() + X.pack_deltas(value)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values and, for each, whether it is known to occur more than once."""
    (n,) = struct.unpack_from("<I", blob)
    size = (n + 7) // 8
    return X.unpack_deltas(blob[4 + size :]), np.unpackbits(np.frombuffer(blob, np.uint8, size, 4), count=n).astype(bool)


def _answer(flags: np.ndarray) -> bytes:
    return struct.pack("<I", len(flags)) + np.packbits(flags).tobytes()


def _flags(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", blob)
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=4), count=n).astype(bool)


def _batch(keys: list[int], bkeys: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bkeys, pa.int64()), pa.array(payloads, pa.binary())], schema=_DEALT)


def _pairs(batches) -> list[tuple[int, int, bytes]]:
    return [(k, b, p.as_py()) for batch in batches for k, b, p in zip(batch.column("key").to_pylist(), batch.column("bkey").to_pylist(), batch.column("payload"))]


def _sketch(window: int, bits: int, buckets: int, group: int):
    """A block's sketch, dealt to ranges of cells; ``group`` blocks share the nodes of their ranges."""

    def run(key, batches):
        print_ = _Block(_rows(batches), window).fingerprint(1)
        keys, payloads = [], []
        base = key[0].as_py() // group * ROWS * buckets
        for row in range(ROWS):
            value, counts = np.unique(cells(print_, row, bits), return_counts=True)
            edges = _by_range(value, bits, buckets)
            for b, (i, j) in enumerate(zip(edges, edges[1:])):
                if i < j:
                    keys.append(base + row * buckets + b)
                    payloads.append(_packed(value[i:j], counts[i:j] > 1))
        yield _batch(keys, [key[0].as_py()] * len(keys), payloads)

    return run


def _merge(key, batches):
    """Merge the partition sketches of a range of cells; tell each sender which of its cells count two or more."""
    rows = _pairs(batches)
    parts_ = [_unpacked(p) for _, _, p in rows]
    value, twice = np.concatenate([v for v, _ in parts_]), np.concatenate([t for _, t in parts_])  # what two senders hold is found below
    order = np.argsort(value)
    value = value[order]
    same = np.zeros(len(value) + 1, bool)
    np.equal(value[1:], value[:-1], out=same[1:-1])
    repeated = np.empty(len(value), bool)
    repeated[order] = same[1:] | same[:-1]
    repeated |= twice
    ends = np.cumsum([len(v) for v, _ in parts_])
    yield _batch([key[0].as_py()] * len(rows), [b for _, b, _ in rows], [_answer(x) for x in np.split(repeated, ends[:-1])])


def _merged(rows: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The values of each sender, and all of them once, with whether they are known to occur more than once."""
    parts_ = [_unpacked(p) for _, _, p in rows]
    value, index, counts = np.unique(np.concatenate([v for v, _ in parts_]), return_inverse=True, return_counts=True)
    many = counts > 1
    many[index[np.concatenate([t for _, t in parts_])]] = True
    return [v for v, _ in parts_], value, many


def _sketch_up(bits: int, coarse: int, fine: int):
    """A node's merged sketch, dealt to the ranges of its share."""

    def run(key, batches):
        rows, own = _pairs(batches), key[0].as_py()
        _, value, many = _merged(rows)
        edges, row = _by_range(value, bits, coarse * fine), own // coarse % ROWS
        used = [(b, i, j) for b, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
        yield _batch([row * coarse * fine + b for b, _, _ in used], [own] * len(used), [_packed(value[i:j], many[i:j]) for _, i, j in used])

    return run


def _sketch_down(key, left, right):
    """The answers to a node's merged sketch, for each of its blocks."""
    rows = _pairs(left)
    if not rows:
        return
    parts_, value, _ = _merged(rows)
    flags = np.concatenate([_flags(p) for _, _, p in sorted(_pairs(right))])
    assert len(flags) == len(value)
    yield _batch([key[0].as_py()] * len(rows), [b for _, b, _ in rows], [_answer(flags[np.searchsorted(value, v)]) for v in parts_])


def _estimated(window: int, bits: int, buckets: int, group: int):
    """The windows of a block that the sketch estimates repeated, each once, dealt by fingerprint."""

    def run(key, left, right):
        table = _rows(left)
        if not table.num_rows:
            return
        block = _Block(table, window)
        one = block.fingerprint(1)
        if not len(one):
            return
        told = {k: _flags(p) for k, _, p in _pairs(right)}
        likely = np.ones(len(one), bool)
        for row in range(ROWS):
            flags = np.concatenate([told[k] for k in sorted(told) if k // buckets % ROWS == row])
            value, index = np.unique(cells(one, row, bits), return_inverse=True)
            assert len(value) == len(flags)
            likely &= flags[index]
        hits = np.flatnonzero(likely)
        one, two = one[hits], block.fingerprint(2)[hits]
        order = np.lexsort((two, one))
        one, two, hits = one[order], two[order], hits[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(one))) > 1
        one, two, hits = one[first], two[first], hits[first].astype("<u4")
        yield _deal_windows(one, two, hits, many, buckets, key[0].as_py() // group * buckets, key[0].as_py())

    return run


def _deal_windows(one, two, hits, many, buckets: int, base: int, sender: int) -> pa.RecordBatch:
    """Different windows in order, dealt to ranges of their fingerprints."""
    edges = _by_range(one, 64, buckets)
    used = [(b, i, j) for b, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
    payloads = [struct.pack("<I", j - i) + one[i:j].tobytes() + two[i:j].tobytes() + hits[i:j].tobytes() + many[i:j].tobytes() for _, i, j in used]
    return _batch([base + b for b, _, _ in used], [sender] * len(used), payloads)


class _Windows:
    """The windows of several senders in one order, with which of them occur more than once among all."""

    def __init__(self, rows: list):
        one, two, hits, many = [], [], [], []
        for _, _, blob in rows:
            (n,) = struct.unpack_from("<I", blob)
            one.append(np.frombuffer(blob, U64, n, 4))
            two.append(np.frombuffer(blob, U64, n, 4 + 8 * n))
            hits.append(np.frombuffer(blob, "<u4", n, 4 + 16 * n))
            many.append(np.frombuffer(blob, bool, n, 4 + 20 * n))
        self.hits = hits
        a, b = np.concatenate(one), np.concatenate(two)
        self.order = np.lexsort((b, a))
        self.one, self.two = a[self.order], b[self.order]
        new = np.ones(len(a), bool)
        new[1:] = (self.one[1:] != self.one[:-1]) | (self.two[1:] != self.two[:-1])
        self.first = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1  # of the different window, by place in the order
        self.many = np.bincount(self.number, np.concatenate(many)[self.order] + 1) > 1

    def answers(self, key: int, rows: list, repeated: np.ndarray) -> pa.RecordBatch:
        """To each sender the hits of its windows that are repeated, by number."""
        flags = np.empty(len(self.order), bool)
        flags[self.order] = repeated[self.number]
        found = [own[flag] for own, flag in zip(self.hits, np.split(flags, np.cumsum([len(h) for h in self.hits])[:-1]))]
        told = [(b, f.tobytes()) for (_, b, _), f in zip(rows, found) if len(f)]
        return _batch([key] * len(told), [b for b, _ in told], [p for _, p in told])


def _group(key, batches):
    """Group fingerprints exactly; return to each sender the windows of which another exists."""
    rows = _pairs(batches)
    windows = _Windows(rows)
    yield windows.answers(key[0].as_py(), rows, windows.many)


def _group_up(coarse: int, fine: int):
    """A node's different windows, dealt to the ranges of its share; their hits are their numbers."""

    def run(key, batches):
        w = _Windows(_pairs(batches))
        yield _deal_windows(w.one[w.first], w.two[w.first], np.arange(len(w.first), dtype="<u4"), w.many, coarse * fine, 0, key[0].as_py())

    return run


def _group_down(key, left, right):
    rows = _pairs(left)
    if not rows:
        return
    windows = _Windows(rows)
    repeated = np.zeros(len(windows.first), bool)
    for _, _, payload in _pairs(right):
        repeated[np.frombuffer(payload, "<u4")] = True
    yield windows.answers(key[0].as_py(), rows, repeated)


def _remove(window: int):
    def run(key, left, right):
        table = _rows(left)
        if not table.num_rows:
            return
        block = _Block(table, window)
        found = [np.frombuffer(p.as_py(), "<u4") for batch in right for p in batch.column("payload")]
        n = len(block.words.starts)
        gone = np.zeros(n, bool)
        if found:
            first = np.concatenate(found)
            one, two = block.fingerprint(1), block.fingerprint(2)
            a, b = one[first], two[first]
            order = np.lexsort((b, a))
            pair = np.rec.fromarrays([a[order], b[order]])
            a = pair.f0
            place = np.searchsorted(a, one)
            inside = np.flatnonzero(place < len(a))
            inside = inside[a[place[inside]] == one[inside]]
            ends = np.searchsorted(a, one[inside], "right")
            alone = ends - place[inside] == 1
            hit = inside[alone & (pair.f1[place[inside]] == two[inside])]
            others = [i for i, s, e in zip(inside[~alone], place[inside[~alone]], ends[~alone]) if two[i] in pair.f1[s:e]]
            start = block.at[np.concatenate([hit, np.array(others, np.int64)])]
            edge = np.bincount(start, minlength=n + 1).astype(np.int64) - np.bincount(start + window, minlength=n + 1)[: n + 1]
            gone = np.cumsum(edge)[:n] > 0
        w = block.words
        counts = np.diff(w.first)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        kept = []
        for i, text in enumerate(block.texts):
            words = text.translate(X._BLANK).split(b" ")
            words = [x for x in words if x]
            if removed[i]:
                words = [x for x, g in zip(words, gone[w.first[i] : w.first[i + 1]].tolist()) if not g]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=_OUT)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returns doc_id, n_words, n_removed and
    kept_text (the kept words joined by one space), one row per input row. A null or empty
    text has no words; repeated rows repeat each other's windows; a null doc_id stays null;
    other columns are ignored; an empty table gives an empty result. Windows are judged on
    the input; very long texts are taken whole.
    """
    docs = replayable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    total = text_bytes(docs)
    n_blocks = parts(total, BLOCK_BYTES)
    coarse, fine = levels(parts(total, BUCKET_BYTES))
    group = n_blocks if fine == 1 else _staging.FAN
    bits = max(16, min(62, (total // 6 * CELLS_PER_WINDOW).bit_length()))
    rows = docs.withColumn("uid", F.monotonically_increasing_id())  # the same whenever the rows are read
    rows = rows.withColumn("bkey", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("long"))
    dealt = rows.repartition(n_blocks, "bkey")
    kind, blocks = "key long, bkey long, payload binary", dealt.groupBy("bkey")

    def apply(groups, run) -> DataFrame:
        return groups.applyInArrow(X.on_tables(run, _DEALT), kind)

    def ask(requests: DataFrame, answer, up, down) -> DataFrame:
        """The answers to each block, given by the ranges, or by way of nodes that ask for several blocks."""
        if fine == 1:
            return apply(requests.groupBy("key"), answer)
        answers = apply(apply(requests.groupBy("key"), up).groupBy("key"), answer)
        return apply(requests.groupBy("key").cogroup(answers.groupBy("bkey")), down)

    merged = ask(apply(blocks, _sketch(window, bits, coarse, group)), _merge, _sketch_up(bits, coarse, fine), _sketch_down)
    likely = apply(blocks.cogroup(merged.groupBy("bkey")), _estimated(window, bits, coarse, group))
    exact = ask(likely, _group, _group_up(coarse, fine), _group_down)
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return blocks.cogroup(exact.groupBy("bkey")).applyInArrow(X.on_tables(_remove(window), _OUT), out)
