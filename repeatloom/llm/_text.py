"""Vectorised text scanning shared by the operators that run on Arrow batches.

Texts are scanned as flat arrays (UTF-8 bytes or code points) so that splitting and
hashing cost a few array passes per character instead of a Python call per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Classes of code points: letters (L*), numbers (N*), white space, everything else.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own pattern engine has it.

    A pattern of one class is matched against all code points, and what it finds comes back
    as bytes; so the table follows the library's Unicode version and not Python's.
    """
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        finder = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for first in range(0, 0x110000, 1 << 15):
            every = "".join(chr(c) for c in range(first, first + (1 << 15)) if not 0xD800 <= c < 0xE000)
            found = bytes(finder.encode_ordinary(every)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def text_blocks(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``max_bytes`` of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter(
            (0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()),
            np.int64, batch.num_rows,
        )
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offset of each text (one more than there are texts)."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return cps, offsets


def _text_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    flags = np.zeros(n + 1, bool)
    flags[offsets] = True
    return flags


def run_starts(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of positions where the class changes or a text begins."""
    starts = np.empty(len(cls), bool)
    if len(cls):
        starts[0] = True
        np.not_equal(cls[1:], cls[:-1], out=starts[1:])
        starts |= first[: len(cls)]
    return starts


def _split_contractions(cps, cls, starts, first, at) -> None:
    """Let an apostrophe that stands alone take s, t, m, d, re, ve or ll from the letters after it."""
    n = len(cps)
    at = at[(at + 1 < n)]
    at = at[starts[at + 1] & (cls[at + 1] == LETTER) & ~first[at + 1]]
    one = cps[at + 1]
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], cps[np.minimum(at + 2, n - 1)], 0)
    o = {c: ord(c) for c in "stmdrevl"}
    short = (one == o["s"]) | (one == o["t"]) | (one == o["m"]) | (one == o["d"])
    long = ((one == o["r"]) & (two == o["e"])) | ((one == o["v"]) & (two == o["e"])) | ((one == o["l"]) & (two == o["l"]))
    starts[at[short | long] + 1] = False
    for hits, width in ((at[short], 2), (at[long], 3)):
        after = hits + width
        starts[after[after < n]] = True


def byte_bpe_pieces(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of the matches of the byte-level BPE pattern; each ends where the next begins.

    The pattern: contractions, letters, numbers or other characters with one optional
    space before them, white space that leaves its last character to what follows.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    cls = char_classes()[cps]
    first = _text_starts(offsets, n)
    starts = run_starts(cls, first)
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    starts[last] = True
    starts[last[cps[last] == 0x20] + 1] = False
    _split_contractions(cps, cls, starts, first, np.flatnonzero((cps == 0x27) & starts))
    return np.flatnonzero(starts)


def word_bpe_pieces(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of contractions, letter runs, single numbers and runs of other characters."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = char_classes()[cps]
    first = _text_starts(offsets, n)
    starts = run_starts(cls, first)
    starts |= cls == NUMBER
    _split_contractions(cps, cls, starts, first, np.flatnonzero((cps == 0x27) & starts))
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], n)
    kept = cls[at] != SPACE
    return at[kept], ends[kept]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads all bits (fixed constants of a published 64-bit mixer)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


GOLDEN = 0x9E3779B97F4A7C15
#: Slices of more bytes are hashed one by one with a keyed digest.
LONG = 512
#: n-grams hashed at a time, which bounds intermediate arrays.
CHUNK = 1 << 16


def _start(seed: int) -> np.uint64:
    return mix(np.array([(seed + 1) * GOLDEN % 2**64], U64))[0]


def _as_lanes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The array's bytes, and the eight bytes from each place on as one number (zeros after the end)."""
    raw = np.zeros(symbols.nbytes + 8, np.uint8)
    raw[:-8] = np.ascontiguousarray(symbols).view(np.uint8)
    return raw, np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, of which only ``left`` belong to the slice."""
    value = lanes[at].astype(U64)
    short = np.flatnonzero(left < 8)
    value[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
    return value


def slice_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of slices of an array of bytes, code points or hashes.

    Eight bytes at a time go through the mixer, so that no algebraic relation of two slices
    makes them collide; long slices get a keyed digest.
    """
    raw, lanes = _as_lanes(symbols)
    width = symbols.itemsize
    at, size = np.asarray(starts, np.int64) * width, (np.asarray(ends, np.int64) - starts) * width
    out = mix(size.astype(U64) * U64(GOLDEN) ^ _start(seed))
    short = size <= LONG
    live = np.flatnonzero(short & (size > 0))
    done = 0
    while len(live):
        out[live] = mix(out[live] ^ _lane(lanes, at[live] + done, size[live] - done))
        done += 8
        live = live[size[live] > done]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + size[i]], digest_size=8, key=key).digest(), "little")
    return out


def equal_slices(symbols: np.ndarray, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether each slice that begins at first holds the same symbols as the one, as long, at second."""
    raw, lanes = _as_lanes(symbols)
    width = symbols.itemsize
    live = np.flatnonzero(first != second)
    a, b, size = first[live] * width, second[live] * width, lengths[live] * width
    long = size > LONG
    for i, j, n in zip(a[long].tolist(), b[long].tolist(), size[long].tolist()):
        if not np.array_equal(raw[i : i + n], raw[j : j + n]):
            return False
    a, b, size = a[~long], b[~long], size[~long]
    while len(a):
        if (_lane(lanes, a, size) != _lane(lanes, b, size)).any():
            return False
        more = size > 8
        a, b, size = a[more] + 8, b[more] + 8, size[more] - 8
    return True


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def _ngrams(words: np.ndarray, n: int, start: np.uint64) -> np.ndarray:
    """Hashes of n consecutive words from those of runs of 1, 2, 4 ... words."""
    count = len(words) - n + 1
    runs, size, taken, out = mix(words ^ start), 1, 0, None
    while size <= n:
        if n & size:
            part = runs[taken : taken + count]
            out = part if out is None else _joined(out, part)
            taken += size
        if 2 * size <= n:
            runs = _joined(runs[:-size], runs[size:])
        size *= 2
    return out


def ngram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of every n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    start, out = _start(seed + 100), np.empty(count, U64)
    for i in range(0, count, CHUNK):
        out[i : i + CHUNK] = _ngrams(words[i : i + CHUNK + n - 1], n, start)
    return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BLANK = bytes(32 if 9 <= c <= 13 else c for c in range(256))


class ByteWords:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: buffer, starts, ends, and first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts).translate(_LOWER if lower else _BLANK)
        self.buffer = joined
        self.bytes = np.frombuffer(joined, np.uint8)
        edge = np.zeros(len(joined) + 2, np.int8)
        edge[1:-1] = self.bytes != 32
        step = np.diff(edge)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.first = np.searchsorted(self.starts, offsets)  # of text i, and where text i ends

    def hashes(self, seed: int = 1) -> np.ndarray:
        return slice_hashes(self.bytes, self.starts, self.ends, seed)


def pack_deltas(sorted_values: np.ndarray) -> bytes:
    """A sorted uint64 array as a byte width and its first differences cut to that width."""
    if not len(sorted_values):
        return b"\x00"
    deltas = np.empty(len(sorted_values), U64)
    deltas[0] = sorted_values[0]
    np.subtract(sorted_values[1:], sorted_values[:-1], out=deltas[1:])
    head, rest = deltas[:1], deltas[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    body = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + head.astype("<u8").tobytes() + body.tobytes()


def unpack_deltas(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(0, U64)
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    deltas = np.zeros((len(body) + 1, 8), np.uint8)
    deltas[0] = np.frombuffer(data, np.uint8, 8, 1)
    deltas[1:, :width] = body
    return np.cumsum(deltas.reshape(-1).view("<u8"), dtype=U64)


def on_tables(run, schema: pa.Schema):
    """A function of a key and the record batches of one or two groups, as Spark's grouped Arrow functions want it."""

    def grouped(key, table):
        return pa.Table.from_batches(list(run(key, table.to_batches())), schema)

    def cogrouped(key, left, right):
        return pa.Table.from_batches(list(run(key, left.to_batches(), right.to_batches())), schema)

    return cogrouped if run.__code__.co_argcount == 3 else grouped
