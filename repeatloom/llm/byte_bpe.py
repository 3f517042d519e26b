"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Blocks of documents are cut into pre-tokens; each document keeps the positions of its
pre-tokens as indices into the block's dictionary, and the dictionary's words are
exploded by a hash of the word. One task per hash bucket encodes each distinct word
once for all blocks; the ids are joined back to the blocks that asked, where documents
are reassembled by position. Decoding joins ids with the token-byte table (fixed by the
vocabulary) and concatenates.

Both uses of the blocks read one exchange. What travels is the dictionaries and one or
two bytes per pre-token, never the texts. A block asks at most FAN buckets: beyond as many,
nodes in between gather the distinct words of FAN blocks, ask on and hand the answers back.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import _staging
from ._staging import levels, parts, replayable, text_bytes

BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000

_ROWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
_ANSWER = pa.schema([("key", pa.int64()), ("payload", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
_PARTS = "key long, doc_id long, bucket int, payload binary"
_RESULT = "doc_id long, n_tokens long, ids array<int>, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return parse_ranks(lines.read())


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


@lru_cache(2)
def _encoder(content: bytes):
    """The library's encoding of single pieces, and the bytes of each token."""
    import tiktoken

    ranks = parse_ranks(content)
    encoding = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return encoding.encode_ordinary, table


def pack_varints(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**35, seven bits a byte, the low ones first."""
    width = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        own = width > k
        out[at[own] + k] = ((values[own] >> 7 * k) & 0x7F) | np.where(width[own] > k + 1, 0x80, 0)
    return out.tobytes()


def unpack_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    width = ends - starts + 1
    out = np.zeros(len(starts), np.int64)
    for k in range(int(width.max(initial=0))):
        own = width > k
        out[own] |= (raw[starts[own] + k] & 0x7F).astype(np.int64) << 7 * k
    return out


def _pack_parts(*parts: bytes) -> bytes:
    """Several byte strings, compressed together."""
    return zstandard.compress(struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts), 3)


def _unpack_parts(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(data)
    sizes = struct.unpack_from(f"<{n}Q", raw)
    ends = np.cumsum([8 * n, *sizes]).tolist()
    return [raw[i:j] for i, j in zip(ends, ends[1:])]


def _cut_up(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[i:j] for i, j in zip([0, *ends], ends)]


def _sizes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


def distinct_pieces(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> tuple[list[str], np.ndarray]:
    """The distinct pieces, the most frequent first, and each piece's index among them.

    Pieces are grouped by hash and every piece is compared with the first of its group; a
    block in which two pieces should share a hash is told apart by the strings instead.
    """
    hashes = X.slice_hashes(cps, starts, ends)
    _, where, index, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lengths = ends - starts
    first = where[index]
    if (lengths != lengths[first]).any() or not X.equal_slices(cps, starts, starts[first], lengths):
        seen: dict[str, int] = {}
        index = np.array([seen.setdefault(joined[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])
        return list(seen), index
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    where = where[order]
    words = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
    return words, rank[index]


def _buckets(words: list[bytes], n: int) -> np.ndarray:
    """The bucket of each word, by its hash."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    return (X.slice_hashes(flat, np.concatenate([[0], stop[:-1]]), stop) % np.uint64(n)).astype(np.int64)


def _requests(raw: list[bytes], bucket: np.ndarray, sender: int, base: int):
    """A row per bucket with its words, and their places among all."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    edges = [*first.tolist(), len(order)]
    blobs = [
        struct.pack("<q", sender) + _pack_parts(pack_varints(np.diff(order[i:j], prepend=0)), pack_varints(_sizes(own)), b"".join(own))
        for i, j in zip(edges, edges[1:])
        for own in [[raw[k] for k in order[i:j].tolist()]]
    ]
    columns = [pa.array((-1 - base - used).tolist(), pa.int64()), pa.nulls(len(blobs), pa.int64()), pa.array(used.tolist(), pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def _cut(coarse: int, fine: int, groups: int):
    """Blocks of documents: a row per document, and a row per coarse bucket with the block's distinct words."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, block in enumerate(X.text_blocks(batches, BLOCK_BYTES)):
            key = (task << 24) + number  # as the rows are replayable, a task that runs again numbers its blocks alike
            texts = [t or "" for t in block.column("text").to_pylist()]
            joined = "".join(texts)
            cps, offsets = X.code_points(texts)
            starts = X.byte_bpe_pieces(cps, offsets)
            ends = np.append(starts[1:], len(cps)) if len(starts) else starts
            words, index = distinct_pieces(cps, starts, ends, joined) if len(starts) else ([], starts)
            of = np.searchsorted(starts, offsets)
            rows = len(texts)
            packer = zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * rows, pa.int64()),
                    block.column("doc_id"),
                    pa.array([-1] * rows, pa.int32()),
                    pa.array([packer.compress(pack_varints(index[of[i] : of[i + 1]])) for i in range(rows)], pa.binary()),
                ],
                ["key", "doc_id", "bucket", "payload"],
            )
            if not words:
                continue
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            group = int(X.mix(np.array([key], np.uint64))[0] % np.uint64(groups))
            yield _requests(raw, _buckets(raw, coarse * fine) // fine, key, group * coarse)

    return run


def _asked(batches) -> list[tuple[int, np.ndarray, list[bytes]]]:
    """(sender, packed places, words) of the requests among the rows."""
    out = []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if bucket >= 0:
                blob = payload.as_py()
                places, sizes, words = _unpack_parts(blob[8:], 3)
                out.append((*struct.unpack_from("<q", blob), places, _cut_up(words, unpack_varints(sizes))))
    return out


def _ask_on(coarse: int, fine: int):
    """The distinct words of a coarse bucket's requests, asked once of the fine buckets of its share."""

    def run(key, batches):
        asked = _asked(batches)
        if asked:
            raw = sorted({w for *_, words in asked for w in words})  # in an order that does not depend on who came first
            yield _requests(raw, _buckets(raw, coarse * fine), key[0].as_py(), 0)

    return run


def _hand_back(key, left, right):
    """The answers to a coarse bucket, for each of the blocks that asked it."""
    asked = _asked(left)
    if asked:
        place = {w: k for k, w in enumerate(sorted({w for *_, words in asked for w in words}))}
        known = [b""] * len(place)
        for k, ids in _answers(right):
            known[k] = ids
        yield _told([(block, places, [known[place[w]] for w in words]) for block, places, words in asked])


def _told(answers: list) -> pa.RecordBatch:
    """A row for each sender: its places, and for each the ids; of these the upper bytes are mostly alike."""
    payloads = []
    for _, places, ids in answers:
        planes = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 4).T.tobytes()
        payloads.append(_pack_parts(places, pack_varints(_sizes(ids) // 4), planes))
    return pa.RecordBatch.from_arrays([pa.array([a[0] for a in answers], pa.int64()), pa.array(payloads, pa.binary())], schema=_ANSWER)


def _answers(batches):
    """(place, ids) of all words that were answered."""
    for batch in batches:
        for payload in batch.column("payload"):
            places, sizes, planes = _unpack_parts(payload.as_py(), 3)
            ids = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).tobytes()
            yield from zip(np.cumsum(unpack_varints(places)).tolist(), _cut_up(ids, unpack_varints(sizes) * 4))


def _encode(held):
    """Encode each distinct word of a bucket once; an answer row for every sender that asked for some of its words."""

    def run(key, batches):
        encode, _ = _encoder(held.value)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            told = []
            for sender, places, words in _asked([batch]):
                answers = []
                for word in words:
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                    answers.append(ids)
                told.append((sender, places, answers))
            if told:
                yield _told(told)

    return run


def _reassemble(held):
    """Join the ids back to the documents of a block, by position, and decode them again with the token-byte table."""

    def run(key, left, right):
        _, token_bytes = _encoder(held.value)
        told = dict(_answers(right))
        encoded = [told[k] for k in range(len(told))]  # every word of the block is answered
        decoded = [b"".join([token_bytes[i] for i in struct.unpack(f"<{len(answer) // 4}I", answer)]) for answer in encoded]
        unpacker = zstandard.ZstdDecompressor()
        for batch in left:
            docs, ids, texts = [], [], []
            for doc, bucket, payload in zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("payload")):
                if bucket >= 0:
                    continue
                steps = unpack_varints(unpacker.decompress(payload.as_py())).tolist()
                docs.append(doc)
                ids.append(b"".join([encoded[k] for k in steps]))
                texts.append(b"".join([decoded[k] for k in steps]))
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes), lists, pa.array(texts, pa.binary())], schema=_OUT)

    return run


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode ``text`` of every row of ``docs`` and decode it again.

    Returns doc_id, n_tokens, ids and decoded (bytes), one row per input row. A null or
    empty text has no tokens and decodes to nothing; repeated rows give repeated rows; a
    null doc_id stays null; other columns are ignored; an empty table gives an empty
    result. Very long texts form a block of their own.
    """
    docs = replayable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    with open(ranks_path, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    total = text_bytes(docs)
    n_blocks = parts(total, BLOCK_BYTES)
    coarse, fine = levels(parts(total, BUCKET_BYTES))
    groups = 1 if fine == 1 else parts(n_blocks, _staging.FAN)
    dealt = docs.mapInArrow(_cut(coarse, fine, groups), _PARTS).repartition(coarse * groups + n_blocks, "key")
    answer, asked = "key long, payload binary", dealt.groupBy("key")
    encode = X.on_tables(_encode(held), _ANSWER)
    if fine == 1:
        answers = asked.applyInArrow(encode, answer)
    else:
        answers = asked.applyInArrow(X.on_tables(_ask_on(coarse, fine), _ROWS), _PARTS).groupBy("key").applyInArrow(encode, answer)
        answers = asked.cogroup(answers.groupBy("key")).applyInArrow(X.on_tables(_hand_back, _ANSWER), answer)
    return dealt.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(X.on_tables(_reassemble(held), _OUT), _RESULT)
