"""N-gram Jaccard join with token-combination prefixes.

1. Blocks of documents turn texts into sets of shingle hashes; each block deals its
   hashes, sorted and delta-coded, to hash-range buckets.
2. A bucket finds the shingles that at least two different sets hold and how many do.
   All other shingles cannot be shared, so a set with too few shared ones has no link.
3. Each remaining set orders its shared shingles from rare to frequent and takes a prefix.
   Rare shingles are indexed alone; the frequent class is divided into sub-classes by
   hash, and pairs of shingles of one sub-class are indexed. The prefix is extended until
   more shingles are covered than the set may miss, one per sub-class not counting, so
   that two linked sets always share a signature.
4. Candidates are verified on the exact sets. First every set is held against the most
   typical set under each of its signatures, the head; sets already connected need no
   further pair. Two sets of different components under one head either both share enough
   with it, or a link needs a shingle that the head lacks; pairs are generated by that.

A block or bucket deals at most FAN rows: beyond as many buckets, nodes in between gather
what FAN of them hold for a share of the buckets, and deal it on.

Sets are told apart by a 64-bit fingerprint of their sorted hashes, shingles by a 64-bit
hash: among n different sets two share a fingerprint with probability n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import _staging
from ._staging import levels, parts, stage, text_bytes
from .components import components

BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 12_000_000
WORDS = 5
#: Shingles that more sets hold are indexed in pairs.
FREQUENT = 32
#: Ratio of set sizes between two levels; linked sets are at most one level apart.
LEVEL = 1.4

U64 = np.uint64
_DEALT = "bucket int, fps binary, sizes binary, docs array<long>, doc_fps array<long>, doc_sizes array<long>, hashes binary, ords binary"
_LONGS = pa.list_(pa.int64())
_DEALT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("fps", pa.binary()), ("sizes", pa.binary()), ("docs", _LONGS), ("doc_fps", _LONGS), ("doc_sizes", _LONGS), ("hashes", pa.binary()), ("ords", pa.binary())]
)
_FOUND_TYPES = "doc_id long, fp long, n long, dest int, fps binary, sizes binary, tokens binary, counts binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("dest", pa.int32()), *((c, pa.binary()) for c in ("fps", "sizes", "tokens", "counts"))])
_SETS = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sigs", pa.list_(pa.int64()))])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, fewer words than a shingle taken as one."""
    w = X.ByteWords(texts, lower=True)
    hashes = w.hashes()
    grams = X.ngram_hashes(hashes, words)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(X.ngram_hashes(hashes[a:b], b - a, 10 + b - a))  # seeds apart from that of whole shingles
        else:
            out.append(np.zeros(0, U64))
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    ends = np.cumsum([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return X.slice_hashes(X.mix(flat), starts, ends, 7)


def _bounds(n_buckets: int) -> np.ndarray:
    """Where the hashes of each bucket begin."""
    return np.array([(b << 64) // n_buckets for b in range(n_buckets)], U64)


def _deal(n_buckets: int, groups: int):
    """Blocks of documents dealt by hash to buckets, those of the block's group."""

    def run(batches):
        for block in X.text_blocks(batches, BLOCK_BYTES):
            for at in range(0, block.num_rows, 60_000):
                yield from one(block.slice(at, 60_000))

    def one(block):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()]
        sets = shingle_sets(texts)
        fps = fingerprints(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        _, where = np.unique(fps, return_index=True)
        where = where[sizes[where] > 0]
        ids = block.column("doc_id").to_pylist()
        home = np.arange(len(texts)) % n_buckets
        if len(where):
            flat = np.concatenate([sets[i] for i in where])
            ords = np.repeat(np.arange(len(where), dtype=np.uint16), sizes[where])
            order = np.argsort(flat)
            flat, ords = flat[order], ords[order]
        else:
            flat, ords = np.zeros(0, U64), np.zeros(0, np.uint16)
        edges = [*np.searchsorted(flat, _bounds(n_buckets)).tolist(), len(flat)]
        doc_fps, doc_sizes = fps.view(np.int64), sizes
        base = int(np.bitwise_xor.reduce(fps) % U64(groups)) * n_buckets if len(fps) else 0
        columns = [[] for _ in range(8)]
        for b in range(n_buckets):
            own = np.flatnonzero(home == b)
            i, j = edges[b], edges[b + 1]
            if i == j and not len(own):
                continue
            used, local = np.unique(ords[i:j], return_inverse=True)
            row = (
                base + b, fps[where][used].tobytes(), sizes[where][used].astype("<u4").tobytes(),
                [ids[k] for k in own], doc_fps[own].tolist(), doc_sizes[own].tolist(),
                X.pack_deltas(flat[i:j]), local.astype("<u2").tobytes(),
            )
            for column, value in zip(columns, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, _DEALT_ARROW)], schema=_DEALT_ARROW)

    return run


def _held(batch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, fingerprints, sizes) of the sets that hold them, for each row."""
    out = []
    for f, s, h, o in zip(*(batch.column(c) for c in ("fps", "sizes", "hashes", "ords"))):
        own, places = X.unpack_deltas(h.as_py()), o.as_py()
        at = np.frombuffer(places, "<u2" if len(places) == 2 * len(own) else "<u4")
        out.append((own, np.frombuffer(f.as_py(), U64)[at], np.frombuffer(s.as_py(), "<u4")[at]))
    return out


def _members(batch) -> list[pa.Array]:
    return [pa.chunked_array([batch.column(c)]).combine_chunks().flatten() for c in ("docs", "doc_fps", "doc_sizes")]


def _deal_on(coarse: int, fine: int):
    """What a node gathered, dealt to the buckets of its share; its documents go to the first of them."""

    def run(key, batches):
        rows, docs = [], [[], [], []]
        for batch in batches:
            rows += _held(batch)
            for column, own in zip(docs, _members(batch)):
                column += own.to_pylist()
        h, f, s = (np.concatenate([r[k] for r in rows]) for k in range(3))
        order = np.argsort(h, kind="stable")
        h, f, s = h[order], f[order], s[order]
        edges = [*np.searchsorted(h, _bounds(coarse * fine)).tolist(), len(h)]
        first = key[0].as_py() % coarse * fine
        columns = [[] for _ in _DEALT_ARROW]
        for b in range(first, first + fine):
            i, j = edges[b], edges[b + 1]
            own = docs if b == first else ([], [], [])
            if i < j or own[0]:
                sets, where, local = np.unique(f[i:j], return_index=True, return_inverse=True)
                row = (b, sets.tobytes(), s[i:j][where].astype("<u4").tobytes(), *own, X.pack_deltas(h[i:j]), local.astype("<u4").tobytes())
                for column, value in zip(columns, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, _DEALT_ARROW)], schema=_DEALT_ARROW)

    return run


def _shared(coarse: int, fine: int):
    return lambda key, batches: _shared_of(key[0].as_py(), batches, coarse, fine)


def _shared_of(bucket, batches, coarse, fine):
    """A row for each document dealt here, and the shingles of this bucket that several sets hold, dealt by set."""
    hashes, fps, sizes = [], [], []
    for batch in batches:
        docs, doc_fps, doc_sizes = _members(batch)
        none = pa.nulls(len(docs), pa.binary())
        yield pa.RecordBatch.from_arrays([docs, doc_fps, doc_sizes, pa.nulls(len(docs), pa.int32()), none, none, none, none], schema=_FOUND)
        for own, f, s in _held(batch):
            hashes.append(own)
            fps.append(f)
            sizes.append(s)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    if not len(h):
        return
    order = np.argsort(h)
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    np.equal(h[1:], h[:-1], out=same[1:-1])
    order = order[same[1:] | same[:-1]]
    h, f, s = (np.concatenate(x)[order] for x in (hashes, fps, sizes))
    order = np.lexsort((f, h))
    h, f, s = h[order], f[order], s[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
    h, f, s = h[fresh], f[fresh], s[fresh]
    if not len(h):
        return
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(first, len(h)))
    held = np.repeat(count, count)
    kept = held > 1
    h, f, s, held = h[kept], f[kept], s[kept], held[kept].astype("<u4")
    dest = (f % U64(coarse * fine)).astype(np.int32)
    yield _deal_sets(f, s, h, held, dest if fine == 1 else bucket % fine * coarse + dest // fine)


def _deal_sets(f, s, h, held, dest) -> pa.RecordBatch:
    """Shingles of sets, packed by where they go."""
    order = np.argsort(dest, kind="stable")
    h, f, s, held, dest = h[order], f[order], s[order].astype("<u4"), held[order].astype("<u4"), dest[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1]])) if len(dest) else np.zeros(0, np.int64)
    cut = list(zip(first.tolist(), [*first[1:].tolist(), len(dest)]))
    none = pa.nulls(len(cut), pa.int64())
    packed = [pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (f, s, h, held)]
    return pa.RecordBatch.from_arrays([none, none, none, pa.array(dest[first]), *packed], schema=_FOUND)


def _sets_of(batches) -> list[np.ndarray]:
    """Fingerprints, sizes, shingles and how many sets hold them."""
    columns = {c: [] for c in ("fps", "sizes", "tokens", "counts")}
    for batch in batches:
        for c, kind in (("fps", U64), ("sizes", "<u4"), ("tokens", U64), ("counts", "<u4")):
            columns[c] += [np.frombuffer(x.as_py(), kind) for x in batch.column(c)]
    return [np.concatenate(x) for x in columns.values()]


def _deal_sets_on(coarse: int, fine: int):
    """What a node gathered of several buckets, dealt to the places of the sets in its share."""

    def run(key, batches):
        f, s, h, held = _sets_of(batches)
        yield _deal_sets(f, s, h, held, (f % U64(coarse * fine)).astype(np.int32))

    return run


def signatures(n: int, tokens: np.ndarray, held: np.ndarray, frequent: int = FREQUENT) -> np.ndarray:
    """Signatures of a set of n shingles, of which ``tokens`` are held by others too (``held``: by how many sets)."""
    order = np.lexsort((tokens, held))
    tokens, held = tokens[order], held[order]
    need = n // 4 - (n - len(tokens)) + 1
    if need <= 0:
        return np.zeros(0, np.int64)
    rare = int(np.searchsorted(held, frequent, "right"))
    out = [X.mix(tokens[: min(rare, need)])]
    if rare < need:
        common = tokens[rare:]
        level = int(np.log(n) / np.log(LEVEL))
        for at in (level, level + 1):
            group = X.mix(common + U64(at * 2 + 1)) % U64(max(1, int(LEVEL**at / 12)))
            by = np.argsort(group, kind="stable")
            new = np.concatenate([[True], group[by][1:] != group[by][:-1]])
            first = np.zeros(len(common), bool)
            first[by[new]] = True
            gain = np.cumsum(~first)
            stop = int(np.searchsorted(gain, need - rare)) + 1
            by = by[by < stop]
            edges = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1], [True]]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if j - i > 1:
                    own = np.sort(common[by[i:j]])
                    a, b = np.triu_indices(j - i, 1)
                    out.append(X.mix(X.mix(own[a]) * U64(3) + X.mix(own[b]) + U64(at)))
    return np.concatenate(out).view(np.int64)


def _index(key, batches):
    """Sets that could have a link, with their shared shingles and signatures."""
    f, n, tokens, held = _sets_of(batches)
    order = np.argsort(f, kind="stable")
    f, n, tokens, held = f[order], n[order], tokens[order], held[order]
    first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
    rows = ([], [], [], [], [])
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(f)]):
        size = int(n[i])
        if 4 * (j - i) >= 3 * size:
            sigs = signatures(size, tokens[i:j], held[i:j])
            if len(sigs):
                for column, value in zip(rows, (int(f[i : i + 1].view(np.int64)[0]), size, j - i, np.sort(tokens[i:j]).view(np.int64), np.unique(sigs))):
                    column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(rows, _SETS)], schema=_SETS)


def _enough(shared, n_a, n_b):
    """100 * shared >= 75 * (n_a + n_b - shared), in whole numbers."""
    return shared * F.lit(7) >= (n_a + n_b) * F.lit(3)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of both sets and how many shingles they share."""
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"), F.col("tokens").alias("t_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.select("a", "b", "n_a", "s_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).cast("long").alias("both"))


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(_enough(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _across(sets: DataFrame, sigs: DataFrame, heads: DataFrame, star: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of sets in different components that may be linked.

    Both lie under one head, a set that each has been held against. Let x and y share
    i_x and i_y shingles with it. If both are enough for a link, the pair is taken;
    otherwise a link needs a shingle that the head lacks, and the pair is found by that.
    """
    placed = sigs.join(heads.select("sig", F.col("p.fp").alias("head")), "sig").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    for _ in range(2):  # of a bucket, keep sets that the smallest set of several components could match
        within = placed.groupBy("sig").agg(F.min("n").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        placed = placed.join(within, "sig").where(_enough(F.col("s"), F.col("n"), F.col("least"))).select("sig", "head", "fp", "n", "s", "root")
    under = placed.select("head", "fp", "root").distinct().join(star.select(F.col("b").alias("head"), F.col("a").alias("fp"), F.col("n_a").alias("n"), F.col("s_a").alias("s"), F.col("both").alias("i")), ["head", "fp"])
    under = stage(under)
    mine, heads_own = sets.select("fp", "tokens"), sets.select(F.col("fp").alias("head"), F.col("tokens").alias("t_head"))
    rest = under.join(mine, "fp").join(heads_own, "head").withColumn("token", F.explode(F.array_except("tokens", "t_head"))).drop("tokens", "t_head")

    def meet(rows: DataFrame, on: list[str], enough_alone: bool) -> DataFrame:
        left, right = (rows.select(*on, *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "s", "i", "root"))) for side in "xy")
        common, n_x, n_y = F.least("i_x", "i_y"), F.col("n_x"), F.col("n_y")
        alone = _enough(common, n_x, n_y)
        most = common + F.least(F.col("s_x") - F.col("i_x"), F.col("s_y") - F.col("i_y"))
        fits = alone if enough_alone else ~alone & _enough(most, n_x, n_y)
        found = left.join(right, on).where((F.col("root_x") < F.col("root_y")) & fits)
        return found.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b"))

    return meet(under, ["head"], True).unionByName(meet(rest, ["head", "token"], False)).distinct()


def _links(sets: DataFrame) -> DataFrame:
    """(node, root) of all sets linked with others."""
    sigs = sets.select("fp", "n", "s", F.explode("sigs").alias("sig"))
    typical = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("missed"), "fp")).alias("p")
    heads = stage(sigs.groupBy("sig").agg(F.count("*").alias("m"), typical).where("m > 1").drop("m"))
    star = sigs.join(heads, "sig").where(F.col("fp") != F.col("p.fp")).select(F.col("fp").alias("a"), F.col("p.fp").alias("b")).distinct()
    star = stage(_verified(star, sets))
    near = _linked(star)
    roots = stage(components(near))
    more = _linked(_verified(_across(sets, sigs, heads, star, roots), sets))
    return components(near.unionByName(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents linked by Jaccard similarity 0.75 or more of their 5-word shingle sets.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, itself included). A null text, or one without words, has an empty
    set, no link, and its own doc_id as component. Repeated rows and exact copies share a
    component; rows with a null doc_id link like others but are nobody's smallest; other
    columns are ignored; an empty table gives an empty result. A text of fewer than five
    words is one shingle; very long texts are taken whole.
    """
    total = text_bytes(docs)
    coarse, fine = levels(parts(total, BUCKET_BYTES))
    groups = 1 if fine == 1 else parts(parts(total, BLOCK_BYTES), _staging.FAN)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_deal(coarse, groups), _DEALT)
    if fine > 1:
        dealt = dealt.groupBy("bucket").applyInArrow(X.on_tables(_deal_on(coarse, fine), _DEALT_ARROW), _DEALT)
    found = stage(dealt.groupBy("bucket").applyInArrow(X.on_tables(_shared(coarse, fine), _FOUND), _FOUND_TYPES))
    held = found.where("dest is not null")
    if fine > 1:
        held = held.groupBy("dest").applyInArrow(X.on_tables(_deal_sets_on(coarse, fine), _FOUND), _FOUND_TYPES)
    members = found.where("dest is null").select("doc_id", "fp", F.col("n").alias("n_shingles"))
    sets = stage(
        held.select("dest", "fps", "sizes", "tokens", "counts")
        .groupBy("dest")
        .applyInArrow(X.on_tables(_index, _SETS), "fp long, n long, s long, tokens array<long>, sigs array<long>")
    )
    roots = stage(_links(sets))
    lowest = members.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labels = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = lowest.join(labels, "root").select("fp", "component_id")
    none = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.where("n_shingles > 0").join(labels, "fp").select("doc_id", "n_shingles", "component_id").unionByName(none)
