"""Approximate nearest neighbours by additive quantisation.

Vectors are written as sums of full-dimensional codewords, one of each residual codebook,
found by beam search; the index keeps codes and the norm of each sum, never the vectors.
Every chunk of queries meets every part of the index once, in a task of its own, and scores
its codes by lookup tables; the best of all parts are joined with their vectors and ranked
exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._staging import parts, stage

BOOKS, WORDS, BEAM = 40, 64, 3
#: Rows the codebooks are fitted on, at most.
SAMPLE = 8192
#: Rows of a part of the index, and queries of a chunk, at most.
PART_ROWS, QUERY_ROWS = 16_384, 1024
#: Parts that a task holds against a chunk, about.
PARTS_OF_SALT = 4
#: Best rows of each query by the index that are ranked exactly.
SHORTLIST = 512

_BLOCK = "ids binary, codes binary, norms binary"
_CHUNK = pa.schema([("chunk", pa.int64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary())])
_QUERIES = "chunk long, q_ids binary, q_vectors binary"


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) whose codewords sum close to x, by beam search over the books in order."""
    n = len(x)
    residual, codes, error = x[:, None, :], np.zeros((n, 1, 0), np.uint8), (x**2).sum(1)[:, None]
    for book in books:
        cost = error[:, :, None] - 2 * (residual @ book.T) + (book**2).sum(1)
        width = min(beam, cost.shape[1] * cost.shape[2])
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, width - 1, 1)[:, :width]
        error = np.take_along_axis(flat, best, 1)
        at, word = best // len(book), best % len(book)
        residual = np.take_along_axis(residual, at[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, at[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(n), error.argmin(1)]


def fit_books(x: np.ndarray, n_books: int = BOOKS, n_words: int = WORDS) -> np.ndarray:
    """Codebooks: k-means of residuals one after the other, then least squares for all together."""
    rng = np.random.default_rng(5)
    n_words = max(1, min(n_words, len(x)))
    books, residual = [], x.copy()
    for _ in range(n_books):
        book = residual[rng.choice(len(residual), n_words, replace=False)].copy()
        for _ in range(8):
            near = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
            count = np.bincount(near, minlength=n_words)
            sums = np.zeros_like(book)
            np.add.at(sums, near, residual)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
        near = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
        residual = residual - book[near]
        books.append(book)
    books = np.array(books)
    codes = encode(x, books)
    hot = np.zeros((len(x), n_books * n_words), np.float32)
    hot[np.arange(len(x))[:, None], codes + np.arange(n_books) * n_words] = 1
    gram = hot.T @ hot + 0.1 * np.eye(hot.shape[1], dtype=np.float32)
    start = books.reshape(-1, x.shape[1])
    solved = start + np.linalg.solve(gram, hot.T @ (x - hot @ start))
    return solved.reshape(books.shape).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))).astype(np.float32)


def _rows_of(batches, most: int):
    """(ids, vectors) of at most ``most`` rows at a time, across batches."""
    ids, vectors, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
            ids.append(part.column("vec_id").to_numpy(zero_copy_only=False))
            vectors.append(flat.reshape(part.num_rows, -1).astype(np.float64))
            held += part.num_rows
            while held >= most:
                i, x = np.concatenate(ids), np.concatenate(vectors)
                yield i[:most], x[:most]
                ids, vectors, held = [i[most:]], [x[most:]], held - most
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def _index(held):
    def run(batches):
        books = held.value
        for ids, x in _rows_of(batches, PART_ROWS):
            codes = np.concatenate([encode(_unit(x[i : i + 2048]), books) for i in range(0, len(x), 2048)])
            norms = np.concatenate([np.sqrt((books[np.arange(len(books)), c].sum(1) ** 2).sum(1)) for c in np.array_split(codes, -(-len(codes) // 2048))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([np.maximum(norms, 1e-12).astype("<f4").tobytes()], pa.binary())],
                ["ids", "codes", "norms"],
            )

    return run


def _chunk(key, batches):
    table = pa.Table.from_batches(list(batches)).sort_by("vec_id")
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ids = table.column("vec_id").to_numpy().astype("<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], schema=_CHUNK)


def _search(held, shortlist: int):
    """The best rows of a part for each query of a chunk, by the lookup tables."""

    def run(batches):
        books = held.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"], "<f4")
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(books))
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                q = _unit(np.frombuffer(row["q_vectors"]).reshape(len(q_ids), -1))
                for at in range(0, len(q), 256):
                    tables = np.einsum("qd,bwd->bqw", q[at : at + 256], books)
                    own = q_ids[at : at + 256]
                    score = np.zeros((len(own), len(ids)), np.float32)
                    for b in range(len(books)):
                        score += tables[b][:, codes[:, b]]
                    score /= norms
                    score[own[:, None] == ids[None, :]] = -np.inf
                    best = np.argpartition(-score, shortlist - 1, 1)[:, :shortlist] if shortlist < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
                    value = np.take_along_axis(score, best, 1)
                    real = value > -np.inf
                    of = np.broadcast_to(own[:, None], best.shape)[real]
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids[best][real]), pa.array(value[real])], ["query_id", "vec_id", "likely"])

    return run


def _scaled(vector: Column) -> Column:
    """A vector times the power of two that brings its largest component near 1: the same direction, bit for bit."""
    most = F.array_max(F.transform(vector, F.abs))
    factor = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(most)).cast("double"))))
    return F.element_at(F.transform(F.array(factor), lambda f: F.transform(vector, lambda v: v * f)), 1)  # so that f is computed once


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and scaled embedding (doubles) of the rows that take part: no null, non-finite or only zero components."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    e = e.where("vec_id is not null and embedding is not null").where(F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    return e.select("vec_id", _scaled(F.col("embedding")).alias("embedding"))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """The k nearest rows by cosine of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Candidates are all rows but those of the query's own vec_id; scores are exact cosines in
    double precision, ties go to the smaller vec_id. Rows with null, zero or non-finite
    vectors or a null vec_id take no part, nor do vectors of another length than most; very
    large and very small components are no exception. Rows that repeat both vec_id and
    direction count once; a vec_id with several vectors is one query, for the first of them
    in order, and several candidates; other columns are ignored; an empty table gives an
    empty result. Codebooks are fitted on a sample of at most SAMPLE rows; every row is
    indexed.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes[0]
    rows = stage(rows.where(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"]))
    lot = F.xxhash64("vec_id", "embedding", F.lit(11))
    likely = F.pmod(lot, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * SAMPLE / count))
    sample = rows.where(likely).orderBy(lot).limit(SAMPLE).select("embedding").collect()
    x = np.array([r[0] for r in sample] or rows.limit(1).select("embedding").first()[0]).reshape(-1, dim)
    held = spark.sparkContext.broadcast(fit_books(_unit(x)))
    queries = stage(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n_chunks = parts(queries.count(), QUERY_ROWS)
    index = stage(rows.mapInArrow(_index(held), _BLOCK))
    n_salts = parts(index.count(), PARTS_OF_SALT)
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # A chunk of queries meets the few parts of a salt in a task of its own, with codes but no vectors of the index.
    n_tasks = n_chunks * n_salts
    asked = queries.withColumn("chunk", of("vec_id", n_chunks)).groupBy("chunk").applyInArrow(X.on_tables(_chunk, _CHUNK), _QUERIES)
    asked = asked.withColumn("salt", every_of(n_salts)).repartition(n_tasks, "chunk", "salt")
    coded = index.withColumn("salt", of("ids", n_salts)).withColumn("chunk", every_of(n_chunks)).repartition(n_tasks, "chunk", "salt")
    met = coded.join(asked, ["chunk", "salt"]).select("ids", "codes", "norms", "q_ids", "q_vectors")
    found = met.mapInArrow(_search(held, shortlist), "query_id long, vec_id long, likely float")
    best = Window.partitionBy("query_id").orderBy(F.desc("likely"), "vec_id")
    short = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= shortlist).select("query_id", "vec_id").distinct()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(dot(a, a))
    exact = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), norm(F.col("embedding")).alias("q_norm"))
    scored = short.join(rows.select("vec_id", "embedding", norm(F.col("embedding")).alias("norm")), "vec_id").join(exact, "query_id")
    score = dot(F.col("embedding"), F.col("q")) / (F.col("norm") * F.col("q_norm"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
