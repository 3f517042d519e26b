"""Quality classifier: a sparse ensemble of rules over statistics of texts.

Boosted shallow trees are fitted on labelled rows; every path from a root to a node is a
conjunctive rule. A lasso logistic regression weighs the rules and drops most, and the
rest compile into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

BLOCK_BYTES = 2_000_000
#: Most labelled documents the classifier is fitted on; with more, a sample by hash of doc_id.
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 24
LASSO = 1e-3

STATISTICS = [
    "chars", "words", "upper", "shouted", "symbols", "bangs", "bars", "stops", "commas", "digits", "breaks",
    "word_length", "length_spread", "distinct", "echoed", "pairs_again", "lines_again", "glued", "short", "tailed", "lone",
]


def text_statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    cps, offsets = X.code_points(texts)
    size = np.maximum(np.diff(offsets), 1)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    cls = X.char_classes()[cps] if len(cps) else np.zeros(0, np.uint8)
    first = X._text_starts(offsets, len(cps))
    per_text = lambda flags: np.bincount(text_of[flags], minlength=n)
    letters = cls == X.LETTER
    low = cps < 0x250
    upper_table = np.array([chr(c).isupper() for c in range(0x250)])
    upper = np.zeros(len(cps), bool)
    upper[low] = upper_table[cps[low]]
    odd_table = np.zeros(128, bool)
    odd_table[[ord(c) for c in "*%&$#|<>=~^_{}[]\\/@+"]] = True
    odd = np.zeros(len(cps), bool)
    odd[cps < 128] = odd_table[cps[cps < 128]]
    space = cls == X.SPACE
    runs = np.flatnonzero(X.run_starts(space, first)) if len(cps) else np.zeros(0, np.int64)
    ends = np.append(runs[1:], len(cps)) if len(runs) else runs
    own = ~space[runs]
    starts, ends = runs[own], ends[own]
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    within = lambda flags: (lambda t: t[ends] - t[starts])(total(flags))
    word_text = text_of[starts]
    n_words = np.bincount(word_text, minlength=n)
    words = np.maximum(n_words, 1)
    share = lambda flags: np.bincount(word_text, weights=flags, minlength=n) / words
    length = ends - starts
    hashes = X.slice_hashes(cps, starts, ends)
    with_letters, with_upper = within(letters), within(upper)
    mean = share(length)
    spread = np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean**2, 0))
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_text[1:] == word_text[:-1])

    def repeated(values, of):
        """How many of a text's values it has had before."""
        order = np.lexsort((values, of))
        v, t = values[order], of[order]
        dup = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
        return np.bincount(t[1:][dup], minlength=n)

    pair = X.ngram_hashes(hashes, 2)
    pair_text = word_text[:-1][word_text[1:] == word_text[:-1]]
    pairs = pair[word_text[1:] == word_text[:-1]] if len(pair) else pair
    breaks = cps == 10
    line = np.flatnonzero(X.run_starts(breaks, first)) if len(cps) else np.zeros(0, np.int64)
    line_end = np.append(line[1:], len(cps)) if len(line) else line
    real = ~breaks[line]
    line, line_end = line[real], line_end[real]
    line_hash = X.slice_hashes(cps, line, line_end)
    lines = np.maximum(np.bincount(text_of[line], minlength=n), 1)
    lasting = cls == X.OTHER
    inner = within(lasting) - lasting[np.maximum(ends - 1, 0)] if len(ends) else within(lasting)
    tail = odd[ends - 1] if len(ends) else np.zeros(0, bool)
    per_char = lambda flags: per_text(flags) / size
    columns = [
        np.log1p(np.diff(offsets)), np.log1p(n_words), per_text(upper) / np.maximum(per_text(letters), 1),
        share((with_letters > 1) & (with_upper == with_letters)), per_char(odd), per_char(cps == ord("!")), per_char(cps == ord("|")),
        per_char(cps == ord(".")), per_char(cps == ord(",")), per_char(cls == X.NUMBER), per_char(breaks), mean, spread,
        1 - repeated(hashes, word_text) / words, share(again), repeated(pairs, pair_text) / words, repeated(line_hash, text_of[line]) / lines,
        share((inner > 0) & (with_letters > 1)), share(length < 4), share(tail), share(with_letters == 0),
    ]
    return np.nan_to_num(np.column_stack(columns).astype(float))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every text."""

    def run(batches):
        for block in X.text_blocks(batches, BLOCK_BYTES):
            values = text_statistics([t or "" for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(values[:, k]) for k in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


Condition = tuple[int, bool, float]  # statistic, above (else at most), cut


def _tree(binned, cuts, gradient, hessian, rows, depth, path, rules, update) -> None:
    """Grow a tree on the rows; collect the path to every node and add the leaves' values to update."""
    if path:
        rules.add(tuple(sorted(path)))
    best = (1e-6, None, None)
    if depth and len(rows) >= 40:
        g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
        for f in range(binned.shape[1]):
            own = binned[rows, f]
            g = np.cumsum(np.bincount(own, gradient[rows], BINS + 1))[:-1]
            h = np.cumsum(np.bincount(own, hessian[rows], BINS + 1))[:-1]
            m = np.cumsum(np.bincount(own, minlength=BINS + 1))[:-1]
            fits = (m >= 15) & (len(rows) - m >= 15)
            gain = np.where(fits, g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    _, f, k = best
    if f is None or k >= len(cuts[f]):
        update[rows] = RATE * -gradient[rows].sum() / (hessian[rows].sum() + 1)
        return
    low = binned[rows, f] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        _tree(binned, cuts, gradient, hessian, side, depth - 1, path | {(f, above, float(cuts[f][k]))}, rules, update)


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def margin(self, of=F.col) -> Column:
        """The weighted sum of the rules; ``of`` gives the column of a statistic."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            tests = [of(STATISTICS[f]) > cut if above else of(STATISTICS[f]) <= cut for f, above, cut in conditions]
            total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def column(self, of=F.col) -> Column:
        """The score as a Spark expression over STATISTICS; ``of`` gives the column of a statistic."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(of)))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, their paths as rules, and lasso logistic weights by accelerated proximal steps."""
    if not len(y):
        return RuleModel(0.0, [])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    if y.min() == y.max():
        return RuleModel(float(np.log(rate / (1 - rate))), [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    margin, rules = np.full(len(y), np.log(rate / (1 - rate))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        update = np.zeros(len(y))
        _tree(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH, frozenset(), rules, update)
        margin += update
    if not rules:  # too few rows to split
        return RuleModel(float(np.log(rate / (1 - rate))), [])
    rules = sorted(rules)
    holds = np.column_stack([np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in r]) for r in rules]).astype(np.float32)
    centre = holds.mean(0)
    scale = np.maximum(holds.std(0), 0.02)
    z = (holds - centre) / scale
    v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(12):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / (np.linalg.norm(z @ v) ** 2 * 1.1 + len(y))
    w, b = np.zeros(z.shape[1]), float(np.log(rate / (1 - rate)))
    w0, b0, t = w, b, 1.0
    for _ in range(600):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        err = 1 / (1 + np.exp(-(z @ wy + by))) - y
        w0, b0, t = w, b, t1
        g = wy - step * (z.T @ err) / len(y)
        w, b = np.sign(g) * np.maximum(np.abs(g) - step * LASSO, 0), by - step * err.mean()
    raw = w / scale
    kept = np.flatnonzero(raw)
    return RuleModel(float(b - raw @ centre), [(float(raw[k]), rules[k]) for k in kept])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_rows labelled documents that are not held out.

    Statistics are computed of these documents only. Of rows that repeat a doc_id the least
    text counts, of labels the best.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = statistics(chosen).join(F.broadcast(known), "doc_id").select("quality", *STATISTICS).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return rows[STATISTICS].to_numpy(float), (rows["quality"].to_numpy() == 1).astype(float)


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Score the quality of every text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Labels are learnt only from rows whose crc32 of doc_id as text is not 1 modulo 3.
    A null text is scored as an empty one; repeated rows get equal scores; a null doc_id
    stays null and counts as not held out; other columns are ignored; an empty table gives
    an empty result; without any label the score is 0.5. Very long texts are taken whole.
    """
    model = fit(*training_rows(docs, labels, max_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = statistics(docs).select("doc_id", held.alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` predicts to be of good quality, all columns unchanged, whatever their names.

    Null and empty texts, repeated rows, null doc_ids and very long texts are scored like
    any other; an empty table gives an empty result; without any label all rows stay.
    """
    model = fit(*training_rows(docs, labels, max_rows))
    columns, kept = docs.columns, "__stats"
    while kept in columns:
        kept += "_"

    def run(batches):
        for block in X.text_blocks(batches, BLOCK_BYTES):
            values = text_statistics([t or "" for t in block.column("text").to_pylist()])
            packed = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATISTICS))], STATISTICS)
            yield pa.RecordBatch.from_arrays([*block.columns, packed], [*block.schema.names, kept])

    numbers = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    schema = T.StructType([*docs.schema.fields, T.StructField(kept, numbers)])
    scored = docs.mapInArrow(run, schema)
    return scored.where(model.column(F.col(kept).getField) >= 0.5).select(*(F.col(f"`{c}`") for c in columns))
