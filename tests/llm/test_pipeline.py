"""The whole pipeline against a brute-force version, and its near-duplicate stage by itself."""

import hashlib
import itertools
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from repeatloom.llm import byte_bpe, pii
import test_pii_brute_force as plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def one_of_each_group(rows):
    """Per group the row of the smallest doc_id, by brute force; rows without words stay."""
    group, sets = list(range(len(rows))), [shingles(r[1]) for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        best[g] = min(best.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    return list(best.values())


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Good prose, shouted junk, near copies, leaks of test items and personal data."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    junk = lambda: " ".join("".join(rng.choices("ABCDEFGH", k=5)) + "!!" for _ in range(60))
    items = [(i, f"{prose(20)} {prose(9)}") for i in range(6)] + [(98, None), (99, "")]
    numbers = ["4041 8949 7460 8795", "42.144.35.254", "1987-03-15", "token=abcdef123456", "123-45-6789"]
    values = lambda: rng.choice([[], rng.sample(numbers, 2)])
    rows, labels = [], []
    for i in range(260):
        bad = i % 4 == 0
        text = junk() if bad else " ".join([prose(40), *values(), prose(30)])
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    good = [r for r in rows if r[0] % 4]
    for k, r in enumerate(good[:60]):
        changed = r[1].split(" ")
        for _ in range(k % 6):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        text = " ".join(changed)
        rows.append((300 + k if k % 7 else None, text, "en", "s", len(text)))
    rows += good[5:9]
    for k in range(12):
        text = f"{prose(50)} {items[k % 6][1].upper() if k % 2 else items[k % 6][1]} {prose(40)}"
        rows.append((400 + k, text, "en", "s", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, prose(9000), "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("world"))
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def replaced(text):
    """Personal data of the world's kinds, by the plain readers of the PII tests."""
    for pattern, new in ((r"4041 8949 7460 8795", plain.card), (r"42\.144\.35\.254", plain.address), (r"1987-03-15", plain.date), (r"123-45-6789", plain.social)):
        text = re.sub(pattern, lambda m, new=new: new(m[0]), text)
    return re.sub(r"(token=)(\w+)", lambda m: m[1] + plain.secret(m[2]), text)


def test_pipeline_equals_brute_force(spark, world):
    folder, rows, items = world
    spark.conf.set(pii.KEY_SETTING, plain.KEY)
    try:
        got = sorted(corpus_pipeline.run(spark, folder).collect(), key=str)
        again = sorted(corpus_pipeline.run(spark, folder).collect(), key=str)
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    empty = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()} & {500, 501}
    kept = [r for r in rows if (r[0] in empty if not r[1] else "!!" not in r[1])]  # junk alone shouts; what empty texts score is the model's choice
    kept = one_of_each_group(kept)
    kept = [r for r in kept if not any(t and t.lower() in (r[1] or "").lower() for _, t in items)]
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for doc_id, text, *_ in kept:
        text = replaced(text or "")
        ids = encoding.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert [tuple(r) for r in got] == [tuple(r) for r in again]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_stages_keep_columns_and_take_odd_tables(spark, world):
    folder, rows, _ = world
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows[:40]], SCHEMA + ", n_values int, __row string, __stats double")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {(r["n_values"], r["__row"], r["__stats"]) for r in out.collect()} == {(1, "x", 2.0)}, name
    nothing = spark.createDataFrame([], SCHEMA)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, folder).count() == 0, name


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices("abcdefghijklmnop", k=60))
    near = lambda t: t + " z"
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (1, near(a)), (2, a), (None, a), (None, b), (None, b), (None, near(b)), (5, c), (4, near(c)), (7, d), (7, e), (8, None), (8, None), (None, ""), (9, text())]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (spark.read.parquet(str(tmp_path / "docs")), frame):
        out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r[0] or -1 for r in one_of_each_group(rows))
