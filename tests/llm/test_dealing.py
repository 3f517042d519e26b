"""Dealing by way of nodes gives the results of dealing directly."""

import random

import public_tokenizers
import pytest

from repeatloom.llm import _staging, byte_bpe, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(2000)]
    passages = [" ".join(rng.choices(words, k=rng.randint(36, 80))) for _ in range(12)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, k=rng.randint(0, 90)))
        rows.append((i, f"{text} {rng.choice(passages)}" if i % 3 == 0 else text))
    rows += [(500 + i, " ".join(t.split(" ")[: -(i % 3) or None]) if t else None) for i, (_, t) in enumerate(rows[:120])]
    return spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1])], SCHEMA).repartition(5)


@pytest.mark.parametrize("fan", [3, 8])
def test_nodes_in_between(docs, monkeypatch, fan):
    def results():
        joined = ngram_join.near_duplicates(docs).collect()
        encoded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
        return [sorted(map(str, x)) for x in (joined, substring_dedup.remove_repeats(docs).collect(), encoded)]

    direct = results()
    assert sum("n_removed=0" not in r for r in direct[1]) > 100
    for module, block, bucket in ((ngram_join, 9000, 3000), (byte_bpe, 9000, 3000), (substring_dedup, 9000, 3000)):
        monkeypatch.setattr(module, "BLOCK_BYTES", block)
        monkeypatch.setattr(module, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(_staging, "FAN", fan)
    total = _staging.text_bytes(docs)
    assert _staging.levels(_staging.parts(total, 3000))[1] > 1
    assert results() == direct


def test_rows_dealt_do_not_grow_with_the_square():
    for n in (1, 100, 4096, 4097, 10**6, 10**8):
        coarse, fine = _staging.levels(n)
        assert coarse <= _staging.FAN and n <= coarse * fine < n + fine and (fine == 1) == (n <= _staging.FAN)
