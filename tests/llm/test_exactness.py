"""Every code point and crafted words against the tokenizer libraries; hashes without algebraic weakness."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from repeatloom.llm import _text as X
from repeatloom.llm import byte_bpe, ngram_join, substring_dedup, token_count

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n):
    """Two different words of n letters whose polynomial hashes modulo a power of two agree."""
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def rows(spark):
    """Each code point between letters, digits and signs, thirty-two to a text; and the crafted words."""
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}1 {c}b{c}{c}.{c}" for c in points[i : i + 32]) for i in range(0, len(points), 32)]
    one, two = thue_morse(2048)
    texts += [one, two, f"{one} {two}", one + two]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_byte_bpe_takes_every_code_point(rows):
    texts, docs = rows
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTES), special_tokens={})
    got = {r.doc_id: (r.ids, bytes(r.decoded).decode()) for r in byte_bpe.encode_decode(docs, BYTES).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != (encoding.encode_ordinary(t), t)] == []


def test_token_counts_of_every_code_point(rows):
    texts, docs = rows
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, WORDS, 300).collect()}
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i for i, n in enumerate(want) if got[i] != (n, n > 300)] == []


def test_crafted_words_are_told_apart(spark):
    one, two = thue_morse(1024)
    cps, offsets = X.code_points([one, two])
    for array, width in ((cps, 1), (np.frombuffer((one + two).encode(), np.uint8), 1)):
        for seed in (1, 2):
            assert len(set(X.slice_hashes(array, offsets[:-1] * width, offsets[1:] * width, seed).tolist())) == 2
    docs = spark.createDataFrame([(1, f"{one} a b c d e"), (2, f"{two} a b c d e"), (3, f"{one} a b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    words = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{one} {words}"), (2, f"{two} {words}"), (3, f"{one} {words}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 35, 2: 0, 3: 35}


def test_hashes_by_place_and_chunk():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 200_000, np.uint8)
    starts = np.sort(rng.choice(199_000, 5000, replace=False))
    ends = starts + rng.integers(0, 700, 5000)
    whole = X.slice_hashes(data, starts, ends)
    by_text = {}
    for h, a, b in zip(whole.tolist(), starts.tolist(), ends.tolist()):
        assert by_text.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_text.values())) == len(by_text)
    for n in (1, 2, 3, 5, 35):
        grams = X.ngram_hashes(whole, n)
        assert len(grams) == 5000 - n + 1
        assert all(X.ngram_hashes(whole[i : i + n], n)[0] == grams[i] for i in (0, 17, 5000 - n))
    big = np.tile(whole, 40)
    assert (X.ngram_hashes(big, 35)[:4000] == X.ngram_hashes(big, 35)[5000:9000]).all()
