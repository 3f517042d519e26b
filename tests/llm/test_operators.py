import hashlib
import itertools
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repeatloom.llm import byte_bpe, chat, decontaminate, html_text, ngram_join, pii, quality, substring_dedup, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, tokens int"  # the last with a name that operators use inside
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def _corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeéß'", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = text(120), text(50)
    near = []
    for k in range(12):
        words = base.split(" ")
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        near.append(" ".join(words))
    texts = [None, "", " \n\t", "one", "a b c", "A B C", *near, *[f"{text(40)}\n{passage} {text(30)}" for _ in range(8)], base, base, text(6000), "x " * 90, "İΣ ​ \x1c² 's 're's <|endoftext|> 中文🎉"]
    return [(i, t, "s", 1) for i, t in enumerate(texts)] + [(7, near[1], "s", 1), (None, base, None, None)]


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_byte_bpe(docs, empty, corpus):
    ranks = byte_bpe.load_ranks(BYTES)
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, encoding.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in corpus]
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.encode_decode(docs, BYTES).collect()]
    assert _sorted(got) == _sorted(want)
    assert byte_bpe.encode_decode(empty, BYTES).count() == 0


def test_token_counts(docs, empty, corpus):
    tokenizer = Tokenizer.from_file(WORDS)
    want = [(d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in corpus]
    assert _sorted([tuple(r)[:3] for r in token_count.count_tokens(docs, WORDS).collect()]) == _sorted(want)
    assert token_count.count_tokens(empty, WORDS).count() == 0


def test_near_duplicates(docs, empty, corpus):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in corpus:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    label = {g: min((corpus[i][0] for i in range(len(sets)) if group[i] == g and corpus[i][0] is not None), default=None) for g in group}
    want = [(corpus[i][0], len(s), label[group[i]] if s else corpus[i][0]) for i, s in enumerate(sets)]
    assert _sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == _sorted(want)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_remove_repeats(docs, empty, corpus):
    words = [WORD.findall(t or "") for _, t, *_ in corpus]
    seen: dict = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    want = []
    for (d, *_), w in zip(corpus, words):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert _sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == _sorted(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    words = ["".join(rng.choices("klmnop", k=6)) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=25)) + ". " + " ".join(rng.choices(words, k=8)) + ".") for i in range(20)] + [(98, None), (99, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{filler(200)} {items[i][1].upper()} {filler(100)}" if i < 10 else filler(300), "s", 1) for i in range(30)]
    leaky = docs.unionByName(spark.createDataFrame([(1000 + d, *r) for d, *r in rows], DOCS))
    found = decontaminate.find_leaks(leaky, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1000 + i, i) for i in range(10)}
    assert decontaminate.without_leaks(leaky, benchmark).count() == leaky.count() - 10
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_quality(spark, empty):
    rng = random.Random(2)
    good = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)) + ".", "s", 1) for i in range(300)]
    bad = [(300 + i, " ".join("".join(rng.choices("ABCDEFGH", k=5)) + "!!" for _ in range(60)), "s", 1) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad, (None, None, None, None), (1000, "", None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).where("doc_id < 400").collect()
    assert all(r.predicted == int(r.doc_id < 300) for r in rows)
    assert quality.score_quality(docs, labels).count() == 402
    assert quality.keep_good(docs, labels).where("doc_id between 0 and 399").count() == 300
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_chat(spark):
    said = "</s>[INST] ok &lt; [/INST]\n<|turn|>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", None), (None, 0, "assistant", "x"), (2, 5, None, "")]
    m = chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_branches(m).select("tree", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    got = {r.tree: ([tuple(x) for x in r.t], r.l) for r in out}
    assert got["1"] == ([("user", said), ("assistant", ""), ("assistant", said)], said)
    assert got[""] == ([("assistant", "x")], "x") and got["2"] == ([("", "")], "")
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 5.0), ("t", 5, 9, "user", "lost", 0.0)]
    messages = spark.createDataFrame(tree, "tree string, id long, parent long, role string, text string, score double")
    assert [r.path for r in chat.branches(messages).orderBy(F.desc("score")).collect()] == [[1, 3, 4], [1, 2], [5]]
    assert chat.format_branches(messages.limit(0)).count() == 0


def test_pseudonyms(spark, empty):
    texts = ["+1 (456) 555-2186 42.144.35.254 4041894974608795 a.b@c.example.com", "4041 8949 7460 8795 and 42.144.35.254", "version 3.0, 999.1.1.1, 2001-02-30, 4041894974608796", "1987-03-15 15/03/1987", None, ""]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k1").orderBy("doc_id").collect()]
    assert out[2] == texts[2] and out[4] is None and out[5] == ""
    assert not any(x in out[0] for x in texts[0].replace("(456) ", "").split()[2:])
    assert out[0].split()[4] == out[1].replace(" ", "")[:16] and out[0].split()[3] == out[1].split()[-1]
    assert out[3][4] == "-" and out[3] != texts[3]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("1.2."), F.floor(F.col("id") / 250).cast("string"), F.lit("."), (F.col("id") % 250).cast("string")).alias("text"))
    assert pii.pseudonymise(many, "k1").select("text").distinct().count() == 3000
    assert pii.pseudonymise(empty, "k1").count() == 0


def test_html(spark):
    article = "<article><h1>Head &amp; line</h1><p>First, a long sentence with words.<p><b>Second one.<br>More.</p></article>"
    page = f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy this now, today.</div>{article}<section class=comments><p>Reader says, long comment here.</p></section><footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "plain text")]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Head & line First, a long sentence with words. Second one. More."
    assert [out[i].text for i in (2, 3, 4)] == ["", "", "plain text"] and out[1].n_chars == len(out[1].text)


def test_deep_and_cyclic_trees(spark):
    rows = [("deep", i, i - 1 if i else None, "user", str(i), float(i)) for i in range(41)]
    rows += [("deep", 100, 20, "assistant", "side", 0.0), ("loop", 1, 2, "user", "x", 0.0), ("loop", 2, 1, "user", "y", 0.0), ("loop", 3, 1, "user", "z", 0.0), ("own", 1, 1, "user", "w", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): (r.path, r.score) for r in chat.branches(messages).collect()}
    assert got == {("deep", 40): (list(range(41)), 20.0), ("deep", 100): ([*range(21), 100], 210 / 22)}
    out = chat.format_branches(messages).collect()
    assert [(r.tree, r.leaf, r.n_turns) for r in out] == [("deep", 40, 41)]
