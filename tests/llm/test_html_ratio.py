import random
import time
from html.parser import HTMLParser

from repeatloom.llm import html_text
from repeatloom.llm.html_text import main_text

LONG = ["The river rose again on Monday, and the lower fields were under water by noon.", "Nobody was hurt, said the mayor, but two bridges stay closed; a third is watched.", "Rain is expected until Friday, with more than forty millimetres in the hills."]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
TEXT = " ".join(LONG)
NAV = "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>"


def test_page_without_article_or_main():
    page = f"<body>{NAV}<div><h2>High water</h2>{BODY}</div><div>Back to top</div><footer>&copy; x</footer></body>"
    assert main_text(page) == f"High water {TEXT}"


def test_teaser_article_beside_plain_main_text():
    for teaser in ("<article><h3>Also</h3><p>Short teaser.</p></article>", "<div class=content><p>More soon.</p></div>"):
        for tag in ("div", "section"):
            assert main_text(f"<body>{NAV}<{tag}><h1>High water</h1>{BODY}</{tag}>{teaser}</body>").startswith(f"High water {TEXT}")


def test_ratio_decides_inside_an_article():
    assert main_text(f"<body>{NAV}<article><div>12 min</div><div class=x>{BODY}</div></article></body>") == TEXT


def test_article_in_wrappers_named_like_side_matter():
    for name in ("content-sidebar-wrap", "has-sidebar", "main-content with-sidebar"):
        side = "<div class=sidebar><p>Follow us for more.</p></div>"
        for inner in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div>{BODY}</div>"):
            assert main_text(f"<body>{NAV}<div class='{name}'>{inner}{side}</div><div>All rights.</div></body>") == TEXT, (name, inner)
    for tag in ("form", "fieldset", "dialog"):
        assert main_text(f"<body><{tag}>{NAV}<div>{BODY}</div></{tag}></body>") == TEXT


def test_side_matter_stays_out():
    comments = "<div class=comments>" + "<article class=comment-body><p>I saw it too, from the old bridge, and it was loud.</p></article>" * 6 + "</div>"
    assert main_text(f"<body>{NAV}<article>{BODY}</article>{comments}<aside><p>{LONG[0]}</p></aside></body>") == TEXT
    assert main_text("<body><aside><p>Only this side note, with some words, stands on the page.</p></aside></body>") != ""


class Tree(HTMLParser):
    """Text of every block by its path, read with the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.sums, self.words, self.in_link, self.links = [], {}, [], 0, 0

    def end_block(self):
        text = " ".join("".join(self.words).split())
        if text:
            own = self.sums.setdefault("/".join(self.stack), [0, 0, 0, 0])
            for k, v in enumerate((1, len(text), sum(text.count(c) for c in ".,;:!?"), min(self.links, len(text)))):
                own[k] += v
        self.words, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.in_link = 1
        elif tag not in ("b", "i", "span"):
            self.end_block()
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role"))
            self.stack.append(f"{tag}.{names.split(' ')[0]}" if names and tag not in ("p", "li", "h2") else tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = 0
        elif tag not in ("b", "i", "span"):
            self.end_block()
            self.stack.pop()

    def handle_data(self, data):
        self.words.append(data)
        self.links += len(data) if self.in_link else 0


def labels(page, path):
    names = {child: label for (_, label), child in page.known.items()}
    out = []
    while path > 0:
        out.append(names[path])
        path = page.above[path]
    return "/".join(reversed(out))


def random_tree(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 5)):
        if depth < 4 and rng.random() < 0.5:
            tag = rng.choice(["div", "section", "ul", "div class=c1", "div class='c2 c3'", "article"])
            out += f"<{tag}>{random_tree(rng, depth + 1)}</{tag.split()[0]}>"
        else:
            words = " ".join(rng.choices(["one,", "two &amp; three.", "<b>four</b>", "<a href=x>five six</a>", "&eacute;t&eacute;!"], k=rng.randrange(1, 6)))
            out += rng.choice(["<p>{}</p>", "<li>{}</li>", "<h2>{}</h2>"]).format(words)
    return out


def test_path_sums_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = f"<html><body>{random_tree(rng)}</body></html>"
        plain = Tree()
        plain.feed(text)
        page = html_text.read_page(text)
        assert {labels(page, p): s for p, s in html_text.path_sums(page).items()} == plain.sums, text


def test_pages_without_telling_names():
    menu = "<ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("Home", "News", "Sport", "About us")) + "</ul>"
    for a, b, c in (("c1", "c2", "c3"), ("", "", ""), ("x", "x", "x")):
        name = lambda k: f" class={k}" if k else ""
        page = f"<body><div{name(a)}>{menu}</div><div{name(b)}><h1>High water</h1>{BODY * 3}</div><div{name(c)}>&copy; 2024 Example Press. All rights reserved.</div></body>"
        assert main_text(page) == f"High water {' '.join([TEXT] * 3)}", (a, b, c)


def test_comments_in_a_nameless_part_of_the_article():
    comments = "<div><p>Nice.</p><p>I saw that too</p><p>Thanks, Ann</p></div>"
    assert main_text(f"<body>{NAV}<article><h1>High water</h1>{BODY * 2}{comments}</article></body>") == f"High water {TEXT} {TEXT}"


def test_names_of_side_matter_around_and_within_the_article():
    assert main_text(f"<body><div class='share story'>{BODY}</div><div class=share>Share this</div></body>") == TEXT
    assert main_text(f"<body><form action=x><div>{NAV}</div><div>{BODY}</div><input name=q></form></body>") == TEXT
    lead = "<section class=header><h1>High water</h1><p>The rivers rose again, for the third time this year.</p></section>"
    assert main_text(f"<body>{NAV}<article>{lead}{BODY}</article></body>") == f"High water The rivers rose again, for the third time this year. {TEXT}"


def test_references_are_decoded_piece_by_piece():
    assert main_text("<p>Salt &amp; pepper, &am<b>p;</b> &#x41;&nbsp;&lt;b&gt;</p>") == "Salt & pepper, &amp; A <b>"


def test_long_and_deep_pages():
    deep = "<div>" * 60_000 + BODY + "</div>" * 60_000
    assert main_text(f"<body>{deep}</body>") == TEXT
    mixed = "".join(f"<div class=c{k}><p>{LONG[k % 3]}</p>" for k in range(20_000))
    began = time.perf_counter()
    assert LONG[0] in main_text(f"<body>{mixed}</body>")
    assert main_text("<aside>" * 30_000 + "<p>x</p>" * 30_000) is not None
    assert main_text("<p>" + "word, " * 400_000).count("word") == 400_000
    assert time.perf_counter() - began < 20


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, __page int"
    rows = [(1, "u", "<p>One.", "old", "old", 1), (1, "u", "<p>One.", "old", "old", 1), (None, None, None, None, None, None), (2, "u", "", "old", "x", 2), (3, "u", "<div>", None, None, 3)]
    out = html_text.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "__page", "text", "n_chars"]
    got = sorted(([r.page_id, r["__page"], r.text, r.n_chars] for r in out.collect()), key=str)
    assert got == sorted([[1, 1, "One.", 4], [1, 1, "One.", 4], [None, None, "", 0], [2, 2, "", 0], [3, 3, "", 0]], key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
