"""Repeated rows, very long texts and clashing names for operators whose own tests lack them; a second extractor over pages."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from quern.llm import html_extraction as H
from quern.llm import quality_rules as Q
from quern.llm import token_store as K
from quern.llm import warc as W

CLASH = ["host", "mark", "subs", "template", "digest", "first_id", "size", "seq", "start", "n_tokens", "root", "chunks", "part", "rel", "k", "grp", "z0", "mu", "prec", "n_words"]


def clashing(df):
    return df.withColumns({c: F.lit("c") for c in CLASH})


def test_archives_of_repeats_and_long_pages(spark, tmp_path):
    long = "<p>é " + "word " * 400_000 + "</p>"
    rows = [(1, "u", long), (1, "u", long), (2, "v", "<b>short</b>"), (2, "v", "<b>short</b>"), (3, None, long)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(2)
    got = W.read_archives(W.write_archives(df, str(tmp_path / "w")), 4096).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == sorted([(1, "revisit", len(long.encode()))] * 2 + [(2, "response", 12)] * 2 + [(3, "response", len(long.encode()))])
    assert all(r.refers_to == 3 for r in got if r.page_id == 1)


def test_statistics_of_long_texts(spark):
    long = "ab cd ef gh ij kl # " * 100_000
    df = clashing(spark.createDataFrame([(1, long, "en", "s"), (1, long, "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string").drop("n_words"))
    got = Q.verdicts(df.drop(*Q.STATS), ["doc_id", "lang", "source"]).collect()
    assert len(got) == 3 and {(r.n_words, r.n_symbols, r.n_repeat_words) for r in got if r.doc_id == 1} == {(700_000, 100_000, 700_000)}


def test_store_passes_over_clashing_columns(spark, tmp_path):
    df = clashing(spark.createDataFrame([(2, "b c"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string"))
    K.write_store(df, str(tmp_path / "s"), K.default_tokenizer())
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in K.read_summary(spark, str(tmp_path / "s")).collect())
    assert [x[1] for x in got] == [None, 1, 1, 2] and got[-1][2] == 3


class Tree(HTMLParser):
    """Pages as nested lists [tag, class, kids] by the standard library's tokens, void elements and open paragraphs closed."""

    VOID = {"br", "meta", "link", "img", "hr", "input"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", "", []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass
        x = [tag, dict(attrs).get("class") or "", []]
        self.open[-1][2].append(x)
        if tag not in self.VOID:
            self.open.append(x)

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def slow_text(html):
    """The blocks of the article: headings, paragraphs and list items outside menus, adverts and the like."""
    out, line = [], []

    def end():
        t = re.sub(r"\s+", " ", "".join(line)).strip()
        line.clear()
        if t:
            out.append(t)

    def walk(x, inside):
        if isinstance(x, str):
            if inside:
                line.append(x)
            return
        tag, name, kids = x
        if tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "button") or re.search(r"\b(ad|ads|advert|promo|menu|sidebar|notice|comments?|cookie|banner)\b", name):
            return
        inside = inside or tag == "article"
        if tag in ("p", "div", "h1", "h2", "h3", "li", "ul", "article", "section", "blockquote"):
            end()
            for k in kids:
                walk(k, inside)
            end()
        else:
            if tag == "br" and inside:
                line.append(" ")
            for k in kids:
                walk(k, inside)

    walk(Tree(html).root, False)
    end()
    return "\n".join(out)


def test_extraction_of_made_up_pages_equals_a_second_extractor(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))
    pages = []
    for i in range(300):
        body = [f"<h1>{say(4)}</h1>"]
        for _ in range(rng.randint(1, 6)):
            body.append(rng.choice([f"<p>{say(9)} &amp; {say(3)}</p>", f"<p>{say(5)}<br>{say(5)}", f"<p><b>{say(3)}</b> {say(6)}</p>", f"<div class=ad>{say(5)}</div>", f"<blockquote><p>{say(7)}</p></blockquote>", f"<p>{say(4)}<script>x('</p>')</script> {say(2)}</p>"]))
        menu = "".join(f"<li><a href=/{k}>menu {k}</a></li>" for k in range(4))
        pages.append((i, f"https://h{i % 3}.org/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><article>{''.join(body)}</article><footer>about {i % 2}</footer></body></html>"))
    df = clashing(spark.createDataFrame(pages + pages[:5] + [(900, None, None)], "page_id long, url string, html string")).repartition(4)
    got = H.extract(df).collect()
    assert len(got) == 306
    want = {i: slow_text(h) for i, _, h in pages} | {900: ""}
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_extraction_of_the_given_pages_equals_a_second_extractor(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {i: slow_text(h or "") for i, h in pages.items()}
