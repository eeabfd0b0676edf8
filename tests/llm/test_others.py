"""Decontamination, extraction, surrogates, the registry and the pipeline on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination as D
from quern.llm import html_extraction as H
from quern.llm import pii_surrogates as P


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_by_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 15))] for _ in range(2))
        score, begin, end = D.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b)
        assert score == 0 or score == smith_waterman(a, b[begin:end])


def test_contaminated(spark):
    rng = random.Random(2)
    sent = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    items = [(i, sent(35)) for i in range(6)] + [(7, None), (8, ""), (9, "tiny item")]
    edit = items[1][1].split(" ")
    for k in (3, 12, 20, 28):
        edit[k] = "changed"
    del edit[16]
    docs = [(1, f"{sent(50)} {items[0][1].upper()}. {sent(50)}"), (2, f"{sent(10)} {' '.join(edit)}"), (3, sent(200)), (4, None), (5, ""), (6, items[2][1][:40])]
    docs += [(100 + i, f"{sent(5)} {items[3][1]}") for i in range(40)] + [(1, "again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 0), (2, 1), *((100 + i, 3) for i in range(40))}
    for block in (1 << 20, 300):  # several blocks of items give the same
        assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench, block_bytes=block).collect()} == want
    assert D.contaminated(df.limit(0), bench).count() == 0
    assert D.contaminated(df, bench.limit(0)).count() == 0


def test_contaminated_by_any_surviving_ngram(spark):
    rng = random.Random(8)
    sent = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [(0, sent(50)), (1, sent(50)), (2, "tiny item"), (3, sent(40)), (4, sent(50))]
    edit = items[0][1].split(" ")
    edit[5::6] = ["changed"] * len(edit[5::6])
    half = " ".join(items[1][1].split(" ")[:25])
    apart = items[3][1].split(" ")
    docs = [(1, f"{sent(30)} {' '.join(edit)} {sent(30)}"), (2, items[1][1]), (3, f"{sent(30)} {half} {sent(30)}"), (4, f"{sent(9)} Tiny item, {sent(9)}"), (5, f"{sent(9)} tiny")]
    docs += [(6, " ".join([*apart[:20], sent(30), *apart[20:]]))]  # a whole copy with a long insertion
    three = " ".join(items[4][1].split(" ")[20:23])
    docs += [(100 + i, f"{sent(20)} {three} {sent(20)}") for i in range(50)] + [(7, " ".join([sent(20), *items[4][1].split(" ")[8:36], sent(20)]))]  # a common n-gram
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0): 76, (2, 1): 100, (3, 1): 50, (4, 2): 4, (6, 3): 50, (7, 4): 56}


def test_contaminated_against_all_pairs(spark):
    """Links and scores against Smith-Waterman of every item with every whole document; repeated and null ids."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(60)]
    sent = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(rng.choice((1, 1, 2, 3, None)), sent(rng.randint(1, 40))) for _ in range(14)]

    def copy(ws):
        ws = ws[: rng.randint(len(ws) // 2, len(ws))] if rng.random() < 0.3 else list(ws)
        for _ in range(rng.choice((0, 0, 2, 6, 12))):
            k = rng.randrange(len(ws)) if ws else 0
            ws[k : k + rng.randint(0, 2)] = sent(rng.randint(0, 2))
        return ws

    docs = [(rng.choice((i, i, 5, None)), sent(rng.randint(0, 60)) + (copy(rng.choice(items)[1]) if rng.random() < 0.7 else []) + sent(rng.randint(0, 30))) for i in range(90)]
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    want = []
    for i, ws in docs:
        for j, it in items:
            grams = [it] if len(it) < 3 else [it[k : k + 3] for k in range(len(it) - 2)]
            if any(ws[k : k + len(g)] == g for g in grams for k in range(len(ws))):
                score = smith_waterman(it, ws)
                if score >= D.MIN_SCORE * D.MATCH * len(it):
                    want.append((i, j, score, len(it)))
    got = sorted(((r.doc_id, r.item_id, r.score) for r in D.contaminated(df, bench, block_bytes=900).collect()), key=repr)
    sure = sorted(((i, j, s) for i, j, s, n in want if s >= D.MATCH * 8 or n <= 8), key=repr)  # at least eight words
    assert set(got) <= {w[:3] for w in want} and len(got) >= 30
    assert len([w for w in sure if w in got]) >= 0.97 * len(sure)
    long = spark.createDataFrame([(1, " ".join(["of the"] * 40000 + items[-1][1]))], "doc_id long, text string")
    assert D.contaminated(long, spark.createDataFrame([(9, " ".join(items[-1][1])), (10, "of the of the of")], "item_id long, text string")).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &lt;1&gt;</h1></header><p>One <b>two
 three<p>four&nbsp;five<!-- x --><div class=share><a>Tweet</a></div><ul><li>i<li>j</ul><script>var a="</p>";</script>
<aside>side</aside><section id="comments"><p>first!</p></section></article><form>f</form><footer>foot</footer></body></html>"""


def test_main_text():
    assert H.main_text(H.parse(PAGE), set()) == "Head <1>\nOne two three\nfour five\ni\nj"
    assert H.main_text(H.parse(""), set()) == ""
    assert H.main_text(H.parse("plain &amp; simple"), set()) == "plain & simple"
    assert H.main_text(H.parse("<main><p>a</main><p>b"), set()) == "a"
    assert H.main_text(H.parse("<div>" * 5000 + "deep"), set()) == "deep"
    assert H.main_text(H.parse("<p>a < b > c <3"), set()).startswith("a")


def test_templates_go_but_articles_stay(spark):
    page = lambda host, i, body: (i, f"https://{host}/p{i}", f"<body><div><p>Buy our {host} things</p></div><article><p>{body}</p></article><div>tail</div></body>")
    bare = lambda i: (i, "https://c.org/x", f"<body><div><p>Same box</p></div><div><p>Own text {i}</p></div></body>")
    rows = [page("a.org", i, "the same article") for i in range(30)] + [bare(i) for i in range(100, 120)] + [(200, None, None), (201, "nohost", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, template string").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(df).collect()}
    assert all(got[i][0] == "the same article" for i in range(30))
    assert all(got[i][0] == f"Own text {i}" for i in range(100, 120))
    assert got[200] == ("", 0) and got[201] == ("x", 1)
    assert H.extract(df.limit(0)).count() == 0


def test_counts_find_what_names_do_not_tell(spark):
    """Unnamed boxes in articles go, copied articles stay, a large host's section menus go, and pages without any telling tag
    or class give the text that they give with them."""
    rng = random.Random(17)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    box, rows, want = "<div><p>Get our letter every week</p></div>", [], {}
    for i in range(40):  # the box stands in different articles
        ps = [say(20), say(30)]
        rows.append((i, "https://a.org/x", f"<article><p>{ps[0]}</p>{box}<p>{ps[1]}</p></article>"))
        want[i] = "\n".join(ps)
    copied = f"<article><p>{say(20)}</p><div><p>own box</p></div><p>{say(30)}</p></article>"
    for i in range(100, 140):  # copies of one article, on pages that differ
        rows.append((i, "https://b.org/x", f"<body><p>{say(3)}</p>{copied}</body>"))
    plain = {}
    for i in range(200, 500):  # a host of 30 sections with a menu each, one footer
        ps = [say(20), say(30)]
        menu = "".join(f"<li><a href=/{k}>{k} of {i % 30}</a></li>" for k in range(5))
        rows.append((i, "https://c.org/x", f"<body><nav><ul>{menu}</ul></nav><article><h1>{ps[0]}</h1><p>{ps[1]}</p></article><footer>made by {i % 2}</footer></body>"))
        plain[i] = rows[-1][2]
        want[i] = "\n".join(ps)
    df = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(got[i] == t for i, t in want.items())
    assert all("own box" in got[i] and got[i].count("\n") == 2 for i in range(100, 140))
    bare = [(i, "https://c.org/x", re.sub("nav|article|footer", "div", t)) for i, t in plain.items()]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert all(got[i] == want[i] for i in plain)


def test_stray_tags_and_long_pages_end():
    assert H.main_text(H.parse("<div><i>" * 20000 + "x" + "</b></span>" * 20000), set()) == "x"
    assert H.main_text(H.parse("<p>a<br>b  c<br><p>d"), set()) == "a b c\nd"
    assert len(H.main_text(H.parse("<p>" + "word &amp; " * 200000), set())) == 200000 * 7 - 1


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def test_surrogates(spark):
    rows = [
        (1, "Mail Bob.X@mail.example.com, card 4111 1111 1111 1111, again BOB.X@MAIL.EXAMPLE.COM"),
        (2, "mail bob.x@mail.example.com and 4111111111111111 or +1 (607) 555-1595; 10.1.2.3"),
        (3, "Mrs. Anna Smith met Mr. John Smith. Госпожа Иванова."),
        (4, 'password=abcdef123456 token = "0123456789abcdef0123"'),
        (5, None), (6, ""), (7, "no entity 123 at 4 o'clock   12:30"), (8, "GB82 WEST 1234 5698 7654 32 "), (1, "second row a1@b2.org"),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kind string").repartition(3)
    out = [(r.doc_id, r.text, r.n_entities) for r in P.replaced(df, "k1").collect()]
    by = {i: t for i, t, _ in out if not (i == 1 and t.startswith("second"))}
    assert len(out) == len(rows) and by[5] is None and by[6] == "" and by[7] == rows[6][1]
    for secret in ("bob", "4111", "607) 555-1595", "10.1.2.3", "Smith", "Anna", "John", "Иванова", "abcdef123456", "0123456789abcdef", "WEST", "a1@b2"):
        assert not any(t and secret.lower() in t.lower() for _, t, _ in out)
    mail = re.search(r"Mail (\S+@\S+?),", by[1])[1]
    assert re.search(r"mail (\S+@\S+) and", by[2])[1] == mail.lower() and re.search(r"again (\S+)$", by[1])[1] == mail.upper()
    card = re.search(r"card ((?:\d{4} ){3}\d{4})", by[1])[1]
    assert luhn(card) and card.replace(" ", "") in by[2] and card[0] == "4"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[2])
    woman, last, man, last2, other = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)\. Госпожа (\w+)\.$", by[3]).groups()
    assert last == last2 and woman.endswith("a") and man.endswith("n") and re.fullmatch("[А-Яа-я]+", other)
    iban = re.match(r"([A-Z]{2}\d\d(?: ?\w{4})+ \d\d) ", by[8])[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and by[8].endswith("")
    assert {t for _, t, _ in out} == {r.text for r in P.replaced(df.repartition(1), "k1").collect()}
    assert by[1] not in {r.text for r in P.replaced(df, "k2").collect()}
    assert P.replaced(df.limit(0), "k1").count() == 0
    with pytest.raises(ValueError, match="key"):
        P.replaced(df, "")


def test_names_stay_one_person(spark):
    rows = [
        (1, "Dr. Anna Smith and Mrs. Anna Smith; then Anna Smith left. SMITH came, a smith did not.", 7, 8),
        (2, "Ask Dr. Anna Smith or Herr Anton Berg, not Blacksmith.", 7, 8),
        (3, "Call +1 607 555 1595 or (607) 555-1595 or 607-555-1595.", 7, 8),
        (3, "Call +1 607 555 1595 or (607) 555-1595 or 607-555-1595.", 7, 8),
        (4, "Nothing of Anna here " * 9000, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int, n_entities int").withColumn("s", F.lit(1)).repartition(3)
    out = P.replaced(df, "k")
    assert out.columns == ["doc_id", "text", "mark", "s", "n_entities"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 5 and got[1].mark == 7 and got[4].text == rows[4][1] and got[4].n_entities == 0
    first, last, *again, upper = re.match(r"Dr\. (\w+) (\w+) and Mrs\. (\w+) (\w+); then (\w+) (\w+) left\. (\w+) came, a smith did not\.$", got[1].text).groups()
    assert again == [first, last] * 2 and upper == last.upper() and first.endswith("ia") and {first, last} & {"Anna", "Smith"} == set()
    assert got[1].n_entities == 2 + 3
    other, other_last, man, man_last = re.match(r"Ask Dr\. (\w+) (\w+) or Herr (\w+) (\w+), not Blacksmith\.$", got[2].text).groups()
    assert (other, other_last) == (first, last) and man.endswith("an") and man != "Anton" and man_last != "Berg"
    a, b, c = re.match(r"Call \+1 (\d{3} \d{3} \d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.$", got[3].text).groups()
    assert len({re.sub(r"\D", "", x) for x in (a, b, c)}) == 1 and "6075551595" not in re.sub(r"\D", "", a)


def test_surrogates_stay_distinct(spark):
    mails = [f"u{i}@h.example.org" for i in range(300)]  # few letters: draws collide
    df = spark.createDataFrame([(i, f"x {m} y") for i, m in enumerate(mails)], "doc_id long, text string")
    out = [r.text for r in P.replaced(df, "k").collect()]
    assert len(set(out)) == 300 and not any(m in t for m in mails for t in out)


def _pii(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in P.replaced(df, key).collect()}


def test_one_surrogate_a_word_of_a_name(spark):
    out = _pii(spark, ["Dr. Anna Smith met us. Ms. Anna called. Then Anna left. ANNA SMITH wrote.", "Ms. Anna is here; Mr. Smith too, and Mrs. Anna Jones.", "Herr Jones saw Mr. Kim Lee and Mrs. Kim Park."])
    first, last, alone, later, loud = re.match(r"Dr\. (\w+) (\w+) met us\. Ms\. (\w+) called\. Then (\w+) left\. (\w+ \w+) wrote\.$", out[0]).groups()
    assert first == alone == later and loud == f"{first} {last}".upper() and first.endswith("ia")
    assert re.match(r"Ms\. (\w+) is here; Mr\. (\w+) too, and Mrs\. (\w+) (\w+)\.$", out[1]).groups()[:3] == (first, last, first)
    jones, kim, lee, kim2, park = re.match(r"Herr (\w+) saw Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+)\.$", out[2]).groups()
    assert jones == re.search(r" (\w+)\.$", out[1])[1] and kim == kim2 and not kim.endswith(("ia", "an"))
    assert len({first, last, jones, kim, lee, park}) == 6


def test_common_words_need_a_title_or_a_full_name(spark):
    out = _pii(spark, ["Mr. May came in May", "Dr. Will Young said: Young people Will go, and Will Young too", "may it be that young people will go, as they may and will, young as they are"])
    assert re.match(r"Mr\. (?!May)\w+ came in May$", out[0])
    a, b, c, d = re.match(r"Dr\. (\w+) (\w+) said: Young people Will go, and (\w+) (\w+) too$", out[1]).groups()
    assert (a, b) == (c, d) and {a, b}.isdisjoint({"Will", "Young"}) and out[2].startswith("may it be")


def test_crowded_formats_come_to_an_end(spark):
    mails = [f"{a}@{b}.{top}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for top in ("com", "org")]
    phones = [f"+99 12 {k:02d}" for k in range(100)] + [f"+99 34 {k:02d}" for k in range(100)]
    out = _pii(spark, [f"x {m} y" for m in mails + phones])
    assert len(set(out.values())) == len(out) and not any(f" {m} " in t for m in mails + phones for t in out.values())


def test_surrogates_keep_type_format_and_coreference(spark):
    """A few hundred made-up texts, whose mentions are known: a bijection by type, formats, check digits, equal mentions equal."""
    rng = random.Random(11)

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def iban():
        rest = "".join(rng.choices("0123456789", k=18))
        return f"DE{98 - int(rest + '131400') % 97:02d}{rest}"

    make = {
        "email": lambda: f"{rng.choice('abc')}{rng.randint(0, 400)}.x@{rng.choice(['m', 'mail'])}.example.org", "card": card, "iban": iban,
        "ssn": lambda: f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "ipv4": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "phone": lambda: f"+49 {rng.randint(100, 999)} {rng.randint(1000, 9999)} {rng.randint(100, 999)}",
    }
    forms = {
        "email": r"[a-z0-9]+\.[a-z]@[a-z]+\.example\.com", "card": r"4\d{15}", "iban": r"DE\d{20}", "ssn": r"9\d\d-\d\d-\d{4}",
        "ipv4": r"\d{1,3}(?:\.\d{1,3}){3}", "phone": r"\+49 \d{3} \d{4} \d{3}",
    }
    pool = [(k, make[k]()) for k in make for _ in range(40)]
    texts, said = [], []
    for _ in range(300):
        picked = rng.choices(pool, k=rng.randint(0, 4))
        texts.append("; ".join(f"so {m} it is" for _, m in picked) or "nothing here")
        said.append(picked)
    out = _pii(spark, texts)
    of = {}
    for i, picked in enumerate(said):
        got = re.findall(r"so (.+?) it is", out[i])
        assert len(got) == len(picked)
        for (kind, m), new in zip(picked, got):
            assert re.fullmatch(forms[kind], new), (kind, m, new)
            assert of.setdefault((kind, m), new) == new
            assert kind != "card" or luhn(new)
            assert kind != "iban" or int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    for kind in make:
        news = [v for (k, _), v in of.items() if k == kind]
        assert len(set(news)) == len(news) and not set(news) & {m for k, m in of if k == kind}


def test_surrogates_of_long_texts_repeats_and_nothing(spark):
    long = "word " * 200_000 + "Mr. Xaver Quill " + "x@y.example.org " * 3 + "Quill"
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (2, None)], "doc_id long, text string").withColumns({c: F.lit("c") for c in ("mark", "s", "_row", "kind", "canon", "form", "new", "surrogate", "common", "given", "style")})
    rows = P.replaced(df, "k").collect()
    assert len(rows) == 4 and len({r.text for r in rows if r.doc_id == 1}) == 1 and all(r.text is None and r.n_entities == 0 for r in rows if r.doc_id == 2)
    new = next(r for r in rows if r.doc_id == 1)
    assert "Quill" not in new.text and "Xaver" not in new.text and new.n_entities == 5 and new.text.startswith("word " * 200_000) and new.common == "c"
    assert P.replaced(df.limit(0), "k").columns == [*df.columns, "n_entities"]


def test_registry_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    q = __spark_entry__.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in q if n.startswith("op")} == set(range(1, 14)) and "pipeline" in q
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert set(docs.columns) <= set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 100
