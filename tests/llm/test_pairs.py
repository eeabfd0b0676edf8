"""Near-duplicates, lines and passages against brute force on small corpora with hot groups, ties and odd rows."""

import random
import re

import numpy as np

from quern.llm import blocks, common, line_dedup, near_dedup, substring_dedup


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = sentence(rng, 1)
    return " ".join(w)


def least(n, links):
    par = {i: i for i in n}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        par[b] = a
    return {i: find(i) for i in n}


def corpus():
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, base[0], i % 5)) for i in range(60)]  # one hot group
    rows += [(200 + i, base[1].upper()) for i in range(30)]
    rows += [(300 + i, edited(rng, base[2 + i % 5], 1 + i % 7)) for i in range(40)]
    return rows + [(400, None), (401, ""), (402, "one"), (403, "ONE"), (404, " \n "), (405, "two words"), (406, "two words")]


def test_components_by_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(800, 860)] + [(3, 3)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r.node: r.component for r in common.components(df).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == least(nodes, edges)


def test_near_duplicates(spark):
    for size in (2, 5):
        rows = corpus()
        df = spark.createDataFrame([(i, t, i) for i, t in rows] + [(405, "two words", 1), (None, "two words", 2)], "doc_id long, text string, component_id long").repartition(5)
        sets = {}
        for i, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = least(sets, links)
        got = near_dedup.near_duplicates(df, size).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.stage(spark, df.select("doc_id", "text"), "").count() < len(rows)


def test_crowded_keys_keep_pairs_of_unlucky_signatures(spark):
    """A pair at 0.8 whose min-hashes agree in over three deviations fewer places than expected is still verified."""
    rng = np.random.default_rng(3)
    share = lambda x, y: near_dedup.signature(x) == near_dedup.signature(y)
    while True:
        h = rng.integers(1, 2**63, 90, np.uint64)
        x, y = h[:81], np.concatenate((h[:72], h[81:]))  # 72 of 90
        same = share(x, y)
        heads = same.reshape(near_dedup.TREES, near_dedup.DEPTH)[:, : near_dedup.MIN_DEPTH].all(1)
        if same.mean() < 0.70 and heads.any():
            break
    sets = {1: np.sort(x), 2: np.sort(y), 3: np.sort(x)[:40]}
    items = spark.createDataFrame([(i, 1, bytearray(v.tobytes())) for i, v in sets.items()], "node long, weight int, item binary")
    members = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 3)], "key long, node long")
    comp = spark.createDataFrame([], "node long, component long")
    got = {tuple(sorted((r.a, r.b))) for r in blocks.crowded_links(members, comp, items, near_dedup.as_sets, 80).collect()}
    assert got == {(1, 2)}


def test_crowded_keys_give_a_forest(spark):
    """Thousands of links within one key come out as links that join its components, whatever the blocks."""
    rng = np.random.default_rng(8)
    core = rng.integers(1, 2**63, 100, np.uint64)
    sets = {i: np.unique(np.concatenate((core[: 100 - i % 37], rng.integers(1, 2**63, i % 37, np.uint64)))) for i in range(300)}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    want = least(sets, pairs)
    items = spark.createDataFrame([(i, 1 + i % 3, bytearray(v.tobytes())) for i, v in sets.items()], "node long, weight int, item binary")
    members = spark.createDataFrame([(k, i) for i in sets for k in (1, 2)] + [(3, i) for i in range(40)], "key long, node long")
    comp = common.components(spark.createDataFrame(pairs[::50], "a long, b long"))
    for block in (16, 1000):
        links = blocks.crowded_links(members, comp, items, near_dedup.as_sets, 80, block)
        assert links.count() < 20 * len(sets)
        got = {r.node: r.component for r in common.joined(comp, links).collect()}
        assert {i: got.get(i, i) for i in sets} == want


def line_reference(rows, min_chars):
    """Numbers of the lines to remove by document, and those that stay, by all pairs."""
    occ, sets = {}, {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            n = " ".join(x.lower().split())
            if len(n) >= min_chars:
                occ.setdefault(n, []).append((i, p))
                sets[n] = {n[k : k + 5] for k in range(max(1, len(n) - 4))}
    comp = least(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    keep = {}
    for n, os in occ.items():
        keep[comp[n]] = min([keep.get(comp[n], (10**9, 0)), *os])
    want = {}
    for n, os in occ.items():
        for o in os:
            if o != keep[comp[n]]:
                want.setdefault(o[0], []).append(o[1])
    return want


def test_lines(spark):
    rng = random.Random(9)
    lines = [sentence(rng, 12) for _ in range(20)]
    rows = [(i, "\n".join(edited(rng, rng.choice(lines), rng.choice((0, 0, 1))) if rng.random() < 0.7 else sentence(rng, 10) for _ in range(6))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, lines[0].upper() + "  "), (105, "x\ny\nx"), (106, "long " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least_chars in (20, line_dedup.MIN_CHARS):
        want = line_reference(rows, least_chars)
        assert (103 in want) == (least_chars == 1)
        gone = line_dedup.removed_lines(df, min_chars=least_chars)
        assert {r.doc_id: list(r.removed) for r in gone.collect()} == {i: sorted(p) for i, p in want.items()}
    out = {r.doc_id: r.text for r in line_dedup.without_lines(df, gone).collect()}
    for i, t in rows:
        left = [x for p, x in enumerate((t or "").split("\n")) if p not in want.get(i, [])]
        if i not in want:
            assert out[i] == t
        elif "".join(left).strip():
            assert out[i] == "\n".join(left)
        else:
            assert i not in out


def test_lines_of_odd_tables(spark):
    """Clashing column names, null and repeated ids, repeated rows; an empty table."""
    line = "a line of some length that stands twice"
    rows = [(None, line, "a", 1, 3), (None, line, "a", 1, 3), (5, f"{line}\nown words", "b", 2, 9), (5, "other text of this id", "c", 3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, _removed int, n_chars int").repartition(3)
    out = line_dedup.stage(spark, df, "")
    assert out.columns == df.columns
    got = sorted(out.collect(), key=lambda r: repr((r.doc_id is not None, tuple(r))))
    want = [(None, line, "a", 1, len(line))] * 2 + [(5, "own words", "b", 2, 9), (5, rows[3][1], "c", 3, 21)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr((r[0] is not None, r)))
    assert line_dedup.removed_lines(df.limit(0)).count() == 0 and line_dedup.stage(spark, df.limit(0), "").count() == 0


def test_lines_of_a_templated_cloud(spark):
    """Thousands of lines below the threshold share keys; every near pair that shares a key is found all the same."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fixed = letters(100)
    lines = [fixed + letters(14) for _ in range(1500)]
    lines += [x[:-k] + letters(k) for x in lines[:150] for k in (rng.choice((6, 7, 8)),)]
    rng.shuffle(lines)
    grams = sorted({x[k : k + 5] for x in lines for k in range(len(x) - 4)})
    number = {g: i for i, g in enumerate(grams)}
    m = np.zeros((len(lines), len(grams)), np.float32)
    for i, x in enumerate(lines):
        m[i, [number[x[k : k + 5]] for k in range(len(x) - 4)]] = 1
    both, size = m @ m.T, m.sum(1)
    keys = line_dedup.band_keys(lines)
    a, z = np.nonzero(np.triu(100 * both >= 80 * (size[:, None] + size - both), 1))
    near = [(i, j) for i, j in zip(a.tolist(), z.tolist()) if (keys[i] == keys[j]).any()]
    assert len(near) > 100 and max(np.unique(keys[:, k], return_counts=True)[1].max() for k in range(line_dedup.BANDS)) > 300
    comp = least(range(len(lines)), near)
    df = spark.createDataFrame([(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(len(lines) // 10)], "doc_id long, text string").repartition(4)
    gone = {r.doc_id * 10 + p for r in line_dedup.removed_lines(df).collect() for p in r.removed}
    assert gone == {i for i in comp if comp[i] != i}


def test_cartesian_tree_windows():
    rng = np.random.default_rng(2)
    for n in (0, 5, 40):
        v = rng.integers(0, 30, n).astype(np.uint64)
        got = substring_dedup.compact_windows(v, 6)
        for a in range(n):
            for z in range(a + 5, n):  # every passage of at least six places lies in exactly one window, at its minimum
                c = a + int(v[a : z + 1].argmin())
                assert [w for w in got if w[0] <= a and z <= w[2] and a <= w[1] <= z] == [w for w in got if w[1] == c and w[0] <= a and z <= w[2]] != []


def test_passages(spark):
    rng = random.Random(4)
    shared, other = sentence(rng, 60), sentence(rng, 80)
    rows = [(i, f"{sentence(rng, 30)} {shared} {sentence(rng, 40)}") for i in range(25)]
    rows += [(50, f"{sentence(rng, 20)} {edited(rng, other, 2)} {sentence(rng, 20)}"), (51, other), (60, sentence(rng, 200)), (61, f"{sentence(rng, 50)} {' '.join(shared.split(' ')[:20])}")]
    rows += [(70, sentence(rng, 55))] + [(71, None), (72, ""), (73, "a b c"), (74, "a b c")]
    rows += [(75, rows[29][1]), (76, rows[29][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int").repartition(6)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {*range(25), 50, 51, 70, 75, 76}
    assert {got[i].class_id for i in range(25)} == {0} and got[50].class_id == got[51].class_id == 50 and got[76].class_id == 70
    for i in range(25):
        assert any(s["begin"] <= 30 and s["end"] >= 90 for s in got[i].spans) and got[i].n_verified >= 1
    assert got[70].n_repeat_words == 55
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_passages_within_a_crowd(spark):
    """Exact repeats are found however many documents hold a part of them that is too short to count."""
    rng = random.Random(14)
    texts, pairs = [], []
    for common_words, own in ((47, 8), (40, 20), (20, 40)):
        common = sentence(rng, common_words)
        texts += [f"{sentence(rng, 40)} {common} {sentence(rng, 40)}" for _ in range(120)]
        for _ in range(25):
            left = rng.randint(0, own)
            passage = " ".join(x for x in (sentence(rng, left) if left else "", common, sentence(rng, own - left) if own > left else "") if x)
            pairs.append((len(texts), len(texts) + 1))
            texts += [f"{sentence(rng, rng.randint(20, 60))} {passage} {sentence(rng, rng.randint(20, 60))}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert all(a in got and b in got and got[a].class_id == got[b].class_id for a, b in pairs)
    assert set(got) == {x for p in pairs for x in p}


def test_a_covered_window_still_finds_other_repeats(spark):
    """A document shares 54 words with one document and 70 others, ending inside the same stock sentence, with another."""
    rng = random.Random(16)
    common = sentence(rng, 47)
    texts = [f"{sentence(rng, 40)} {common} {sentence(rng, 40)}" for _ in range(300)]
    triples = []
    for _ in range(40):
        after, before = sentence(rng, 7), sentence(rng, 50)
        inside = " ".join(common.split(" ")[:20])
        x, a, b = len(texts), len(texts) + 1, len(texts) + 2
        texts += [f"{sentence(rng, 30)} {before} {common} {after} {sentence(rng, 30)}", f"{sentence(rng, 30)} {before} {inside} {sentence(rng, 60)}", f"{sentence(rng, 35)} {common} {after} {sentence(rng, 30)}"]
        triples.append((x, a, b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert all(x in got and a in got and b in got and got[x].class_id == got[a].class_id == got[b].class_id for x, a, b in triples)
    assert set(got) == {i for t in triples for i in t}


def test_passages_against_all_pairs(spark):
    """Documents with edited and exact passages against the alignment of all pairs of texts."""
    rng = random.Random(15)
    stock = [sentence(rng, 12) for _ in range(3)]
    passages = [sentence(rng, rng.randint(55, 90)) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [sentence(rng, rng.randint(15, 50)), rng.choice(stock), sentence(rng, rng.randint(10, 40))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), edited(rng, p, rng.choice((0, 0, 1, 2))) if rng.random() < 0.8 else " ".join(p.split(" ")[: rng.randint(30, 54)]))
        texts.append(" ".join(parts))
    seqs = [substring_dedup.shingles_of(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if substring_dedup.passages(seqs[a], seqs[b], [(0, len(seqs[a]), 0, len(seqs[b]))], 50)]
    want = least(range(len(texts)), links)
    held = {x for p in links for x in p}
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (300, "word " * 30000), (301, "a b " * 9000)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(df).collect()}
    found = set(got) & set(range(len(texts)))
    assert found - {0} <= held and len(found & held) >= 0.95 * len(held)
    same = [(a, b) for a, b in links if got.get(a, -1) == got.get(b, -2)]
    assert len(links) > 100 and len(same) >= 0.95 * len(links)
    assert all(want[a] == want[b] for a in found & held for b in found & held if got[a] == got[b])


def test_pairs_out_of_order_are_sifted_before_verification(monkeypatch):
    """Texts that hold all of a window's shingles, in pieces of another order, are not verified one by one; a true repeat is."""
    rng = np.random.default_rng(8)
    x = np.arange(1, 81, dtype=np.uint32)
    pieces = np.array([x[10 * k : 10 * k + 10] for k in (0, 2, 4, 6, 1, 3, 5, 7)])
    seqs = [x, *(np.roll(pieces, k, axis=0).ravel() for k in range(8)), np.append(rng.integers(1000, 2**32, 7, np.uint32), x)]
    n = len(seqs)
    c = np.array([int(np.flatnonzero(s == 45)[0]) for s in seqs])
    calls, real = [], substring_dedup.passages
    monkeypatch.setattr(substring_dedup, "passages", lambda *a: calls.append(a) or real(*a))
    marks = np.arange(n)
    got = substring_dedup.Cell(marks, marks.copy(), np.zeros(n, int), c, c.copy(), c.copy(), marks == 0, np.zeros(n, int), seqs, 50).passages()
    assert got == [(0, n - 1, 0, 84, 7, 91)]
    assert len(calls) == 1


def test_passages_of_texts_that_repeat_themselves():
    """Of several places that nearest to the last match's diagonal, of equal widest gaps the last, as plain sets have it."""
    x = np.array([*range(100, 160), 7, 7, 7, *range(200, 230)], np.uint32)
    y = np.array([7, 7, *range(100, 160), 7, 7, *range(200, 230), *range(100, 120)], np.uint32)
    assert substring_dedup.passages(x, y, [(0, len(x) - 1, 0, len(y) - 1)], 50) == [(0, 97, 2, 98)]
    assert substring_dedup.passages(x, y[:50], [(0, len(x) - 1, 0, 49)], 50) == [(0, 52, 2, 54)]
