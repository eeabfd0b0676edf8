"""The five stages one after the other against their slow references, and over an empty table."""

import hashlib
import random
import re

from test_others import smith_waterman
from test_pairs import edited, least, line_reference, sentence
from test_quality_rules import brute, reference

import corpus_pipeline
from quern.llm import decontamination as D
from quern.llm import sentencepiece_codec as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, removed string, kept boolean"


def written(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(31)
    items = [(1, sentence(rng, 30)), (1, sentence(rng, 25)), (2, None), (3, "")]
    base = [sentence(rng, 60) for _ in range(30)]
    texts = ["\n".join((t, sentence(rng, 12))) for t in base]
    texts += [edited(rng, base[0], k % 4) for k in range(15)] + [base[1].upper(), base[1]]
    texts += [f"{sentence(rng, 40)}\na line that stands in many documents\n{sentence(rng, 30)}" for _ in range(10)]
    texts += [f"{sentence(rng, 20)} {t} {sentence(rng, 20)}" for _, t in items[:2]]
    texts += [" ".join(f"{w}###" for w in sentence(rng, 50).split(" ")), "too short", None, "", "a line that stands in many documents", sentence(rng, 8) + "\n\n\n" + sentence(rng, 20)]
    for t in base[2:7]:  # the same words in other lines
        w = t.split(" ")
        texts.append("\n".join(" ".join(w[k : k + 20]) for k in (0, 20, 40)))
    rows = [(i, t, rng.choice(("en", "de", None)), f"s{i % 2}", len(t) if t else None, i, "x", None) for i, t in enumerate(texts)]

    verdict = reference([(r[0], r[2], r[3], brute(r[1])) for r in rows])
    docs = {r[0]: r[1] for r in rows if verdict[r[0]] and verdict[r[0]][1]}
    gone = line_reference(list(docs.items()), 1)
    cut = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in docs.items()}
    docs = {i: t for i, t in cut.items() if i not in gone or t.strip()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)} for i, w in words.items()}
    comp = least(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    docs = {i: t for i, t in docs.items() if comp[i] == i}
    copies = {i for i, t in docs.items() for _, x in items if x and smith_waterman(D.words(x), D.words(t)) >= D.MIN_SCORE * D.MATCH * len(D.words(x))}
    docs = {i: t for i, t in docs.items() if i not in copies}
    assert len(copies) == 2 and gone and sum(comp[i] != i for i in comp) > 0

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, written(spark, tmp_path, rows, items)).collect()}
    assert {i: r.text for i, r in out.items()} == docs
    sp = S.codec(S.default_model()).sp
    for i, r in out.items():
        ids = sp.encode(r.text, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r._row == i and r.removed == "x" and r.n_chars == len(r.text)


def test_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, written(spark, tmp_path, [], []))
    assert out.count() == 0 and {"doc_id", "text", "_row", "removed", "n_tokens"} <= set(out.columns)
