import random

import pytest

from ridgeline.llm import leakage as L


def brute(doc, passage, run):
    d, p = L.words(doc or ""), L.words(passage or "")
    grams = {tuple(p[i : i + run]) for i in range(len(p) - run + 1)}
    return any(tuple(d[i : i + run]) in grams for i in range(len(d) - run + 1))


@pytest.mark.parametrize("limit", [10**6, 20])
def test_against_all_windows(spark, limit):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abéñz1") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 30])))) for i in range(20)]
    items += [(20, items[5][1]), (21, None), (22, "")]
    docs = []
    for i in range(150):
        p = rng.choice(items[:20])[1].split()
        a = rng.randrange(len(p))
        part = p[a : a + rng.randint(1, 20)]
        text = " ".join([word() for _ in range(3)] + part + [word() for _ in range(3)])
        docs.append((i, rng.choice([text, text.upper(), text.replace(" ", ",\n​"), text + " " + text])))
    docs += [(500, None), (501, ""), (502, "x " * 50_000 + items[8][1])]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, passage string, doc_id string")
    got = [(r.doc_id, r.item_id) for r in L.leaks(d, e, run=12, max_chunks=limit).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, t in docs for j, p in items if brute(t, p, 12)}


def test_offsets(spark):
    passage = "Ein Straßencafé mit Añejo und ﬁnem Blick auf den alten See am Morgen früh"
    text = f"Vorher. {passage.upper()}, danach."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    e = spark.createDataFrame([(7, passage)], "item_id long, passage string")
    r = L.spans(d, e).collect()[0]
    assert len(L.word_spans(text)) == len(L.words(text))
    assert L.words(text[r.start_char : r.end_char]) == L.words(text)[-1 - r.n_words : -1]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([], "item_id long, passage string")
    assert L.leaks(d, e).count() == 0
