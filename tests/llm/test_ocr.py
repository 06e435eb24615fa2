from ridgeline.llm import ocr as O

CLEAN = ["Early in the morning, the guide checked every knot near the old hut, although the snow was soft.", "A south-facing slab stayed dry, and nobody wanted to turn back after the storm had dropped.", "Three of us carried the ropes along a well-worn track at the foot of the ridge."] * 60
PAGE = """80    North Faces
Early in the morning, the gu1de checked ev-
ery knot near the old hut, although the
snow was soft. A south-
facing slab stayed dry, and n0body wanted to turn back af¬
ter the storm had dropped.

6b+
NORTH FACES
Three of us carricd the ropes along a well-
worn track at the foot of Ruskhorn.
· 28 ·"""


def pages(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k long, t string, text string")
    return O.pages_of(("ocr_text", df, "k", "t"))


def inputs(spark, texts):
    return pages(spark, texts), spark.createDataFrame([(t,) for t in [*CLEAN, None, ""]], "text string"), spark.createDataFrame([("Ruskhorn",), (None,)], "name string")


def test_cases_and_repair(spark):
    texts = [PAGE, PAGE, None, "", "  \n ", "Pico Trevarón 1937 m", "North Faces\nEarly in the morning, the guide checked every knot.\nThe snow was soft near the old hut.\n- 12 -", "x" * 100_000]
    args = inputs(spark, texts)
    got = {(r.row_key, r.line_no, r.noise_kind) for r in O.noise(*args).collect()}
    page = {(1, "header"), (1, "page_no"), (2, "hyphen"), (2, "misread"), (5, "misread"), (5, "hyphen"), (9, "header"), (10, "misread"), (12, "page_no")}
    assert {(n, k) for i, n, k in got if i == 0} == page and {(n, k) for i, n, k in got if i == 1} == page
    assert {(n, k) for i, n, k in got if i == 6} == {(1, "header"), (4, "page_no")}
    assert {i for i, _, _ in got} == {0, 1, 6}
    out = {r.row_key: r.text for r in O.repaired(*args).collect()}
    assert out[0].startswith("Early in the morning, the guide checked every knot near the old hut, although the snow was soft. A south-facing slab stayed dry, and nobody wanted to turn back after the storm had dropped.\n\n6b+")
    assert out[0].endswith("Three of us carried the ropes along a well-worn track at the foot of Ruskhorn.")


def misread_rows(spark, texts):
    return {r.row_key for r in O.noise(*inputs(spark, texts)).collect() if r.noise_kind == "misread"}


def test_misread_names_are_found_however_many_there_are(spark):
    right = [f"Early in the morning, the guide checked every knot near Ruskhorn.\nThe snow was soft near the old hut {k}." for k in range(5, 10)]
    wrong = [t.replace("Ruskhorn", "Ruskborn") for t in right]
    assert misread_rows(spark, wrong[:2]) == {0, 1}
    # with the name read right elsewhere on the pages
    assert misread_rows(spark, wrong + right) == set(range(5))
    # copies of one page count once
    assert misread_rows(spark, wrong[:1] * 6) == set(range(6))
    # a form of many texts of which no page has the name is a word of its own
    assert misread_rows(spark, wrong) == set()


def test_names_count_as_often_as_they_stand_in_the_clean_texts(spark):
    words = spark.createDataFrame([(["alpha"] * 2 + ["beta"] * 2 + ["gamma"] * 5,)], "words array<string>")
    names = spark.createDataFrame([("Alpha",), ("Delta",), ("Gamma",)], "name string")
    assert {r.word: r.n for r in O.vocabulary(words, names).collect()} == {"alpha": 3, "gamma": 6, "delta": 1}


def test_empty(spark):
    args = inputs(spark, [None])
    assert O.noise(*args).count() == 0 and O.repaired(*args).count() == 0


def cost(word, right, limit):
    """Least cost of the moves by dynamic programming over both words."""
    best = {(0, 0): 0}
    for i in range(len(word) + 1):
        for j in range(len(right) + 1):
            c = best.get((i, j), 99)
            for a, b in O.CONFUSIONS:
                if right.startswith(a, j) and word.startswith(b, i):
                    key = (i + len(b), j + len(a))
                    best[key] = min(best.get(key, 99), c + 1)
            if i < len(word):
                best[i + 1, j] = min(best.get((i + 1, j), 99), c + 2)
            if j < len(right):
                best[i, j + 1] = min(best.get((i, j + 1), 99), c + 2)
            if i < len(word) and j < len(right):
                step = 0 if word[i] == right[j] else 1 if word[i].isdigit() or word[i] == "!" else 2
                best[i + 1, j + 1] = min(best.get((i + 1, j + 1), 99), c + step)
    c = best.get((len(word), len(right)), 99)
    return c if c <= limit else None


def test_automaton_finds_every_candidate():
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abceilmnrtuvdh1!") for _ in range(rng.randint(1, 6)))
    vocabulary = sorted({word() for _ in range(300)})
    trie = O.Trie(vocabulary, [1] * len(vocabulary))
    for _ in range(150):
        w = word()
        got = {c: k for c, k, _ in trie.search(w, 2)}
        assert got == {v: k for v in vocabulary if (k := cost(w, v, 2)) is not None}, w
