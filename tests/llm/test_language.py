import numpy as np

from ridgeline.llm import language as L
from ridgeline.llm import queries as Q
from ridgeline.sources.tables import table


def test_labels():
    for label, want in {"de-CH": "de", "Deutsch": "de", "fr_FR": "fr", "français": "fr", "norsk bokmål": "nb", "EN": "en", "castellano": "es", "": None, "und": None, "??": None, "xx": None, None: None}.items():
        assert L.label_language(label) == want


def test_paragraphs_and_sentences():
    assert L.paragraphs("a\nb\n \t\n\nc\n") == ["a\nb", "c"]
    assert L.sentences("1703 m") == [] and L.sentences("IMG_4842.JPG") == [] and L.sentences("6a+ 6b 5c") == [] and L.sentences("* * *") == []
    assert L.sentences("One of us. Two. Then three went.") == ["One of us. Two.", "Then three went."]
    assert L.sentences("Mont Blanc", frozenset({"mont", "blanc"})) == []


def test_held_out_accuracy(spark):
    """Trained on one half of the trusted samples and labelled documents, measured on the other half's sentences."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = L.train(docs.filter("doc_id % 2 = 0"), table(spark, "/root/testdata/sf0.01", "lang_sample").filter("sample_id % 2 = 0"))
    test = table(spark, "/root/testdata/sf0.01", "lang_sample").filter("sample_id % 2 = 1").collect()
    score = model.scores([L.plain(r.sample_text) for r in test])
    assert np.mean([L.LANGUAGES[k] == r.lang for k, r in zip(score.argmax(1), test)]) >= 0.9


def test_mixed_and_dirty_documents(spark):
    en = "After a slow breakfast, the whole group waited behind the hut, and nobody wanted to turn back."
    de = "Nach einer langen Pause wartete die ganze Gruppe hinter der Hütte, und niemand wollte umkehren."
    rows = [(1, f"{en} {en}\n\n1703 m\n\n{de}", "en"), (2, de.upper(), "de"), (3, en, "fr"), (4, de, None), (5, de, "de-CH"), (6, None, "de"), (7, "", None), (8, "6a+ 6b", None), (9, " \n\n" + en + "\n\n" + de, "??"), (10, (en + " ") * 3000, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, para_no string")
    model = L.train(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "lang_sample"))
    got = {(r.doc_id, r.para_no, r.lang) for r in L.doubtful(docs, model).collect()}
    assert got == {(1, 1, "en"), (1, 3, "de"), (3, 1, "en"), (4, 1, "de"), (9, 1, "en"), (9, 2, "de")}
    assert L.segment(docs.limit(0), model).count() == 0
    twice = {(r.doc_id, r.lang, r.n_languages) for r in L.document_languages(docs, model).collect()}
    assert {(1, "en", 2), (3, "en", 1), (9, "de", 2), (10, "en", 1)} <= twice and {6, 7, 8}.isdisjoint({d for d, _, _ in twice})


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "aaa bbb.\n\nccc ddd.", None)], "doc_id long, text string, lang string")
    model = L.Model([" aaa bbb ", " ccc ddd "], ["fr", "de"])
    assert [(r.lang, r.n_languages) for r in L.document_languages(docs, model, change=0.0).collect()] == [("de", 2)]


def test_reading_is_as_sentence_by_sentence():
    model = L.Model([" ein haus am see ", " a house by the sea "], ["de", "en"])
    texts = ["3b. Mont Blanc. One of us went. IMG_1.JPG\n\n6a+ 6b\n\nTwo of them stayed! Late.  x", "", "Ein Haus am See."]
    names = frozenset({"mont", "blanc"})
    want = [(n, k, i, len(s), model.scores([L.plain(s)])[0]) for n, t in enumerate(texts) for k, p in enumerate(L.paragraphs(t), 1) for i, s in enumerate(L.sentences(p, names), 1)]
    for reader, own in ((L.Reader(model, names), None), (L.Reader(model, frozenset()), [["mont", "blanc"], None, None]), (L.Reader(model, names, keep=3), None)):
        text, para, no, chars, scores = reader.read(texts, own)
        assert list(zip(text, para, no, chars)) == [w[:4] for w in want]
        assert np.allclose(scores, [w[4] for w in want])


def test_names_beyond_the_limit_are_joined(spark):
    docs = spark.createDataFrame([(1, "Mont Blanc. The old hut was closed.", None), (2, "Mont Blanc", None), (3, None, None)], "doc_id long, text string, lang string")
    peaks = spark.createDataFrame([("Mont Blanc", ["Monte Bianco"]), (None, None)], "peak_name string, aliases array<string>")
    model = L.train(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "lang_sample"))
    few, names = L.with_names(docs, peaks)
    many, none = L.with_names(docs, peaks, limit=1)
    assert names == {"mont", "blanc", "monte", "bianco"} and none == frozenset()
    rows = lambda d, n: sorted(L.segment(d, model, names=n).collect())
    assert rows(few, names) == rows(many, none) and {r.doc_id for r in rows(few, names)} == {1}


def test_words_forgotten_score_alike():
    a = L.Model([" ein haus am see ", " a house by the sea "], ["de", "en"])
    b = L.Model([" ein haus am see ", " a house by the sea "], ["de", "en"], keep=2)
    pieces = ["ein haus", "", "the sea by the see", "haus"]
    assert np.allclose(a.scores(pieces), np.concatenate([b.scores([p]) for p in pieces]))


def test_no_training_rows(spark, sf):
    docs = table(spark, sf, "documents")
    assert L.segment(docs, L.train(docs.limit(0), table(spark, sf, "lang_sample"))).count() > 0
    assert Q.p10_found(spark, sf).columns == ["doc_id", "para_no", "lang"]
