import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import session
from ridgeline.functions import pixels, time
from ridgeline.operators import duplicates, events, index, search, sessions, store

T0 = datetime(2025, 7, 12, 8)


def test_free_names(spark):
    rng = random.Random(2)
    rows = [("d" if i % 3 else "e", rng.choice(["a.jpg", "A.jpg", "a_2.jpg", "a_3.JPG", "a_2_2.jpg", "b", "b_2", "a_1.jpg", "a_02.jpg", ".x", "a_99999999999.jpg"]), i) for i in range(80)]
    df = spark.createDataFrame(rows, "folder string, name string, i int")
    got = store.with_free_names(df, ["folder"], "name", "out", "i").collect()
    assert len(got) == len(rows) == len({(r.folder, r.out.lower()) for r in got})
    first = {}
    for f, n, i in rows:
        first.setdefault((f, n.lower()), i)
    assert all((r.out == r["name"]) == (first[r.folder, r["name"].lower()] == r.i) for r in got)


def test_edits_are_read_back(spark):
    rows = [(1, 'Tour "A" \\ b', False), (2, None, True), (3, "***", True), (4, "Zürich", False)]
    df = spark.createDataFrame(rows, "i long, n string, m boolean")
    lines = df.select(F.lit("l").alias("k"), store.edit_line(F.col("i"), F.col("n"), F.col("m")).alias("line")).unionByName(spark.createDataFrame([("l", "name = \"no index\""), ("l", None)], "k string, line string"))
    got = {r["index"]: (r["name"], r.merge) for r in store.read_edits(lines, "k", "line").collect()}
    assert got == {1: ("Tour_A_b", False), 2: (None, True), 3: (None, True), 4: ("Zurich", False)}


def test_words_of_lists_stay_whole(spark):
    df = spark.createDataFrame([(["0a", " 1b ", "", None, "none", "unknown", "5c", "0a", "7d "],)], "w array<string>")
    row = df.select(store.clean_list(F.col("w"), 4).alias("c"), store.keywords([F.col("w"), F.lit(None).cast("array<string>")]).alias("k")).first()
    assert row.c == ["0a", "1b", "none", "unknown"] and row.k == ["0a", "1b", "5c", "7d"]


def test_labels_and_texts_of_times(spark):
    seconds = {45_000.0: "12.5h", 172_799.0: "48.0h", 172_800.0: "2.0 days", 5_183_999.0: "60.0 days", 5_184_000.0: "60 days"}
    df = spark.createDataFrame([(s,) for s in seconds], "s double")
    assert {r.s: r.t for r in df.select("s", time.gap_label(F.col("s")).alias("t")).collect()} == seconds
    df = spark.createDataFrame([(datetime(2025, 7, 1, 2, 3, 4),), (datetime(2025, 7, 1, 2, 3, 4, 500),), (None,)], "t timestamp_ntz")
    assert [r.x for r in df.select(time.iso_text(F.col("t")).alias("x")).collect()] == ["2025-07-01T02:03:04", "2025-07-01T02:03:04.000500", None]
    texts = ["2025:07:01 02:03:04", "2025-07-01 02:03", "2025:07-01 02:03:04", "0000:00:00 00:00:00", "2025:13:01 02:03:04", None, "2025:07:01 02:03:04\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [str(r.x) for r in df.select(time.exif_datetime(F.col("t")).alias("x")).collect()] == ["2025-07-01 02:03:04", "2025-07-01 02:03:00", "None", "None", "None", "None", "2025-07-01 02:03:04"]


def test_pixels(spark):
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, (8, 9)).astype(float) for _ in range(5)] + [np.full((8, 9), 10.0), np.full((8, 9), 250.0), np.full((8, 9), 100.0)]
    df = spark.createDataFrame([(i, [float(x) for x in f.ravel()]) for i, f in enumerate(frames)], "i int, p array<double>")
    m, s = pixels.mean(F.col("p")), pixels.stddev(F.col("p"))
    got = df.select("i", m.alias("m"), s.alias("s"), pixels.edges(F.col("p"), 9).alias("e"), pixels.emptiness(m, s).alias("r"), pixels.difference_hash(F.col("p")).alias("h"), pixels.scenic(F.col("p"), 9, 8).alias("c")).orderBy("i").collect()
    for f, r in zip(frames, got):
        e = np.abs(np.diff(f, axis=1)).mean()
        assert np.allclose([r.m, r.s, r.e], [f.mean(), f.std(), e])
        bits = int("".join("1" if a > b else "0" for row in f for a, b in zip(row, row[1:])), 2)
        assert r.h & (2**64 - 1) == bits
        sky = min(1, max(0, (f[:2].mean() - f[2:].mean()) / 128) + 0.6 * max(0, (f[2:].std() - f[:2].std()) / 64))
        assert np.isclose(r.c, 2 * sky + min(1, e / 18) * (0.6 if e > 26 else 1) + 0.35)
    assert [r.r for r in got] == [None] * 5 + ["black", "white", "blank"]


def test_stored_index_is_as_one_built_anew(spark, tmp_path):
    texts = {1: "storm after storm", 2: "after the hut", 3: "storm", 4: "", 5: "the storm came after", 6: "nothing"}
    rows = lambda d: spark.createDataFrame(list(d.items()), "record_id long, body string")
    folder = str(tmp_path / "index")
    index.build(rows({k: texts[k] for k in (1, 2, 3, 4)}), folder)
    changed = {2: "after the storm", 3: "", 5: texts[5], 6: texts[6]}
    index.update(rows(changed), folder, spark)
    now = texts | changed
    live = [len(t.split()) for t in now.values() if t]
    want = search.bm25(search.postings(rows(now)), ["storm", "after"], len(live), sum(live) / len(live))
    got = {r.record_id: round(r.score, 9) for r in index.search(spark, folder, "Storm after").collect()}
    assert got == {r.record_id: round(r.score, 9) for r in want.collect()} and set(got) == {1, 2, 5}
    assert index.search(spark, folder, "unheard").count() == 0


def test_keepers_by_the_best_evidence(spark):
    schema = "g int, source_path string, width int, height int, size_bytes long, timestamp_source string, lat double, lon double, sharp double, sharpness string, gaze string, eyes_closed_count int, composition string, aesthetic_score int, exposure string, judged boolean"
    row = lambda g, p, w, sharp, sharpness, judged: (g, p, w, 10, None, None, None, None, sharp, sharpness, None, None, None, None, None, judged)
    rows = [row(1, "a", 9, None, "blurry", True), row(1, "b", 1, None, "sharp", True), row(1, "c", 5, 9.0, None, False)]
    rows += [row(2, "a", 9, 0.1, "sharp", True), row(2, "b", 1, 0.5, None, False), row(3, "a", 1, None, None, None), row(3, "b", 9, 3.0, None, None), row(4, "b", None, 1.0, None, False), row(4, "a", None, 1.0, None, False)]
    got = {r.g: (r.before, r.keeper, r.reason) for r in duplicates.reelect(spark.createDataFrame(rows, schema), "g", "source_path", measure="sharp").collect()}
    assert got == {1: ("a", "b", "judged"), 2: ("a", "b", "measured"), 3: ("b", "b", "metadata"), 4: ("a", "a", "measured")}


def test_near_classes_lose_no_link(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(48) | 0xF0F0 << 48 for _ in range(3)]
    rows = [(i, (h := rng.choice(base) ^ rng.choice([0, 0, 0, 1, 3, 0b11111])) - (1 << 64 if h >> 63 else 0), None if rng.random() < 0.1 else T0 + timedelta(hours=rng.uniform(0, 200))) for i in range(120)]
    df = spark.createDataFrame(rows, "item long, h long, ts timestamp_ntz")
    first = {r.item: r["first"] for r in duplicates.near_members(df, item="item", phash="h", ts="ts").collect()}
    pairs = {(r.item_a, r.item_b) for r in duplicates.near_pairs(df, item="item", phash="h", ts="ts").collect()}
    near = lambda a, b: ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= 4 and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= timedelta(hours=24))
    want = {(min(x, y), max(x, y)) for a in rows for b in rows if near(a, b) and (x := first[a[0]]) != (y := first[b[0]])}
    assert pairs == want
    assert all(near(a, b) for a in rows for b in rows if first[a[0]] == first[b[0]])


def test_event_without_records(spark):
    columns = "k string, i long, verified_peak string, evidence_basis string, location_confidence string, verified_lat double, verified_lon double, verified_country string, keywords array<string>, latitude double, longitude double, " + ", ".join(f"{c} string" for c in events.VOTED)
    votes = lambda **v: tuple(v.get(c) for c in events.VOTED)
    rows = [("a", 1, "Eiger", "landmark_recognition", "low", 46.5, 8.0, "CH", ["x", "", "b"], None, None, *votes(activity="none", region="R"))]
    rows += [("b", 2, "Eiger", "sign_in_scene", "high", 46.5, 8.0, "CH", None, None, None, *votes(activity="hiking", region="")), ("b", 3, None, None, None, None, None, None, ["b", "a"], 1.0, 1.0, *votes(activity="unknown", region="S"))]
    df = spark.createDataFrame(rows, columns)
    got = {r.k: r for r in events.summaries(df, ["k"], "i").collect()}
    assert (got["a"].verified_peak, got["a"].rejected_peak, got["a"].activity, got["a"].region, got["a"].keywords) == (None, "Eiger", "unknown", "R", ["b", "x"])
    assert (got["b"].verified_peak, got["b"].rejected_peak, got["b"].activity, got["b"].region, got["b"].considered, got["b"].season) == ("Eiger", None, "hiking", "S", 2, "unknown")
    assert events.summaries(df.limit(0), ["k"], "i").count() == 0


def test_even_samples(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"p{i:03d}", None if rng.random() < 0.1 else T0 + timedelta(days=rng.choice([0, 5, 400, 401, 900]), minutes=rng.randrange(5))) for i in range(200)] + [("c", "x", None), ("c", "y", T0)]
    got = {(r.k, r.item) for r in sessions.even_sample(spark.createDataFrame(rows, "k string, item string, ts timestamp_ntz"), "k", 5, "ts", "item").collect()}
    want = set()
    for key in ("a", "b", "c", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is None, r[2] or T0, r[1]))
        want |= {(key, mine[i][1]) for i in (range(len(mine)) if len(mine) <= 5 else {j * len(mine) // 5 for j in range(5)})}
    assert got == want


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Nothing:
        def __getattr__(self, name):
            return lambda *a, **k: self if name != "isDefined" else False

    class Context:
        master, _jsc = "spark://host:7077", Nothing()

    class Spark:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())
