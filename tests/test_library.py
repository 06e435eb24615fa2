import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ridgeline.functions import text, time
from ridgeline.operators import classify, duplicates, fusion, resolve, sessions, store
from ridgeline.streaming import live

ITEMS = "lib string, source_path string, taken_ts timestamp_ntz, lat double, lon double, timestamp_source string, camera_model string, size_bytes long"
T0 = datetime(2025, 7, 12, 8)


def items(spark, spots):
    return spark.createDataFrame([("a", f"p{i:03d}", None if m is None else T0 + timedelta(minutes=m), la, lo, "exif", "C", 10) for i, (m, la, lo) in enumerate(spots)], ITEMS)


@pytest.mark.parametrize(("spots", "want"), [
    ([(m, None, None) for m in (0, 10, 20, 30)], 1),
    ([(0, None, None), (30, None, None), (800, None, None)], 2),
    ([(0, 46.5936, 7.9089), (10, 46.5936, 7.9089), (100, 46.0207, 7.7491)], 2),
    ([(0, 46.5936, 7.9089), (1, 46.0207, 7.7491), (2, 46.5936, 7.9089)], 1),
    ([(0, None, None), (5, None, None), (None, None, None)], 2),
    ([(None, None, None), (None, None, None)], 1),
    ([(0, None, None), (720, None, None)], 1),
])
def test_session_counts(spark, spots, want):
    got = sessions.sessions(items(spark, spots), library="lib", item="source_path")
    assert got.select("session_no").distinct().count() == want


def test_sessions_against_a_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for lib in range(60):
        t, out = 0, []
        for i in range(rng.randint(1, 25)):
            t += rng.choice([0, 5, 19, 20, 25, 600, 720, 721])
            undated = rng.random() < 0.1
            fix = rng.random() < 0.5
            out.append((str(lib), f"p{i:03d}", None if undated else T0 + timedelta(minutes=t), 46.0 + rng.choice([0, 0.05, 0.2]) if fix else None, 7.0 if fix else None, "exif", None, 1))
        rows += out
        out = sorted(out, key=lambda r: (r[2] is None, r[2] or T0, r[1]))
        dated, no, prev, last = any(r[2] for r in out), 1, None, None
        for k, r in enumerate(out):
            gap = (r[2] - prev).total_seconds() if r[2] and prev else None
            split = k and (r[2] is None and dated or gap is not None and gap > 12 * 3600)
            fix = (r[3], r[4]) if r[3] is not None else None
            if k and not split and fix and last and abs(fix[0] - last[0]) * 111.19 > 15 and gap is not None and gap >= 1200:
                split = True
            if split:
                no, last = no + 1, None
            last, prev = fix or last, r[2]
            want[r[0], r[1]] = no
    got = sessions.sessions(spark.createDataFrame(rows, ITEMS), library="lib", item="source_path").collect()
    assert {(r.lib, r.source_path): r.session_no for r in got} == want


def test_trips(spark):
    def run(*rows):
        data = [("a", i, datetime(2025, 7, d, h), datetime(2025, 7, d, h), p, r, n) for i, (d, h, p, r, n) in enumerate(rows, 1)]
        df = spark.createDataFrame(data, "lib string, session_no long, start_ts timestamp_ntz, end_ts timestamp_ntz, place string, mountain_range string, read_name boolean")
        return [r.trip_no for r in sessions.merge_trips(df, library="lib").orderBy("session_no").collect()]

    assert run((10, 18, "Dibona", None, False), (11, 9, None, None, False)) == [1, 1]
    assert run((10, 18, "Dibona", None, False), (11, 9, "Salbit", None, False)) == [1, 2]
    assert run((10, 18, None, None, False), (11, 9, None, None, False)) == [1, 2]
    assert run((10, 12, None, "Ecrins", False), (14, 12, None, "Ecrins", False)) == [1, 2]


def test_chunks(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([50, 60, 10, None, 200, 1, 1, 1])], "k string, i int, n long")
    got = [r.chunk_no for r in sessions.chunks(df, partition="k", order="i", size="n", max_bytes=100, max_rows=3).orderBy("i").collect()]
    assert got == [1, 2, 2, 2, 3, 4, 4, 4]


def test_near_groups_are_complete(spark):
    base = 0x00FF_00FF_00FF_00FF
    rows = [(1, base, T0), (2, base ^ 1, T0), (3, base ^ 0b111110, T0), (4, base, T0 + timedelta(hours=30)), (5, 0, T0), (6, None, T0), (7, base ^ 3, None)]
    df = spark.createDataFrame(rows, "item long, h long, ts timestamp_ntz")
    got = {r.item: r.seed for r in duplicates.near_groups(df, item="item", phash="h", ts="ts").collect()}
    assert got == {1: 1, 2: 1, 7: 1}
    pairs = {(r.item_a, r.item_b) for r in duplicates.near_pairs(df, item="item", phash="h", ts="ts").collect()}
    assert (1, 2) in pairs and (1, 4) not in pairs and (4, 7) in pairs and not any(5 in p or 6 in p for p in pairs)


def test_near_groups_split_a_band_in_time(spark):
    import random

    rng = random.Random(5)
    base = 0x00FF_00FF_00FF_00FF
    times = [T0 + timedelta(hours=rng.choice([0, 200, 400, -60000 * 24]) + rng.uniform(0, 70)) for _ in range(300)]
    for untimed in (0, 20):
        rows = [(i, base ^ rng.choice([0, 1, 3, 7, 0b11110000, 0b111111]), None if i < untimed else t) for i, t in enumerate(times)]
        df = spark.createDataFrame(rows, "item long, h long, ts timestamp_ntz")
        groups = []
        for i, h, t in rows:
            fits = (g for g in groups if all((h ^ b).bit_count() <= 4 and (t is None or u is None or abs(t - u) <= timedelta(hours=24)) for _, b, u in g))
            g = next(fits, None)
            if g is None:
                groups.append(g := [])
            g.append((i, h, t))
        got = {(r.item, r.seed) for r in duplicates.near_groups(df, item="item", phash="h", ts="ts").collect()}
        assert got == {(m[0], g[0][0]) for g in groups if len(g) > 1 for m in g}
        pieces = duplicates.near_pieces(df.selectExpr("1 AS band", "unix_micros(CAST(ts AS timestamp)) AS t"), 24 * 3_600_000_000)
        assert pieces.count() == 300 and pieces.select("piece").distinct().count() == (1 if untimed else 4)


def test_text_functions(spark):
    names = {"Aiguille Dibona": True, "Salbitschijen": True, "Aiguille": False, "Le Toit": False, "Am Berg": False, "Hochschneid - La Cresta": True, "Sé Pé": False, "": False}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.s for r in df.select("n", text.is_specific(F.col("n")).alias("s")).collect()} == names
    graded = {"la cheminee (5b)": True, "Pilier Kocher (6b+)": True, "Nose (5.10a)": True, "Directe (IV+)": True, "Piz Buin 3312 m": False, "Dammazwillinge (3.275 m)": False}
    df = spark.createDataFrame([(k, k.split(" (")[0].split(" 3312")[0]) for k in graded], "t string, n string")
    assert {r.t: r.g for r in df.select("t", text.followed_by_grade(F.col("n"), F.col("t")).alias("g")).collect()} == graded
    labels = {"Zürich": "Zurich", "Grindelwald Grund": "Grindelwald_Grund", "***": "", "nul": "nul_place", "a/b:c": "a_b_c"}
    df = spark.createDataFrame([(k,) for k in labels], "n string")
    assert {r.n: r.s for r in df.select("n", text.safe_label(F.col("n")).alias("s")).collect()} == labels
    dates = {"IMG_20250712_083145.jpg": "2025-07-12 08:31:45", "PXL_20250712_063145123.jpg": "2025-07-12 06:31:45", "2025-07-12 08.31.45.jpg": "2025-07-12 08:31:45", "20250712.heic": "2025-07-12 00:00:00", "DSC00123.jpg": "None", "IMG_20251399_000000.jpg": "None", "IMG_20250231_000000.jpg": "None"}
    df = spark.createDataFrame([(k,) for k in dates], "n string")
    assert {r.n: str(r.t) for r in df.select("n", time.filename_datetime(F.col("n")).alias("t")).collect()} == dates


def test_fuzzy_names_against_all_pairs(spark):
    rng = random.Random(9)
    peaks = [(i, "".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) + rng.choice(["", " alto", " peak"]), 46.0, 7.0, i, "CH", []) for i in range(120)]
    p = spark.createDataFrame(peaks, "peak_id long, peak_name string, lat double, lon double, elevation int, country string, aliases array<string>")
    asked = spark.createDataFrame([(n[:2] + "x" + n[3:],) for _, n, *_ in peaks[:60]] + [("",), (None,)], "name string")
    known = resolve.spellings(p)
    got = {(r.name, r.peak_id) for r in resolve.fuzzy_matches(asked, known, limit=1000).collect()}
    pairs = asked.filter("name <> ''").distinct().select("name", text.normalise_name(F.col("name")).alias("q")).join(known.select("peak_id", "normal").hint("broadcast"), F.lit(True))
    scored = pairs.withColumn("s", text.name_similarity(F.col("q"), F.col("normal"))).filter("s >= 0.82").collect()
    exact = {r.name for r in scored if r.s == 1.0}
    assert got == {(r.name, r.peak_id) for r in scored if r.s == 1.0 or r.name not in exact}


def test_noisy_or(spark):
    rows = [("s", "A", "sign_in_scene", "low"), ("t", "A", "landmark_recognition", "high"), ("u", "A", "none", "medium"), ("u", "A", "landmark_recognition", "medium")]
    df = spark.createDataFrame(rows, "session string, peak string, basis string, confidence string")
    got = {r.session: r.probability for r in fusion.ranked_peaks(df, "session").collect()}
    assert abs(got["s"] - 0.828) < 1e-9 and abs(got["t"] - 0.308) < 1e-9 and abs(got["u"] - (1 - 0.72 * (1 - 0.28 * 0.6))) < 1e-9


def test_consensus(spark):
    near = [(46.59, 8.42), (46.60, 8.43), (46.58, 8.41)]
    groups = {"a": [*near, (46.61, 8.44)], "b": [*near, (34.10, -116.16)], "c": [(43.53, 5.57), (39.78, 2.83), (42.28, -0.08), (67.30, 28.16)], "d": near[:1]}
    df = spark.createDataFrame([(g, i, *p) for g, ps in groups.items() for i, p in enumerate(ps)], "session string, i int, lat double, lon double")
    got = {r.session: r.agreeing for r in fusion.consensus(df, "session", "i").collect()}
    assert got == {"a": 4, "b": 3}


def test_tags():
    n = classify.n_prompts()
    row = lambda *at: [1.0 if i in at else 0.0 for i in range(n)]
    assert classify.tag_rows(np.array([row(0, 6, 12)]))[0][:2] == ["climbing", "summit"]
    assert "climbing" not in classify.tag_rows(np.array([row(4, 6, 12)]))[0]
    paper = classify.tag_rows(np.array([row(0, 6, 12, 29, 32)]))[0]
    assert paper == ["document"]
    assert classify.tag_rows(np.array([row(24, 32, 36)]))[0] == ["indoors"]


def test_merge_latest(spark):
    schema = "k string, seq long, size long, raw string, v string"
    base = spark.createDataFrame([("a", 1, 10, "r1", "x"), ("b", 2, 20, None, "y")], schema)
    new = spark.createDataFrame([("a", 3, 99, None, "z"), ("c", 4, 5, None, None)], schema)
    got = {r.k: (r.seq, r.size, r.raw, r.v) for r in store.merge_latest(base, new, "k", "seq", keep_first=["size"], keep_known=["raw"]).collect()}
    assert got == {"a": (3, 10, "r1", "z"), "b": (2, 20, None, "y"), "c": (4, 5, None, None)}


def test_verified_write_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2020), (2, None, 2021), (3, "c", 2021)], "i int, s string, year int")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    for _ in range(2):
        assert all(r.verified for r in store.verified_write(df, str(tmp_path / "t"), partition=["year"]).collect())


def test_stream_merge_is_idempotent(spark, tmp_path):
    schema = "k string, seq long, v string"
    for i, rows in enumerate([[("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.merge_batches(stream, str(tmp_path / "out"), "k", "seq", str(tmp_path / "cp"))
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()}
    assert got == {"a": "z", "b": "y"}


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
