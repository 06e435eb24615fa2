import json

from ridgeline.operators import schema_drift as D


def files(n, store="s"):
    return [(f"{store}-{i}", store, i) for i in range(1, n + 1)]


def rows(docs_of):
    return [(f, None if d is None else d if isinstance(d, str) else json.dumps(d), None) for f, docs in docs_of.items() for d in docs]


def run(spark, docs_of, n):
    a = spark.createDataFrame(rows(docs_of), "export_file string, payload string, raw_response string")
    f = spark.createDataFrame(files(n) * 2, "export_file string, store_id string, file_seq int")
    return {(r.export_file, r.change_kind, r.field_name, r.new_value) for r in D.changes(a, f).collect()}


def doc(i, **more):
    return {"country": "CH", "scene": ["lake", "forest", "hut"][i % 3], "people_count": i % 4, "caption": f"a view of number {i}", "notes": None} | more


def test_changes(spark):
    swap = lambda d, old, new: {new if k == old else k: v for k, v in d.items()}
    third = [swap(doc(i, weather="fog"), "scene", "setting") for i in range(6)]
    got = run(spark, {
        "s-1": [doc(i) for i in range(6)],
        "s-2": [doc(i, weather="fog") for i in range(6)] + [doc(7), None, "", '{"cut": "off', "[1]"],
        "s-3": third,
        "s-4": [d | {"people_count": str(d["people_count"])} for d in third],
        "s-5": [{k: v for k, v in d.items() if k != "caption"} | {"people_count": str(d["people_count"])} for d in third],
    }, 5)
    assert got == {("s-2", "added", "weather", ""), ("s-3", "renamed", "scene", "setting"), ("s-4", "retyped", "people_count", "string"), ("s-5", "removed", "caption", "")}


def test_type_of_an_all_null_file_is_carried(spark):
    got = run(spark, {"s-1": [{"a": 1, "b": 1}] * 3, "s-2": [{"a": None, "b": 1}] * 3, "s-3": [{"a": "x", "b": 1}] * 3}, 3)
    assert got == {("s-3", "retyped", "a", "string")}


def test_buckets_are_stitched(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET", 2)
    got = run(spark, {"s-1": [{"a": 1, "b": 1}] * 3, "s-2": [{"a": None, "b": 1}] * 3, "s-3": [{"a": None, "b": 1}] * 3, "s-5": [{"a": "x", "b": 1}] * 3}, 5)
    assert got == {("s-5", "retyped", "a", "string")}


def test_replies_are_unwrapped(spark):
    inner = json.dumps({"x": 1})
    shapes = {
        "bare": inner,
        "response": json.dumps({"candidates": [{"content": {"parts": [{"text": inner}]}}]}),
        "line": json.dumps({"key": "k", "response": {"candidates": [{"content": {"parts": [{"text": "```json\n" + inner + "\n```"}]}}]}}),
        "none": json.dumps({"candidates": []}),
        "cut": inner[:4],
        "null": None,
    }
    df = spark.createDataFrame(list(shapes.items()), "k string, raw string")
    got = {r.k: r.o for r in df.select("k", D.reply_object(df.raw).alias("o")).collect()}
    assert [json.loads(got[k]) for k in ("bare", "response", "line")] == [{"x": 1}] * 3
    assert got["none"] is None and got["cut"] is None and got["null"] is None


def test_consistent_table(spark):
    raw = json.dumps({"caption": "from the reply", "people_count": 2})
    a = spark.createDataFrame([(1, '{"title": "t", "people_count": "3", "keywords": "a, b", "is_indoor": "no"}', None, "clash"), (2, '{"cut', raw, "clash"), (3, None, None, "clash")], "analysis_id long, payload string, raw_response string, caption string")
    renames = spark.createDataFrame([("caption", "title"), ("title", "image_caption")], "field_name string, new_value string")
    names = D.aliases(renames)
    assert names == {"caption": ["image_caption", "title"]}
    out = {r.analysis_id: r for r in D.consistent(a, names).collect()}
    assert out[1].caption == "t" and out[1].people_count == 3 and out[1].keywords == ["a", "b"] and out[1].is_indoor is False
    assert out[2].caption == "from the reply" and out[2].from_doc == "reply" and out[3].caption is None


def test_every_field_of_the_profiles_is_kept(spark):
    docs = [{"caption": "c", "people_count": i, "snow_cover_pct": i * 10} for i in range(6)] + [{"caption": "c", "people_count": "two", "snow_pct": 7.5, "tags_seen": ["x"], "odd key": {"a": 1}, "Caption": "C", "analysis_id": 9}]
    a = spark.createDataFrame([(i, "f", json.dumps(d), None) for i, d in enumerate(docs)], "analysis_id int, export_file string, payload string, raw_response string")
    renames = spark.createDataFrame([("snow_cover_pct", "snow_pct")], "field_name string, new_value string")
    target, names = D.schema(D.profile(D.documents(a)), renames, a.columns)
    assert (target["snow_cover_pct"], target["people_count"], target["tags_seen"], target["latitude"]) == ("double", "bigint", "array<string>", "double") and names == {"snow_cover_pct": ["snow_pct"]}
    out = {r.analysis_id: r for r in D.consistent(a, names, target).collect()}
    assert out[2].snow_cover_pct == 20 and out[2].people_count == 2 and out[2].other_fields == {}
    assert out[6].snow_cover_pct == 7.5 and out[6].tags_seen == ["x"]
    assert out[6].other_fields == {"people_count": "two", "odd key": '{"a":1}', "Caption": "C", "analysis_id": "9"}


def test_fields_that_the_payload_lacks_come_from_the_reply(spark):
    reply = {"caption": "r", "setting": "hut", "people_count": 5, "season": "winter", "odd": 1, "extra": 2}
    a = spark.createDataFrame([(1, json.dumps({"caption": "p", "scene": None, "people_count": "many", "odd": 3}), json.dumps(reply)), (2, json.dumps({"caption": "p", "keywords": ""}), json.dumps({"caption": "r", "keywords": []})), (3, None, json.dumps(reply))], "analysis_id long, payload string, raw_response string")
    out = {r.analysis_id: r for r in D.consistent(a, {"scene": ["setting"]}).collect()}
    assert (out[1].caption, out[1].scene, out[1].people_count, out[1].season) == ("p", "hut", 5, "winter")
    assert out[1].from_doc == "both" and sorted(out[1].from_reply) == ["people_count", "scene", "season"]
    assert out[1].other_fields == {"people_count": "many", "odd": "3", "extra": "2"}
    assert out[2].keywords == [] and out[2].from_doc == "payload" and out[2].from_reply == [] and out[2].other_fields == {}
    assert out[3].from_doc == "reply" and out[3].scene == "hut" and out[3].other_fields == {"odd": "1", "extra": "2"}


def test_fields_beside_each_other_are_two(spark):
    docs = [{"camera_tilt_deg": i, "tile_count": 7 * i, "haze_level": i} for i in range(4)]
    a = spark.createDataFrame([(f"f{k}", json.dumps(d), None) for k in range(3) for d in docs], "export_file string, payload string, raw_response string")
    renames = spark.createDataFrame([("camera_tilt_deg", "tile_count"), ("haze_level", "haze")], "field_name string, new_value string")
    target, names = D.schema(D.profile(D.documents(a)), renames, [])
    assert {"camera_tilt_deg", "tile_count", "haze_level"} <= set(target) and names == {"haze_level": ["haze"]}


def test_words_of_a_list_stay_whole(spark):
    """A trim that is handed a word's place in the list would cut that digit off."""
    a = spark.createDataFrame([(1, '{"keywords": " 0a0, 1b1;2c ", "climbing_grades": "6a"}', None)], "analysis_id long, payload string, raw_response string")
    row = D.consistent(a, {}).first()
    assert row.keywords == ["0a0", "1b1", "2c"] and row.climbing_grades == ["6a"]


def test_long_chains_of_renames_are_followed(spark):
    chain = ["caption", *(f"caption_{i}" for i in range(1, 8))]
    renames = spark.createDataFrame(list(zip(chain, chain[1:])), "field_name string, new_value string")
    assert D.aliases(renames) == {"caption": chain[1:]}


def field(key, pos, kind="string", **more):
    return {"key": key, "pos": float(pos), "type": kind, "n": 10, "filled": 10, "len": 5.0, "children": None, "hashes": [hash((key, i)) for i in range(D.HASHES)]} | more


def test_the_converged_scores_decide():
    # two lost and two gained fields of equal names and contents: only the siblings tell which is which
    old = [field("a", 0), field("first", 1), field("b", 2), field("second", 3), field("c", 4)]
    new = [field("a", 0), field("xy", 1), field("b", 2), field("zw", 3), field("c", 4)]
    assert {(o, n) for o, n, _ in D.flood(old, new)} == {("first", "xy"), ("second", "zw")}
    assert D.flood(old, new, rounds=0) == []
    # moved to another place, with other contents and another name, a field is another one
    moved = [field("a", 0), field("b", 1), field("c", 2), field("zw", 3, "integer", len=1.0)]
    assert D.flood([f for f in old if f["key"] != "second"], moved) == []


def test_many_fields_renamed_at_once():
    old = [field("kept" if i == 0 else f"field_{i}", i) for i in range(120)]
    new = [f | {"key": f"Field{i}"} if i else f for i, f in enumerate(old)]
    assert {(o, n) for o, n, _ in D.flood(old, new)} == {(f"field_{i}", f"Field{i}") for i in range(1, 120)}


def test_empty(spark):
    assert run(spark, {"s-1": [None]}, 1) == set()
