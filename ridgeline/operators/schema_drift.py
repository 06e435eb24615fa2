"""Schemas that drift between files: a list of every change, one consistent table.

JSON documents are read as variants, once, and counted per file and field (keys,
types, nulls) by one aggregation with map-side combining; a second one makes a
row per file, whose fields are compared as arrays with those of the store's file
before. Where a file both loses and gains fields, its documents and those of the
file before are read again for what tells contents apart (place, length,
children, a min-hash of the values), and similarity flooding decides which of
the fields are one field under a new key: names, types, contents and nesting
give the first scores of field pairs, scores flow along the edges that both
schemas share (kept sibling before and after, next sibling, type, children)
until they converge, and the converged scores alone choose the pairs.

Windows run over buckets of ``BUCKET`` file numbers and are stitched through
one row per bucket, so that a store with a third of all files is no hot task.

Defined cases: null, empty, cut-off or otherwise unreadable documents are not
counted; a file without a readable document of a kind is passed over; a file
that no row of the file list names is passed over; nulls have no type; a tie
between types keeps the type before; repeated rows count as often as they stand.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut

BUCKET = 4096
HASHES = 8
TYPES = ["string", "integer", "number", "boolean", "array", "object"]


def strip_fence(text: Column) -> Column:
    """Without the code fence that a model may put around its reply."""
    return F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "")


def reply_object(raw: Column) -> Column:
    """JSON text of the analysis object inside a reply: a batch line, a bare response or the object itself. Null if the reply is null, unreadable or holds no candidate."""
    def inside(whole: Column) -> Column:
        text = lambda path: F.try_variant_get(whole, path, "string")
        wrapped = F.coalesce(text("$.response.candidates[0].content.parts[0].text"), text("$.candidates[0].content.parts[0].text"))
        is_wrapped = F.coalesce(text("$.response"), text("$.candidates")).isNotNull()
        return F.when(wrapped.isNotNull(), strip_fence(wrapped)).when(~is_wrapped & whole.isNotNull(), raw)

    # bound to a variable, so that the reply is parsed once
    return F.transform(F.array(F.try_parse_json(raw)), inside).getItem(0)


def documents(rows: DataFrame) -> DataFrame:
    """row columns plus doc_kind, json of each document; needs payload and raw_response."""
    kinds = F.array(F.struct(F.lit("payload").alias("doc_kind"), F.col("payload").alias("json")), F.struct(F.lit("reply").alias("doc_kind"), reply_object(F.col("raw_response")).alias("json")))
    return rows.select("*", F.explode(kinds).alias("_d")).select(*[c for c in rows.columns if c not in ("payload", "raw_response")], "_d.*").filter(F.col("json").isNotNull())


def _type_of(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", None).when(kind.isNotNull(), "number")


def _as_object(json: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")


def profile(docs: DataFrame) -> DataFrame:
    """One row per export_file, doc_kind and field: n, filled (not null) and its counts per type. The field '' counts the readable documents."""
    entry = lambda e: F.struct(e["key"].alias("key"), _type_of(e["value"]).alias("type"))
    whole = F.array(F.struct(F.lit("").alias("key"), F.lit(None).cast("string").alias("type")))
    # an unreadable document is null and so has no entries: no filter, which would be pushed below and parse twice
    d = docs.select("export_file", "doc_kind", _as_object(F.col("json")).alias("m"))
    d = d.select("export_file", "doc_kind", F.explode(F.concat(whole, F.transform(F.map_entries("m"), entry))).alias("e")).select("export_file", "doc_kind", "e.*")
    return d.groupBy("export_file", "doc_kind", "key").agg(F.count("*").alias("n"), F.count("type").alias("filled"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES])


def contents(docs: DataFrame) -> DataFrame:
    """One row per export_file, doc_kind and field: mean place in the document, mean length of the values as text, a hash of the child keys of objects and min-hashes of the values (h0, h1 and so on)."""
    # an expression inside a lambda would be evaluated per key: values and places are listed apart, each by one pass
    value = lambda e: F.struct(e["key"].alias("key"), F.lit(None).cast("int").alias("pos"), _type_of(e["value"]).alias("type"), F.lower(F.try_variant_get(e["value"], "$", "string")).alias("text"))
    at = lambda k, i: F.struct(k.alias("key"), i.alias("pos"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("text"))
    d = docs.select("export_file", "doc_kind", F.explode(F.concat(F.transform(F.map_entries(_as_object(F.col("json"))), value), F.transform(F.json_object_keys("json"), at))).alias("e")).select("export_file", "doc_kind", "e.*")
    nested = F.when(F.col("type") == "object", F.xxhash64(F.array_join(F.sort_array(F.json_object_keys(F.col("text"))), ",")))
    return d.groupBy("export_file", "doc_kind", "key").agg(
        F.avg("pos").alias("pos"),
        F.avg(F.length("text")).alias("len"),
        F.max(nested).alias("children"),
        *[F.min(F.when(F.col("type").isNotNull(), F.xxhash64(F.lit(i), "text"))).alias(f"h{i}") for i in range(HASHES)],
    )


def _majority() -> Column:
    """The type of most non-null values; null where two are as frequent or nothing is filled."""
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(t).alias("t")) for t in TYPES]), asc=False)
    first, second = ranked.getItem(0), ranked.getItem(1)
    return F.when((first["n"] > 0) & (first["n"] > second["n"]), first["t"])


def file_schemas(prof: DataFrame, files: DataFrame) -> DataFrame:
    """export_file, store_id, doc_kind, file_seq, fields: the fields (key, type, n, filled) of each file that has readable documents, in the order of their keys. A file has a field if more than half of these carry it."""
    entry = F.when(F.col("key") != "", F.struct("key", _majority().alias("type"), "n", "filled"))
    rows = prof.groupBy("export_file", "doc_kind").agg(F.max(F.when(F.col("key") == "", F.col("n"))).alias("docs"), F.array_sort(F.collect_list(entry)).alias("all"))
    rows = rows.select("export_file", "doc_kind", F.filter("all", lambda f: f["n"] * 2 > F.col("docs")).alias("fields"))
    return rows.join(files, "export_file").select("export_file", "store_id", "doc_kind", "file_seq", "fields")


def with_previous(schemas: DataFrame) -> DataFrame:
    """Adds before (export_file, fields) of the store's file before, by windows over buckets."""
    keys = ["store_id", "doc_kind"]
    own = F.struct("export_file", "fields")
    w = Window.partitionBy(*keys, "_b").orderBy("file_seq", "export_file")
    rows = schemas.withColumn("_b", F.floor(F.col("file_seq") / BUCKET)).select("*", F.lag(own).over(w).alias("_p"), F.lead("export_file").over(w).isNull().alias("_last"))
    ends = rows.filter("_last").select(*keys, "_b", F.lag(own).over(Window.partitionBy(*keys).orderBy("_b")).alias("_e"))
    return rows.join(ends, [*keys, "_b"]).withColumn("before", F.coalesce("_p", "_e")).drop("_b", "_p", "_e", "_last")


# --- similarity flooding --------------------------------------------------


def _words(key: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()) if w]


def name_similarity(a: str, b: str) -> float:
    """Of two keys: words in common, each also by its head (an abbreviation), or edit similarity."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    hit = lambda w, others: max((1.0 if w == o else 0.8 if len(w) > 2 and len(o) > 2 and (w.startswith(o) or o.startswith(w)) else 0.0) for o in others)
    shared = (sum(hit(w, y) for w in x) + sum(hit(w, x) for w in y)) / (len(x) + len(y))
    return max(shared, SequenceMatcher(None, "".join(x), "".join(y)).ratio() * 0.9)


def content_similarity(a: dict, b: dict) -> float:
    """Of two field profiles: type, shared values, nulls and length; 0.5 if one was never filled."""
    if not a["filled"] or not b["filled"]:
        return 0.5
    kin = {frozenset(("integer", "number")): 0.6, frozenset(("integer", "string")): 0.3, frozenset(("number", "string")): 0.3, frozenset(("boolean", "string")): 0.3, frozenset(("array", "string")): 0.3, frozenset(("boolean", "integer")): 0.3}
    kind = 1.0 if a["type"] == b["type"] else kin.get(frozenset((a["type"], b["type"])), 0.0)
    values = float(np.mean([x == y for x, y in zip(a["hashes"], b["hashes"])]))
    nulls = 1 - abs(a["filled"] / a["n"] - b["filled"] / b["n"])
    longer = max(a["len"] or 0, b["len"] or 0)
    length = 1.0 if longer == 0 else min(a["len"] or 0, b["len"] or 0) / longer
    return 0.5 * kind + 0.2 * min(1.0, 2 * values) + 0.15 * nulls + 0.15 * length


#: How much of a node's score flows along its edges of each label, in all.
FLOW = {"before": 0.25, "after": 0.25, "next": 0.05, "type": 0.02, "child": 0.25}


def _kept_siblings(fields: list[dict], others: dict, end: str) -> dict[str, str]:
    """The nearest sibling before each field that both schemas have; ``end`` if there is none."""
    out, last = {}, end
    for f in fields:
        out[f["key"]] = last
        if f["key"] in others:
            last = f["key"]
    return out


def flood(old: list[dict], new: list[dict], threshold: float = 0.65, rounds: int = 200, tol: float = 1e-6) -> list[tuple[str, str, float]]:
    """Fields of ``old`` that go on under another key in ``new``: (old key, new key, relative score).

    The nodes of the pairwise graph are the fields that both have under one key, the pairs of a lost and a gained field, the pairs of their types and the ends of the document. An edge of a label (kept sibling before or after, next sibling, type, children) carries a part of a node's score both ways, divided among its edges of that label; each round adds what flows in to the first scores and divides by the largest, until nothing changes. Pairs of which each is the other's best by the converged score are taken, then those of the fields that are left. A pair is a rename if its score reaches ``threshold`` of the score that a pair of one name and one content beside the same kept siblings converges to.

    Scores are kept per node and edge, not per pair of nodes: memory grows with lost times gained fields.
    """
    old, new = (sorted(side, key=lambda f: (f["pos"], f["key"])) for side in (old, new))
    in_old, in_new = {f["key"]: i for i, f in enumerate(old)}, {f["key"]: j for j, f in enumerate(new)}
    lost, gained = [k for k in in_old if k not in in_new], [k for k in in_new if k not in in_old]
    if not lost or not gained:
        return []
    kept = [k for k in in_old if k in in_new]
    nodes: dict[tuple, float] = {("^",): 1.0, ("$",): 1.0, ("child",): 1.0} | {(k, k): 1.0 for k in kept}
    for a in lost:
        for b in gained:
            content = content_similarity(old[in_old[a]], new[in_new[b]])
            # contents that contradict count for a quarter
            nodes[a, b] = (name_similarity(a, b) + content) / 2 * (1.0 if content >= 0.4 else 0.25)
    nodes |= {("type", x, y): 1.0 if x == y else 0.1 for x in {f["type"] for f in old} for y in {f["type"] for f in new}}
    sides = {"before": (_kept_siblings(old, in_new, "^"), _kept_siblings(new, in_old, "^")), "after": (_kept_siblings(old[::-1], in_new, "$"), _kept_siblings(new[::-1], in_old, "$"))}
    place = lambda k: (k,) if k in ("^", "$") else (k, k)
    edges: list[tuple[str, tuple, tuple]] = []
    for a, b in [(a, b) for a in lost for b in gained] + [(k, k) for k in kept]:
        x, y = old[in_old[a]], new[in_new[b]]
        edges.append(("type", ("type", x["type"], y["type"]), (a, b)))
        if in_old[a] + 1 < len(old) and in_new[b] + 1 < len(new) and (after := (old[in_old[a] + 1]["key"], new[in_new[b] + 1]["key"])) in nodes:
            edges.append(("next", (a, b), after))
        if a != b:
            edges += [(label, place(o[a]), (a, b)) for label, (o, n) in sides.items() if o[a] == n[b]]
            if x["children"] and x["children"] == y["children"]:
                edges.append(("child", ("child",), (a, b)))
    index = {n: i for i, n in enumerate(nodes)}
    forth, back = Counter((label, s) for label, s, _ in edges), Counter((label, t) for label, _, t in edges)
    source, target = np.array([index[s] for _, s, _ in edges]), np.array([index[t] for _, _, t in edges])
    weight = np.array([FLOW[x] / forth[x, s] for x, s, _ in edges] + [FLOW[x] / back[x, t] for x, _, t in edges])
    source, target = np.r_[source, target], np.r_[target, source]
    first = np.array(list(nodes.values()))
    score, top = first.copy(), 2.0
    for _ in range(rounds):
        mixed = first + score
        after = mixed + np.bincount(target, weight * mixed[source], len(first))
        top = after.max()
        after /= top
        settled = np.abs(after - score).max() < tol
        score = after
        if settled:
            break
    mixed = first + score
    value = {(a, b): score[index[a, b]] for a in lost for b in gained}

    def relative(a: str, b: str) -> float:
        fed = 0.0
        for label, (o, n) in sides.items():
            fed += max(FLOW[label] * mixed[index[place(k)]] / max(1, forth[label, place(k)]) for k in (o[a], n[b]))
        return float(value[a, b] * (top - 1) / (1 + fed))  # of x = (1 + x + fed) / top

    out = []
    while lost and gained:
        best_of_new = {b: min(lost, key=lambda a: (-value[a, b], a)) for b in gained}  # noqa: B023
        mutual = [(a, b) for a in lost if best_of_new[b := min(gained, key=lambda b: (-value[a, b], b))] == a]  # noqa: B023
        if not mutual:
            break
        out += [(a, b, r) for a, b in mutual if (r := relative(a, b)) >= threshold]
        lost, gained = [a for a in lost if a not in {m for m, _ in mutual}], [b for b in gained if b not in {m for _, m in mutual}]
    return out


# --- changes --------------------------------------------------------------


def _described(fields: list[dict], told: list[dict]) -> list[dict]:
    """The fields with what their contents told."""
    of = {c["key"]: c for c in told}
    return [{"key": f["key"], "type": f["type"] or "null", "n": f["n"], "filled": f["filled"]} | {c: of[f["key"]][c] for c in ("pos", "len", "children", "hashes")} for f in fields if f["key"] in of]


def changes(rows: DataFrame, files: DataFrame, threshold: float = 0.65, prof: DataFrame | None = None) -> DataFrame:
    """export_file, store_id, file_seq, doc_kind, change_kind, field_name, new_value of every change against the store's file before.

    ``rows`` has export_file, payload and raw_response; ``files`` has export_file (unique), store_id and file_seq; ``prof`` is the profile of the rows' documents if there is one already.
    """
    rows = rows.select("export_file", "payload", "raw_response")
    if prof is None:
        prof = profile(documents(rows))
    files = files.select("export_file", "store_id", "file_seq").dropDuplicates(["export_file"])
    where = ["export_file", "store_id", "file_seq", "doc_kind"]
    keys = lambda fields: F.transform(fields, lambda f: f["key"])
    seen = with_previous(file_schemas(prof, files))
    # one row per file, a fraction of the rows and read several times: its lineage is cut
    seen = cut(seen.withColumn("gained", F.array_except(keys(F.col("fields")), keys(F.col("before.fields")))).withColumn("lost", F.array_except(keys(F.col("before.fields")), keys(F.col("fields")))))

    # the last earlier type since the field was there: inside a bucket, else from the buckets before
    run = ["store_id", "doc_kind", "key"]
    typed = seen.select(*where, F.explode("fields").alias("f"), "gained").select(*where, "f.key", "f.type", F.coalesce(F.array_contains("gained", F.col("f.key")), F.lit(True)).alias("added"))
    typed = typed.withColumn("_b", F.floor(F.col("file_seq") / BUCKET))
    own = F.when(F.col("type").isNotNull(), F.struct("file_seq", "type"))
    start = F.when(F.col("added"), F.col("file_seq"))
    w = Window.partitionBy(*run, "_b").orderBy("file_seq", "export_file")
    typed = typed.select("*", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_t"), F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"), F.lead("export_file").over(w).isNull().alias("_last"))
    ends = typed.filter("_last").select(*run, "_b", F.coalesce(own, "_t").alias("_bt"), F.col("_a").alias("_ba"))
    wb = Window.partitionBy(*run).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*run, "_b", F.last("_bt", ignorenulls=True).over(wb).alias("_bt"), F.max("_ba").over(wb).alias("_ba"))
    typed = typed.join(ends, [*run, "_b"]).select(*where, "key", "type", F.coalesce("_t", "_bt").alias("_t"), F.coalesce("_a", "_ba").alias("_a"))
    retyped = typed.filter((F.col("_t.file_seq") >= F.col("_a")) & (F.col("_t.type") != F.col("type"))).select(*where, F.lit("retyped").alias("change_kind"), F.col("key").alias("field_name"), F.col("type").alias("new_value"))

    # contents only of the files that both lose and gain fields, and of the files before them
    both = seen.filter("size(gained) > 0 and size(lost) > 0").select(*where, "fields", "before")
    wanted = cut(both.select("doc_kind", F.explode(F.array("export_file", "before.export_file")).alias("export_file")).distinct())
    item = F.struct("key", "pos", "len", "children", F.array(*[f"h{i}" for i in range(HASHES)]).alias("hashes"))
    told = cut(contents(documents(rows.join(wanted.select("export_file").distinct(), "export_file", "left_semi")).join(wanted, ["export_file", "doc_kind"], "left_semi")).groupBy("export_file", "doc_kind").agg(F.collect_list(item).alias("c")))  # read for the file and for the file after it
    told_before = told.select(F.col("export_file").alias("_f"), "doc_kind", F.col("c").alias("c_old"))
    both = both.withColumn("_f", F.col("before.export_file")).join(told_before, ["_f", "doc_kind"]).join(told.withColumnRenamed("c", "c_new"), ["export_file", "doc_kind"])
    both = both.select(*where, F.col("before.fields").alias("f_old"), F.col("fields").alias("f_new"), "c_old", "c_new")
    both = both.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, wanted.count() // 500))  # schemas are few and small, comparing them is not

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *at, old, new, c_old, c_new in zip(*[b[c] for c in where], b.f_old, b.f_new, b.c_old, b.c_new):
                sides = [_described(f, c) for f, c in ((old, c_old), (new, c_new))]
                out += [(*at, o, n, v) for o, n, v in flood(*sides, threshold)]
            yield pd.DataFrame(out, columns=[*where, "old_key", "new_key", "score"])

    renamed = cut(both.mapInPandas(match, "export_file string, store_id string, file_seq int, doc_kind string, old_key string, new_key string, score double"))
    names = renamed.groupBy("export_file", "doc_kind").agg(F.collect_list("old_key").alias("_o"), F.collect_list("new_key").alias("_n"))
    none = F.array().cast("array<string>")
    rest = seen.filter("before is not null").join(names, ["export_file", "doc_kind"], "left")
    kinds = [(F.lit("added"), F.array_except("gained", F.coalesce("_n", none))), (F.lit("removed"), F.array_except("lost", F.coalesce("_o", none)))]
    each = F.explode(F.concat(*[F.transform(k, lambda x: F.struct(kind.alias("change_kind"), x.alias("field_name"), F.lit("").alias("new_value"))) for kind, k in kinds]))  # noqa: B023
    return rest.select(*where, each.alias("x")).select(*where, "x.*").unionByName(retyped).unionByName(renamed.select(*where, F.lit("renamed").alias("change_kind"), F.col("old_key").alias("field_name"), F.col("new_key").alias("new_value")))


# --- one consistent table -------------------------------------------------

_STRINGS = ["country", "country_code", "region", "mountain_range", "locality", "peak_name", "crag_name", "route_name", "location_confidence", "evidence_basis", "activity", "scene", "season", "time_of_day", "visible_text", "sharpness", "exposure", "composition", "gaze", "caption", "reasoning", "weather", "rock_type", "notes", "model", "verified_peak", "verified_country", "rejected_peak", "runner_up_peak"]
_DOUBLES = ["latitude", "longitude", "verified_lat", "verified_lon", "peak_probability", "runner_up_probability"]
_INTS = ["elevation_m", "people_count", "aesthetic_score", "eyes_closed_count", "schema_version", "peak_agreement", "peak_considered"]
_BOOLEANS = ["is_indoor", "is_guidebook_page", "is_personal_document"]
_ARRAYS = ["climbing_grades", "keywords", "place_names_visible", "landmarks", "gear_visible"]
#: Fields that the consistent schema always has, and their types where no document fills them.
TARGET = {n: t for names, t in ((_STRINGS, "string"), (_DOUBLES, "double"), (_INTS, "int"), (_BOOLEANS, "boolean"), (_ARRAYS, "array<string>")) for n in names}


#: Most columns besides those of TARGET; the values of further fields stand in other_fields.
MORE_COLUMNS = 400
#: Columns of the consistent table about its values.
_ABOUT = ("from_doc", "from_reply", "other_fields")


def _believed(renames: DataFrame, prof: DataFrame) -> DataFrame:
    """field_name, new_value, count of the renames between keys that do not stand beside each other, as two fields of a file, more often than the one was taken for the other."""
    docs = prof.filter("key = ''").select("export_file", "doc_kind", F.col("n").alias("docs"))
    has = prof.filter("key <> ''").join(docs, ["export_file", "doc_kind"]).filter("n * 2 > docs").select("export_file", "doc_kind", "key")
    pairs = cut(renames.groupBy("field_name", "new_value").count())
    beside = pairs.select("field_name", "new_value").join(has.select("export_file", "doc_kind", F.col("key").alias("field_name")), "field_name")
    beside = beside.join(has.select("export_file", "doc_kind", F.col("key").alias("new_value")), ["export_file", "doc_kind", "new_value"], "left_semi").groupBy("field_name", "new_value").agg(F.count("*").alias("beside"))
    return pairs.join(beside, ["field_name", "new_value"], "left").filter("beside is null or beside <= count").drop("beside")


def _links(counted: DataFrame, limit: int) -> dict[str, dict[str, int]]:
    """How often each key is one with each other key, either way."""
    pairs = counted.select("field_name", "new_value", "count").limit(limit + 1).collect()
    if len(pairs) > limit:
        raise ValueError(f"more than {limit} pairs of renamed keys: the renames are no schema changes")
    links: dict[str, dict[str, int]] = {}
    for a, b, n in pairs:
        links.setdefault(a, {})[b] = links.setdefault(a, {}).get(b, 0) + n
        links.setdefault(b, {})[a] = links.setdefault(b, {}).get(a, 0) + n
    return links


def _follow(links: dict[str, dict[str, int]], names: dict[str, str], rounds: int | None) -> dict[str, list[str]]:
    known = {n: n for n in names}
    for _ in itertools.count() if rounds is None else range(rounds):
        votes: dict[str, dict[str, int]] = {}
        for key, to in links.items():
            if key in known:
                continue
            for other, n in to.items():
                if other in known:
                    v = votes.setdefault(key, {})
                    v[known[other]] = v.get(known[other], 0) + n
        if not votes:
            break
        known |= {k: max(sorted(v), key=lambda f: v[f]) for k, v in votes.items()}
    out: dict[str, list[str]] = {}
    for key, field in sorted(known.items()):
        if key != field:
            out.setdefault(field, []).append(key)
    return out


def aliases(renames: DataFrame, target: dict[str, str] | None = None, rounds: int | None = None, limit: int = 20_000) -> dict[str, list[str]]:
    """Other keys under which each field of ``target`` was found, by following renames either way, through ``rounds`` renames or to the end; a key that leads to several fields goes to the one it leads to most often. One row per pair of keys is read by the driver: there are no more than pairs of field names, and more than ``limit`` is an error."""
    return _follow(_links(renames.groupBy("field_name", "new_value").count(), limit), target or TARGET, rounds)


def _kind(n: dict[str, int], default: str) -> str:
    """The column type of a field by its values per type: that of most values, numbers together and as wide as the widest, texts in a tie; objects are JSON text."""
    if not sum(n.values()):
        return default
    whole = "double" if n["number"] or default == "double" else "bigint"
    votes = {"string": n["string"], whole: n["integer"] + n["number"], "boolean": n["boolean"], "array<string>": n["array"]}
    return max(votes, key=lambda t: votes[t]) if max(votes.values()) >= n["object"] else "string"


def schema(prof: DataFrame, renames: DataFrame, reserved: list[str], rounds: int | None = None, limit: int = 20_000) -> tuple[dict[str, str], dict[str, list[str]]]:
    """The consistent schema and the other keys of its fields: those of TARGET and every other field with a value that the profile has, each with the type of most of its values under all its keys.

    Renamed keys are one field, named as TARGET does, else by its most frequent key, unless both stand beside each other in more files than the rename was found in. No column have keys that are no plain names or equal but for case a column or a name in ``reserved``, and fields beyond the ``MORE_COLUMNS`` most frequent; ``consistent`` keeps their values in other_fields. At most the ``limit`` most frequent keys are read by the driver.
    """
    links = _links(_believed(renames, prof), limit)
    other = _follow(links, TARGET, rounds)
    sums = prof.filter("key <> ''").groupBy("key").agg(F.sum("filled").alias("filled"), *[F.sum(f"n_{t}").alias(t) for t in TYPES])
    counts = {r["key"]: r.asDict() for r in sums.filter("filled > 0").orderBy(F.desc("filled"), "key").limit(limit).collect()}
    target = dict(TARGET)
    taken = {*TARGET, *(k for keys in other.values() for k in keys)}
    names = {n.lower() for n in [*TARGET, *reserved, *_ABOUT]}
    for key in counts:
        if key in taken or key.lower() in names or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", key) or len(target) >= len(TARGET) + MORE_COLUMNS:
            continue
        same, todo = {key}, [key]
        while todo:
            more = links.get(todo.pop(), {}).keys() - taken - same
            same |= more
            todo += sorted(more)
        taken |= same
        names.add(key.lower())
        target[key] = "string"
        if len(same) > 1:
            other[key] = sorted(same - {key})
    total = lambda field, t: sum(counts[k][t] for k in [field, *other.get(field, [])] if k in counts)
    return {f: _kind({t: total(f, t) for t in TYPES}, kind) for f, kind in target.items()}, other


def _cast(value: Column, kind: str) -> Column:
    got = F.try_variant_get(value, "$", kind)
    if kind != "array<string>":
        return got
    text = F.when(~F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "string"))
    return F.coalesce(got, F.when(F.trim(text) == "", F.array().cast(kind)).otherwise(F.transform(F.split(text, r"\s*[,;]\s*"), lambda x: F.trim(x))))


def _cell(document: str, keys: list[str], kind: str) -> Column:
    """value and key of the first of ``keys`` under which a document has a value of this type."""
    values = [(k, _cast(F.try_element_at(document, F.lit(k)), kind)) for k in keys]
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("key"))) for k, v in values])


def _rest(document: Column, done: Column) -> Column:
    """The entries, as text, of a document's keys that are not in ``done``; nulls are left out."""
    left = F.transform(F.array_except(F.map_keys(document), done), lambda k: F.struct(k.alias("key"), F.try_variant_get(F.try_element_at(document, k), "$", "string").alias("value")))
    return F.map_from_entries(F.filter(left, lambda e: e["value"].isNotNull()))


def consistent(rows: DataFrame, other_keys: dict[str, list[str]], target: dict[str, str] | None = None) -> DataFrame:
    """``rows`` without payload and raw_response, with one column per field of ``target``, cast to its type, ``from_doc`` (payload, reply, both, or null if neither is readable), ``from_reply`` and ``other_fields``.

    Each field is read from the payload, else from the reply, in either under its own key, else under one of ``other_keys``; ``from_doc`` is both if the payload is readable and the reply gave a value besides. ``from_reply`` lists the fields that the reply gave. A text where a list is due is split at commas, a blank one is an empty list. Values that went into no column, as theirs is of a field without a column, cannot be cast or stands beside another key of its field, are kept in ``other_fields``, as text by key, the payload's before the reply's; the reply's values of a field that is filled are not. Clashing columns of ``rows`` are replaced.
    """
    target = target or TARGET
    keep = [c for c in rows.columns if c not in target and c not in ("payload", "raw_response", *_ABOUT)]
    df = rows.select(*keep, _as_object(F.col("payload")).alias("_p"), _as_object(reply_object(F.col("raw_response"))).alias("_r"))
    keys = {f: [f, *other_keys.get(f, [])] for f in target}
    cells = [_cell(d, keys[f], kind).alias(f"{d}_{f}") for d in ("_p", "_r") for f, kind in target.items()]
    df = df.select(*keep, "_p", "_r", *cells)
    used = F.array_compact(F.array(*[F.col(f"_p_{f}.key") for f in target]))
    filled = F.flatten(F.array(*[F.when(F.col(f"_p_{f}").isNotNull() | F.col(f"_r_{f}").isNotNull(), F.array(*[F.lit(k) for k in keys[f]])).otherwise(F.array().cast("array<string>")) for f in target]))
    by_reply = F.array_compact(F.array(*[F.when(F.col(f"_p_{f}").isNull() & F.col(f"_r_{f}").isNotNull(), F.lit(f)) for f in target]))
    none = F.create_map().cast("map<string,string>")
    of_payload, of_reply = F.coalesce(_rest(F.col("_p"), used), none), F.coalesce(_rest(F.col("_r"), filled), none)
    df = df.select(*keep, "_p", "_r", *[F.coalesce(f"_p_{f}.value", f"_r_{f}.value").alias(f) for f in target], by_reply.alias("from_reply"), of_payload.alias("_op"), of_reply.alias("_or"))
    other = F.map_concat("_op", F.map_filter("_or", lambda k, v: ~F.map_contains_key("_op", k)))
    more = (F.size("from_reply") > 0) | (F.size(F.map_filter("_or", lambda k, v: ~F.map_contains_key("_op", k))) > 0)
    from_doc = F.when(F.col("_p").isNotNull() & more, "both").when(F.col("_p").isNotNull(), "payload").when(F.col("_r").isNotNull(), "reply")
    return df.select(*keep, from_doc.alias("from_doc"), "from_reply", *target, F.when(F.col("_p").isNotNull() | F.col("_r").isNotNull(), other).alias("other_fields"))
