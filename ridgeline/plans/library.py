"""Queries of the library engine over the photo tables; each takes (spark, sf_dir)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import fixed, geo, text, time
from ridgeline.operators import classify, duplicates, fusion, resolve, schema_drift, search, sessions, spatial, store
from ridgeline.session import cut, shared_folder
from ridgeline.sources.tables import spread, table
from ridgeline.streaming import live

BLACKLIST = ["private", "wanted", "road", "schnee", "corda", "pierres"]
SEARCH = "storm after"


def _photos(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The scan that counts of each path."""
    columns = columns or ("top_folder", "size_bytes", "taken_ts", "timestamp_source", "lat", "lon", "width", "height", "camera_model", "content_key", "scenic_score")
    rows = table(spark, sf_dir, "photos").select("source_path", "scanned_at", "scan_row_id", *columns)
    last = rows.groupBy("source_path").agg(F.max(F.struct("scanned_at", "scan_row_id", *columns)).alias("s"))
    return last.select("source_path", *[F.col(f"s.{c}").alias(c) for c in columns])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "photo_analysis")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(_photos(spark, sf_dir), library="top_folder", item="source_path")


# --- sources ---------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "photos").select(F.col("source_path").alias("path"), "size_bytes").unionByName(table(spark, sf_dir, "store_file").select(F.col("export_file").alias("path"), F.lit(None).cast("bigint").alias("size_bytes")))


def _reason(path):
    ext = text.extension(path)
    return F.when(text.base_name(path).startswith("."), "hidden file").when(ext == "", "no extension").when(~ext.isin(fixed.STANDARD_IMAGES + fixed.RAW_IMAGES), "not an image")


def scan_skip_reasons(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("reason", _reason(F.col("path"))).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def survey_by_ext(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(text.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def count_images(spark, sf_dir):
    return _paths(spark, sf_dir).agg(F.count_if(_reason(F.col("path")).isNull()).alias("images"))


def filename_datetime(spark, sf_dir):
    return table(spark, sf_dir, "photos").select("scan_row_id", time.filename_datetime(text.base_name(F.col("source_path"))).alias("named_ts"))


def timestamp_fallback(spark, sf_dir):
    named = time.filename_datetime(text.base_name(F.col("source_path")))
    exif = F.when(F.col("timestamp_source") == "exif", F.col("taken_ts"))
    p = table(spark, sf_dir, "photos").select("scan_row_id", "scanned_at", exif.alias("e"), named.alias("f"))
    return p.select("scan_row_id", F.coalesce("e", "f", "scanned_at").alias("ts"), F.when(F.col("e").isNotNull(), "exif").when(F.col("f").isNotNull(), "filename").when(F.col("scanned_at").isNotNull(), "mtime").otherwise("none").alias("source"))


def camera_labels(spark, sf_dir):
    make, model = store.clean_text(F.col("camera_make")), store.clean_text(F.col("camera_model"))
    label = F.when(F.lower(model).startswith(F.lower(make)) | make.isNull(), model).when(model.isNull(), make).otherwise(F.concat_ws(" ", make, model))
    return table(spark, sf_dir, "photos").groupBy(label.alias("camera")).agg(F.count("*").alias("n"))


# --- scalar functions --------------------------------------------------------


def dms_to_degrees(spark, sf_dir):
    p = table(spark, sf_dir, "photos").filter("lat is not null").select("scan_row_id", "lat")
    d, m = F.floor(F.abs("lat")).cast("double"), F.floor((F.abs("lat") - F.floor(F.abs("lat"))) * 60).cast("double")
    s = F.round((F.abs(F.col("lat")) - d - m / 60) * 3600, 3)
    return p.select("scan_row_id", F.round(geo.dms_to_degrees(d, m, s, F.when(F.col("lat") < 0, "S").otherwise("N")), 6).alias("degrees"))


def gps_text(spark, sf_dir):
    return _records(spark, sf_dir).filter(spatial.valid_position(F.col("latitude"), F.col("longitude"))).select("record_id", geo.gps_rational(F.col("latitude")).alias("lat_text"))


def season_timeofday(spark, sf_dir):
    return table(spark, sf_dir, "photos").filter("taken_ts is not null").groupBy(time.season(F.col("taken_ts")).alias("season"), time.time_of_day(F.col("taken_ts")).alias("part")).agg(F.count("*").alias("n"))


def name_normalise(spark, sf_dir):
    n = text.normalise_name(F.col("peak_name"))
    return table(spark, sf_dir, "peaks").select("peak_id", n.alias("normal"), F.array_join(text.name_tokens(n), " ").alias("words"), text.slug(F.col("peak_name")).alias("slug"), text.safe_label(F.col("peak_name")).alias("label"))


def specific_names(spark, sf_dir):
    return table(spark, sf_dir, "peaks").select("peak_id", F.coalesce(text.is_specific(F.col("peak_name")), F.lit(False)).alias("specific"))


def route_grades(spark, sf_dir):
    r = _records(spark, sf_dir).filter("route_name is not null and caption is not null")
    with_grade = F.concat_ws(" ", "route_name", F.concat(F.lit("("), F.element_at(F.concat("climbing_grades", F.array(F.lit("3275 m"))), 1), F.lit(")")))
    return r.select("record_id", text.followed_by_grade(F.col("route_name"), with_grade).alias("graded"))


def blacklist_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.blacklisted(F.col("text"), BLACKLIST).alias("word")).filter("word is not null")


def text_rank(spark, sf_dir):
    """The six pages with most words of each country."""
    r = _records(spark, sf_dir).select("record_id", "country_code", text.long_words(F.col("visible_text")).alias("words")).filter("words >= 3 and country_code is not null")
    return sessions.top_k(r, ["country_code"], 6, F.desc("words"), "record_id")


def size_labels(spark, sf_dir):
    return table(spark, sf_dir, "photos").filter("size_bytes is not null").groupBy(text.human_bytes(F.col("size_bytes")).alias("size")).agg(F.count("*").alias("n"))


def json_columns(spark, sf_dir):
    j = table(spark, sf_dir, "analysis").filter(F.try_parse_json("payload").isNotNull())
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return j.select("analysis_id", get("rock_type").alias("rock"), get("crag_name").alias("crag"), get("locality").alias("locality"), get("evidence_basis").alias("basis"))


def enum_coercion(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.groupBy(store.enum(F.col("activity"), fixed.ACTIVITIES, "unknown").alias("activity"), store.enum(F.col("evidence_basis"), fixed.EVIDENCE_BASIS, "none", fixed.EVIDENCE_ALIASES).alias("basis"), store.enum(F.col("location_confidence"), fixed.CONFIDENCE, "low").alias("confidence")).agg(F.count("*").alias("n"))


def versioned_reparse(spark, sf_dir):
    """Country of the record: of the payload if its version is current, else of the reply."""
    a = table(spark, sf_dir, "analysis").select("analysis_id", "schema_version", "payload", "raw_response")
    read = lambda c: F.try_variant_get(F.try_parse_json(c), "$.country_code", "string")
    return a.select("analysis_id", F.when(F.col("schema_version") == fixed.SCHEMA_VERSION, read(F.col("payload"))).otherwise(read(schema_drift.reply_object(F.col("raw_response")))).alias("country_code"))


def keywords_builder(spark, sf_dir):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    peak = F.coalesce(F.when(F.col("verified_peak") != "", F.col("verified_peak")), F.col("peak_name"))
    order = [*map(one, ("activity", "scene", "season", "time_of_day", "mountain_range")), F.when(peak.isNotNull(), F.array(peak)), *map(one, ("crag_name", "route_name", "region", "country", "rock_type", "weather")), F.col("climbing_grades"), F.col("keywords")]
    order += [F.when(F.col("is_guidebook_page"), F.array(F.lit("guidebook"))), F.when(F.col("is_personal_document"), F.array(F.lit("personal-document")))]
    return _records(spark, sf_dir).select("record_id", F.array_join(store.keywords(order), ";").alias("tags"))


def safe_text(spark, sf_dir):
    r = _records(spark, sf_dir)
    joined = F.array_join(F.filter(F.concat(F.coalesce("place_names_visible", F.array().cast("array<string>")), F.array("visible_text")), lambda x: x.isNotNull()), "\n")
    return r.select("record_id", F.when(~F.coalesce("is_personal_document", F.lit(False)) & (joined != ""), joined).alias("shown"))


# --- filters, joins, facets, search -------------------------------------------


def filter_set(spark, sf_dir):
    r = search.public(_records(spark, sf_dir)).filter(search.matching({"activity": "hiking", "min_score": 3, "scene": "any", "no_such": "x"}))
    return r.select("record_id", "activity", "aesthetic_score")


def grade_semi_join(spark, sf_dir):
    r = search.public(_records(spark, sf_dir))
    return search.with_grade(r, search.grade_bridge(r), "6b").select("record_id")


def pending_keys(spark, sf_dir):
    return store.missing(table(spark, sf_dir, "photos").select("content_key"), _records(spark, sf_dir).select(F.col("content_hash").alias("content_key")).distinct(), "content_key")


def multi_get(spark, sf_dir):
    """Records of the photos that stand in duplicate groups."""
    paths = table(spark, sf_dir, "dup_group").select(F.explode("photos").alias("source_path")).filter("source_path is not null").distinct()
    keys = table(spark, sf_dir, "photos").join(paths, "source_path", "left_semi").select(F.col("content_key").alias("content_hash")).distinct()
    return _records(spark, sf_dir).join(keys, "content_hash", "left_semi").select("record_id", "content_hash")


def facets(spark, sf_dir):
    return search.facets(search.public(_records(spark, sf_dir)))


def store_stats(spark, sf_dir):
    r = _records(spark, sf_dir)
    open_ = ~F.coalesce("is_personal_document", F.lit(False))
    return r.agg(F.count("*").alias("photos"), F.count_distinct(F.when(open_, F.col("verified_peak"))).alias("peaks"), F.count_distinct(F.when(open_, F.col("mountain_range"))).alias("ranges"), F.count_if(~open_).alias("personal"), F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("models"))


def side_counts(spark, sf_dir):
    return table(spark, sf_dir, "ocr_text").agg(F.count("*").alias("n")).select(F.lit("ocr_text").alias("kind"), "n").unionByName(table(spark, sf_dir, "clip_embedding").agg(F.count("vector").alias("n")).select(F.lit("clip_embedding").alias("kind"), "n"))


def search_list_page(spark, sf_dir):
    rows = _photos(spark, sf_dir, "taken_ts").select("source_path", "taken_ts")
    return rows.orderBy(F.col("taken_ts").desc_nulls_last(), "source_path").offset(100).limit(200)


def _bodies(spark, sf_dir):
    return search.body(search.public(_records(spark, sf_dir)))


def _scored(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    sizes = bodies.select(F.size(search.tokens(F.col("body"))).alias("n")).filter("n > 0").agg(F.count("*"), F.avg("n")).first()
    terms = [w for t in search.query_terms(SEARCH) for w in t]
    return search.bm25(search.postings(bodies), terms, sizes[0], sizes[1] or 1.0)


def search_bm25(spark, sf_dir):
    return _scored(spark, sf_dir).select("record_id", F.round("score", 6).alias("score"))


def search_phrase(spark, sf_dir):
    return search.phrase(search.postings(_bodies(spark, sf_dir)), ["after", "the", "storm"])


def search_with_grades(spark, sf_dir):
    page = _scored(spark, sf_dir).select("record_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "record_id").limit(50)
    grades = search.grade_bridge(_records(spark, sf_dir)).groupBy("record_id").agg(F.array_join(F.sort_array(F.collect_list("grade")), ",").alias("grades"))
    return page.join(grades, "record_id", "left")


# --- sessions ------------------------------------------------------------------


def session_items(spark, sf_dir):
    return _sessions(spark, sf_dir).select("source_path", F.col("session_no").cast("bigint").alias("session_no"), F.col("split_reason").alias("reason"))


def session_summary(spark, sf_dir):
    return sessions.summaries(_sessions(spark, sf_dir), library="top_folder", item="source_path").select("top_folder", F.col("session_no").cast("bigint").alias("session_no"), "start_ts", "end_ts", "items", "no_position", "no_exif_time", "bytes", "cameras")


def small_sessions(spark, sf_dir):
    s = sessions.summaries(_sessions(spark, sf_dir), library="top_folder", item="source_path")
    return s.select("top_folder", F.col("session_no").cast("bigint").alias("session_no"), F.concat_ws("; ", F.when(F.col("items") < 3, "fewer than 3 photos"), F.when(F.col("start_ts").isNull(), "no timestamps")).alias("notes"), time.date_range(F.col("start_ts"), F.col("end_ts")).alias("dates")).filter("notes <> ''")


def trip_merge(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    keyed = s.join(_records(spark, sf_dir).select(F.col("content_hash").alias("content_key"), "record_id", "verified_peak", "mountain_range", "evidence_basis"), "content_key", "left")
    place = sessions.plurality(keyed, ["top_folder", "session_no"], "verified_peak", "record_id").select("top_folder", "session_no", F.col("verified_peak").alias("place"))
    area = sessions.plurality(keyed, ["top_folder", "session_no"], "mountain_range", "record_id").drop("votes")
    read = keyed.groupBy("top_folder", "session_no").agg(F.coalesce(F.max(F.col("evidence_basis") == "sign_in_scene"), F.lit(False)).alias("read_name"), F.min("taken_ts").alias("start_ts"), F.max("taken_ts").alias("end_ts"))
    rows = read.join(place, ["top_folder", "session_no"], "left").join(area, ["top_folder", "session_no"], "left")
    return sessions.merge_trips(rows, library="top_folder")


def topk_scenic(spark, sf_dir):
    rows = _sessions(spark, sf_dir)
    return sessions.top_k(rows, ["top_folder", "session_no"], 4, F.col("scenic_score").desc_nulls_last(), F.col("taken_ts").asc_nulls_first(), "source_path").select("source_path", "rank")


def even_sampling(spark, sf_dir):
    rows = _photos(spark, sf_dir, "top_folder", "taken_ts")
    return sessions.even_sample(rows, "top_folder", 5, "taken_ts", "source_path").select("source_path")


def plurality_vote(spark, sf_dir):
    r = _records(spark, sf_dir).filter("activity not in ('unknown', 'none')")
    return sessions.plurality(r, ["country_code"], "activity", "record_id").filter("country_code is not null")


def activity_quorum(spark, sf_dir):
    """Activities of a range with votes of at least three and a fifth of its records."""
    r = _records(spark, sf_dir).filter("mountain_range is not null")
    n = r.groupBy("mountain_range").agg(F.count("*").alias("n"))
    votes = sessions.plurality(r.filter("activity not in ('unknown', 'none')"), ["mountain_range"], "activity", "record_id")
    return votes.join(n, "mountain_range").filter(F.col("votes") >= F.greatest(F.lit(3.0), 0.2 * F.col("n"))).select("mountain_range", "activity", "votes")


def name_collisions(spark, sf_dir):
    p = table(spark, sf_dir, "peaks").withColumn("label", text.safe_label(F.col("peak_name"), 8)).filter("label <> ''")
    return p.select("peak_id", store.unique_names(p, ["country"], "label", "peak_id").alias("folder"))


def dest_collisions(spark, sf_dir):
    p = _photos(spark, sf_dir, "top_folder").withColumn("file", text.base_name(F.col("source_path")))
    return p.select("source_path", store.unique_names(p, ["top_folder"], "file", "source_path").alias("dest_name"))


def chunk_packing(spark, sf_dir):
    return sessions.chunks(_photos(spark, sf_dir, "top_folder", "size_bytes"), partition="top_folder", order="source_path", size="size_bytes", max_bytes=200 * 1024 * 1024, max_rows=50).select("source_path", "chunk_no")


def merge_into_previous(spark, sf_dir):
    s = sessions.summaries(_sessions(spark, sf_dir), library="top_folder", item="source_path").select("top_folder", F.col("session_no").cast("bigint").alias("session_no"), (F.col("items") < 3).alias("small"))
    return sessions.merge_flags(s, ["top_folder"], "session_no", "small").select("top_folder", "session_no", "surviving")


def folder_names(spark, sf_dir):
    """Country, region or range, place and activity of the folder that a record alone would have; event_folders adds the date."""
    r = _records(spark, sf_dir)
    vague = F.lower(text.slug(F.col("mountain_range"))).isin(fixed.VAGUE_REGIONS)
    area = F.coalesce(F.col("region"), F.when(~vague, F.col("mountain_range")))
    parts = F.concat_ws("_", *[F.when(text.slug(c) != "", text.slug(c)) for c in (F.col("country_code"), area, F.col("verified_peak"))])
    activity = text.slug(F.when(~F.col("activity").isin("unknown", "none"), F.col("activity")))
    name = F.when((activity != "") & ~F.contains(F.lower(parts), F.lower(activity)), F.concat_ws("_", F.when(parts != "", parts), activity)).otherwise(parts)
    return r.select("record_id", F.substring(name, 1, 60).alias("folder"))


# --- duplicates ------------------------------------------------------------------


def exact_dups(spark, sf_dir):
    return duplicates.exact_roles(_photos(spark, sf_dir))


def _hashes(spark, sf_dir):
    """The signs of the first 64 numbers of every photo's latest vector stand for its perceptual hash; the time is the first that a scan gives it."""
    v = table(spark, sf_dir, "clip_embedding").filter("content_hash is not null and size(vector) >= 64").groupBy("content_hash").agg(F.max(F.struct("made_at", "vector")).alias("r"))
    taken = table(spark, sf_dir, "photos").groupBy(F.col("content_key").alias("content_hash")).agg(F.min("taken_ts").alias("ts"))
    return v.select("content_hash", duplicates.sign_bits(F.col("r.vector")).alias("h")).join(taken, "content_hash", "left").select(F.col("content_hash").alias("item"), "h", "ts")


def near_dup_pairs(spark, sf_dir):
    """Pairs of classes of near duplicates; near_dup_classes has their members."""
    return duplicates.near_pairs(_hashes(spark, sf_dir), item="item", phash="h", ts="ts")


def near_dup_classes(spark, sf_dir):
    return duplicates.near_members(_hashes(spark, sf_dir), item="item", phash="h", ts="ts")


def near_dup_groups(spark, sf_dir):
    return duplicates.near_groups(_hashes(spark, sf_dir), item="item", phash="h", ts="ts")


def keeper_election(spark, sf_dir):
    """The best judged frame of each duplicate group."""
    g = table(spark, sf_dir, "dup_group").select("group_id", F.explode(F.array_distinct("photos")).alias("source_path")).distinct()
    p = _photos(spark, sf_dir, "content_key")
    r = _records(spark, sf_dir).groupBy(F.col("content_hash").alias("content_key")).agg(F.min_by(F.struct("sharpness", "gaze", "eyes_closed_count", "composition", "aesthetic_score", "exposure"), "record_id").alias("a"))
    members = g.join(p, "source_path").join(r, "content_key").select("group_id", "source_path", "a.*", F.lit(True).alias("judged"))
    return duplicates.elect(members, "group_id", "source_path").select("group_id", "source_path", "n_judged")


def _group_members(spark, sf_dir):
    """group_id, kind, source_path of the latest row of each group, each member once."""
    g = table(spark, sf_dir, "dup_group").filter("group_id is not null").groupBy("group_id").agg(F.max(F.struct("found_at", "kind", "photos")).alias("g"))
    return g.select("group_id", "g.kind", F.explode(F.array_distinct("g.photos")).alias("source_path")).filter("source_path is not null")


def keeper_reelection(spark, sf_dir):
    """The keeper of every group by the best evidence there is; the scenic score stands for a measure of sharpness."""
    r = _records(spark, sf_dir).groupBy(F.col("content_hash").alias("content_key")).agg(F.min_by(F.struct("sharpness", "gaze", "eyes_closed_count", "composition", "aesthetic_score", "exposure"), "record_id").alias("a"))
    members = _group_members(spark, sf_dir).join(_photos(spark, sf_dir), "source_path").join(r, "content_key", "left")
    members = members.select("group_id", "source_path", "width", "height", "size_bytes", "timestamp_source", "lat", "lon", "scenic_score", "a.*", F.col("a").isNotNull().alias("judged"))
    return duplicates.reelect(members, "group_id", "source_path", measure="scenic_score").withColumn("changed", F.col("before") != F.col("keeper"))


def _near_roles(spark, sf_dir):
    """source_path, keeper of the members of near groups but the keeper by metadata; of several groups the first."""
    members = _group_members(spark, sf_dir).filter("kind = 'near'")
    best = members.join(_photos(spark, sf_dir), "source_path").groupBy("group_id").agg(F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(duplicates.metadata_keys("source_path"))]))["k4"].alias("keeper"))
    return members.join(best, "group_id").filter("source_path <> keeper").groupBy("source_path").agg(F.min_by("keeper", "group_id").alias("keeper"))


def _routes(spark, sf_dir):
    """source_path, size_bytes, route (rejected, duplicate or normal), folder, name of the copy of each photo."""
    p = sessions.sessions(_photos(spark, sf_dir, "top_folder", "content_key", "reject_reason", "size_bytes", "timestamp_source", "lat", "lon", "width", "height", "taken_ts"), library="top_folder", item="source_path")
    start = p.groupBy("top_folder", "session_no").agg(F.min("taken_ts").alias("_start"))
    named = F.concat(F.coalesce(F.date_format("_start", "yyyy"), F.lit("0000")), F.lit("/"), text.safe_label(F.col("top_folder")), F.lit("_Event"), F.lpad(F.col("session_no").cast("string"), F.greatest(F.lit(3), F.length(F.col("session_no").cast("string"))), F.lit("0")))
    p = cut(p.join(start, ["top_folder", "session_no"]).withColumn("event", named))
    exact = duplicates.exact_roles(p).filter("role = 'exact'").select("source_path", F.col("duplicate_of").alias("_exact"))
    near = _near_roles(spark, sf_dir).select("source_path", F.col("keeper").alias("_near"))
    p = p.join(exact, "source_path", "left").join(near, "source_path", "left").withColumn("keeper", F.coalesce("_exact", "_near"))
    p = p.join(p.select(F.col("source_path").alias("keeper"), F.col("event").alias("keeper_event")), "keeper", "left")
    name = text.base_name(F.col("source_path"))
    twin = F.concat(text.stem(F.col("source_path")), F.lit("_duplicate"), F.regexp_extract(name, "(?<=.)(\\.[^.]*)$", 1))
    route = F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("keeper").isNotNull(), "duplicate").otherwise("normal")
    folder = F.when(F.col("route") == "rejected", F.concat(F.lit("rejected/"), "reject_reason")).when(F.col("route") == "duplicate", F.coalesce("keeper_event", "event")).otherwise(F.col("event"))
    p = p.withColumn("route", route).select("source_path", "size_bytes", "route", folder.alias("folder"), F.when(F.col("route") == "duplicate", twin).otherwise(name).alias("name"))
    return store.with_free_names(p, ["folder"], "name", "dest_name", F.col("route") == "duplicate", "source_path")


def copy_routes(spark, sf_dir):
    """Where the copy of each photo goes: rejected ones aside, duplicates beside their keeper, no two to one place."""
    return _routes(spark, sf_dir).select("source_path", F.concat_ws("/", "folder", "dest_name").alias("dest"))


def copy_counters(spark, sf_dir):
    """Photos and bytes of each route of the copy."""
    return _routes(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


# --- names and places ---------------------------------------------------------------


def alias_exact_join(spark, sf_dir):
    known = resolve.spellings(table(spark, sf_dir, "peaks"))
    names = _records(spark, sf_dir).select(F.col("peak_name").alias("name")).filter("name is not null")
    return resolve.exact_matches(names, known)


def fuzzy_resolve(spark, sf_dir):
    """Peak names with their third letter lost."""
    known = resolve.spellings(table(spark, sf_dir, "peaks"))
    names = _records(spark, sf_dir).filter("peak_name is not null").select(F.concat(F.substring("peak_name", 1, 2), F.expr("substring(peak_name, 4)")).alias("name"))
    return resolve.fuzzy_matches(names, known).select("name", "peak_id", F.round("score", 9).alias("score"), "rank")


def ngram_in_text(spark, sf_dir):
    known = resolve.spellings(table(spark, sf_dir, "peaks"))
    return resolve.names_in_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), known, key="doc_id", text="text").select("doc_id", "normal", "n_words", "position", "rank")


def spatial_near(spark, sf_dir):
    r = _records(spark, sf_dir).filter(spatial.valid_position(F.col("latitude"), F.col("longitude"))).select("record_id", "latitude", "longitude")
    return resolve.highest_near(r, table(spark, sf_dir, "peaks"), point=("record_id", "latitude", "longitude"))


def nearest_place(spark, sf_dir):
    p = table(spark, sf_dir, "photos").select("scan_row_id", "lat", "lon")
    return resolve.nearest(p, table(spark, sf_dir, "peaks"), point=("scan_row_id", "lat", "lon"), place=("peak_id", "lat", "lon"), max_km=10.0).select("scan_row_id", "peak_id", F.round("distance_km", 6).alias("distance_km"))


def bounds_filter(spark, sf_dir):
    low, high, west, east = fixed.GAZETTEER_BOUNDS
    inside = F.coalesce(F.col("lat").between(low, high) & F.col("lon").between(west, east), F.lit(True))
    return table(spark, sf_dir, "peaks").groupBy("country").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


def centroid_bbox(spark, sf_dir):
    lat, lon = geo.centroid(F.col("lat"), F.col("lon"))
    p = table(spark, sf_dir, "photos").filter("lat is not null and lon is not null")
    return p.groupBy("top_folder").agg(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(geo.bbox_km(F.col("lat"), F.col("lon")), 4).alias("span_km"))


# --- evidence ---------------------------------------------------------------------


def _claims(spark, sf_dir):
    return _records(spark, sf_dir).filter("mountain_range is not null").select("record_id", F.col("mountain_range").alias("session"), F.col("verified_peak").alias("peak"), F.col("evidence_basis").alias("basis"), F.col("location_confidence").alias("confidence"), F.col("verified_lat").alias("lat"), F.col("verified_lon").alias("lon"), "latitude", "longitude")


def noisy_or(spark, sf_dir):
    return fusion.ranked_peaks(_claims(spark, sf_dir), "session").select("session", "peak", F.round("probability", 6).alias("probability"), "n_claims")


def contradiction_filter(spark, sf_dir):
    c = _claims(spark, sf_dir)
    anchors = c.filter("basis in ('sign_in_scene', 'printed_page') and peak is not null and lat is not null and lon is not null").select("session", F.col("peak").alias("name"), "lat", "lon").distinct()
    return fusion.contradicted(c, anchors, "session", "record_id").select("record_id", F.round("nearest_km", 6).alias("nearest_km"))


def consensus_location(spark, sf_dir):
    c = _claims(spark, sf_dir).select("session", "record_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return fusion.consensus(c, "session", "record_id").select("session", "lat", "lon", "agreeing", "considered")


# --- embeddings ----------------------------------------------------------------------


def _prompts(spark, sf_dir, n):
    """Stand-ins for prompt vectors: the first ``n`` rows of the embeddings table."""
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(n).collect()
    return np.array([r.embedding for r in rows], dtype=float)


def embed_tags(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return classify.tagged(items, _prompts(spark, sf_dir, classify.n_prompts()), key="vec_id", vector="embedding").select("vec_id", F.array_join("tags", ",").alias("tags"))


def page_score(spark, sf_dir):
    p = _prompts(spark, sf_dir, 5).tolist()
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(classify.first_share(F.col("embedding"), p, 2, fixed.PAGE_SCALE), 6).alias("score"))


# --- store, sinks, streams -------------------------------------------------------------


def upsert_latest(spark, sf_dir):
    """The store after the rows of each key arrived in order: latest values, first size, reply never lost."""
    a = table(spark, sf_dir, "analysis").select("content_hash", "analysis_id", "size_bytes", "model", F.length("raw_response").alias("reply_chars")).filter("content_hash is not null")
    return store.merge_latest(a.filter("analysis_id % 2 = 0"), a.filter("analysis_id % 2 = 1"), "content_hash", "analysis_id", keep_first=["size_bytes"], keep_known=["reply_chars"])


def pocket_shots(spark, sf_dir):
    return _records(spark, sf_dir).filter(store.pocket_shot()).select("record_id")


def pocket_evidence(spark, sf_dir):
    """How many signs of a frame taken by accident each record has."""
    signs = [s.cast("int") for s in store.pocket_signs()]
    return _records(spark, sf_dir).select("record_id", sum(signs[1:], signs[0]).alias("signs"))


def rating_fields(spark, sf_dir):
    r = _records(spark, sf_dir).filter("aesthetic_score is not null")
    return r.select("record_id", store.rating(F.col("aesthetic_score")).alias("rating"), F.when(F.col("sharpness") == "sharp", "keep").when(F.col("sharpness") == "blurry", "check").alias("label"))


def manifest_json(spark, sf_dir):
    s = sessions.summaries(_sessions(spark, sf_dir), library="top_folder", item="source_path")
    return s.select("top_folder", F.to_json(F.struct("session_no", "start_ts", "end_ts", "items", "cameras")).alias("json"))


def verified_sink(spark, sf_dir):
    rows = table(spark, sf_dir, "photos").select("scan_row_id", "source_path", "size_bytes", F.coalesce(F.year("taken_ts"), F.lit(0)).alias("year"))
    return store.verified_write(rows, shared_folder(spark, "sink"), partition=["year"])


def stream_sessions(spark, sf_dir):
    events = live.stream_table(spark, sf_dir, "events.parquet")
    out = live.session_counts(events, key="user_id", ts="ts", gap="12 hours", late="365 days")
    return live.run_once(out, shared_folder(spark, "sessions")).select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n")


def preflight(spark, sf_dir):
    """Checks of the tables: name, whether it holds, the number of rows that break it."""
    p = table(spark, sf_dir, "photos").agg(F.count_if(F.col("source_path").isNull()).cast("bigint").alias("a"), F.count_if(F.col("size_bytes") < 0).alias("b"), F.count_if(F.abs("lat") > 90).alias("c"), (F.count("*") - F.count_distinct("scan_row_id")).alias("d"))
    names = ["paths are there", "sizes are not negative", "latitudes are possible", "row ids are unique"]
    return p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("broken")) for n, c in zip(names, "abcd")])).alias("x")).select("x.name", (F.col("x.broken") == 0).alias("ok"), "x.broken")


QUERIES = {f.__name__: f for f in (
    scan_skip_reasons, survey_by_ext, count_images, filename_datetime, timestamp_fallback, camera_labels, dms_to_degrees, gps_text, season_timeofday, name_normalise, specific_names, route_grades, blacklist_words, text_rank, size_labels,
    json_columns, enum_coercion, versioned_reparse, keywords_builder, safe_text, filter_set, grade_semi_join, pending_keys, multi_get, facets, store_stats, side_counts, search_list_page, search_bm25, search_phrase, search_with_grades,
    session_items, session_summary, small_sessions, trip_merge, topk_scenic, even_sampling, plurality_vote, activity_quorum, name_collisions, dest_collisions, chunk_packing, merge_into_previous, folder_names,
    exact_dups, near_dup_pairs, near_dup_classes, near_dup_groups, keeper_election, keeper_reelection, copy_routes, copy_counters, alias_exact_join, fuzzy_resolve, ngram_in_text, spatial_near, nearest_place, bounds_filter, centroid_bbox,
    noisy_or, contradiction_filter, consensus_location, embed_tags, page_score, upsert_latest, pocket_shots, pocket_evidence, rating_fields, manifest_json, verified_sink, stream_sessions, preflight,
)}

from ridgeline.plans.library_sql import SQL  # noqa: E402, F401
