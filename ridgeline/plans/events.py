"""Queries of events, side tables and the stored index; each takes (spark, sf_dir)
and runs over its whole tables. Their SQL is in events_sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import fixed, geo, pixels, text, time
from ridgeline.operators import classify, duplicates, events, index, resolve, schema_drift, search, sessions, spatial, store
from ridgeline.plans import library
from ridgeline.session import cut, shared_folder
from ridgeline.sources import files
from ridgeline.sources.tables import spread, table
from ridgeline.streaming import live

KEYS = ["top_folder", "session_no"]
COUNTRIES = ["CH", "FR", "NO"]
FILTERED = {"activity": "hiking"}
GRADE = "6b"


def _first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each photo, the first."""
    r = library._records(spark, sf_dir)
    return r.groupBy(F.col("content_hash").alias("content_key")).agg(F.min("record_id").alias("record_id")).join(r, "record_id").drop("content_hash")


def _event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the session of their photo."""
    s = library._sessions(spark, sf_dir).select(*KEYS, "source_path", "content_key", "taken_ts")
    s = s.withColumn("session_no", F.col("session_no").cast("bigint"))
    return s.join(_first_records(spark, sf_dir), "content_key")


def _summaries(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    return events.summaries(_event_records(spark, sf_dir) if records is None else records, KEYS, "source_path")


# --- events ------------------------------------------------------------------


def event_summary(spark, sf_dir):
    """What the records of each session say together."""
    s = _summaries(spark, sf_dir)
    return s.select(*KEYS, "considered", "verified_peak", "rejected_peak", "evidence_basis", F.round("probability", 6).alias("probability"), "agreement", "runner_up", F.round("runner_up_probability", 6).alias("runner_up_probability"), *events.VOTED, F.array_join("keywords", ";").alias("keywords"))


def event_locations(spark, sf_dir):
    records = cut(_event_records(spark, sf_dir))
    return events.locations(records, _summaries(spark, sf_dir, records), KEYS, "source_path").select(*KEYS, "lat", "lon", "source")


def event_folders(spark, sf_dir):
    """Year and folder of every session with records."""
    records = cut(_event_records(spark, sf_dir))
    start = records.groupBy(*KEYS).agg(F.min("taken_ts").alias("start_ts"))
    return events.event_folders(_summaries(spark, sf_dir, records).join(start, KEYS), "top_folder", "session_no").select(*KEYS, "year", "folder")


def region_fill(spark, sf_dir):
    """Region and country of each event by the first area around its position, which also clears the range that was claimed."""
    records = cut(_event_records(spark, sf_dir))
    summary = _summaries(spark, sf_dir, records)
    places = cut(events.locations(records, summary, KEYS, "source_path").withColumn("event_id", F.xxhash64(*KEYS)))
    areas = table(spark, sf_dir, "areas")
    around = spatial.containing(places, areas, point=("event_id", "lat", "lon")).groupBy("event_id").agg(F.min("area_id").alias("area_id"))
    named = areas.groupBy("area_id").agg(F.min("area_name").alias("area_name"), F.min("country").alias("area_country"))
    hit = places.join(around, "event_id").join(named, "area_id").select(*KEYS, "area_name", "area_country")
    df = summary.join(hit, KEYS, "left")
    return df.select(*KEYS, F.coalesce("area_name", "region").alias("region"), F.coalesce("area_country", "country_code").alias("country_code"), F.when(F.col("area_name").isNull(), F.col("mountain_range")).alias("mountain_range"))


def event_times(spark, sf_dir):
    """Start as ISO text, span in days, year and the day and month of a folder's name."""
    s = sessions.summaries(library._sessions(spark, sf_dir), library="top_folder", item="source_path").filter("start_ts is not null")
    return s.select("top_folder", F.col("session_no").cast("bigint").alias("session_no"), time.iso_text(F.col("start_ts")).alias("start_text"), F.round(time.span_days(F.col("start_ts"), F.col("end_ts")), 6).alias("span_days"), F.date_format("start_ts", "yyyy").alias("year"), F.date_format("start_ts", "dd_MM").alias("day_month"))


def plan_rollup(spark, sf_dir):
    """One row about all sessions: how many, their photos, bytes, undated ones, those without position."""
    s = sessions.summaries(library._sessions(spark, sf_dir), library="top_folder", item="source_path")
    return s.agg(F.count("*").alias("sessions"), F.sum("items").alias("photos"), F.sum("bytes").alias("bytes"), F.count_if(F.col("start_ts").isNull()).alias("undated"), F.sum("no_position").alias("no_position"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def edited_events(spark, sf_dir):
    """Sessions after edits: every third is renamed, every fifth merged into the one before; the edits travel as lines of text and are read back."""
    s = sessions.summaries(library._sessions(spark, sf_dir), library="top_folder", item="source_path").select("top_folder", F.col("session_no").cast("bigint").alias("session_no"), "items")
    n = F.col("session_no")
    name = F.when(n % 3 == 0, F.concat(F.lit('Tour "'), n.cast("string"), F.lit('" *?'))).when(n % 7 == 0, F.lit("***"))
    lines = s.select("top_folder", store.edit_line(n, name, n % 5 == 0).alias("line"))
    edits = store.read_edits(lines, "top_folder", "line").withColumnRenamed("index", "session_no")
    both = s.join(edits, KEYS, "left").withColumn("merge", F.coalesce("merge", F.lit(False)))
    merged = sessions.merge_flags(both, ["top_folder"], "session_no", "merge")
    names = merged.groupBy("top_folder", "surviving").agg(F.max(F.when(n == F.col("surviving"), F.col("name"))).alias("name"), F.sum("items").alias("items"), F.count("*").alias("n_events"))
    return names.withColumnRenamed("surviving", "session_no")


def verified_claims(spark, sf_dir):
    """The claimed summit of each record against the gazetteer: the best match, or the name rejected."""
    names = library._records(spark, sf_dir).filter("peak_name <> ''").select("record_id", F.col("peak_name").alias("name"))
    best = resolve.fuzzy_matches(names.select("name"), resolve.spellings(table(spark, sf_dir, "peaks")), limit=1).select("name", "peak_id")
    return names.join(best, "name", "left").select("record_id", "peak_id", F.when(F.col("peak_id").isNull(), F.col("name")).alias("rejected_peak"))


def promoted_claims(spark, sf_dir):
    """Summits that stand in the text of records which verified none."""
    r = library._records(spark, sf_dir)
    known = resolve.spellings(table(spark, sf_dir, "peaks"))
    shown = library.safe_text(spark, sf_dir).filter("shown is not null")
    hits = resolve.names_in_text(spread(shown), known, key="record_id", text="shown")
    return events.promoted(r, hits, known, "record_id")


def text_anchors(spark, sf_dir):
    """Gazetteer names that stand in the records of a session, each once."""
    known = resolve.spellings(table(spark, sf_dir, "peaks"))
    shown = library.safe_text(spark, sf_dir).filter("shown is not null")
    hits = resolve.names_in_text(spread(shown), known, key="record_id", text="shown").select("record_id", "normal")
    return _event_records(spark, sf_dir).select(*KEYS, "record_id").join(hits, "record_id").select(*KEYS, "normal").distinct()


def ocr_named(spark, sf_dir):
    """For sessions without a verified summit, the most specific gazetteer name on the six pages with most words."""
    records = cut(_event_records(spark, sf_dir).select(*KEYS, "record_id", "verified_peak", "visible_text"))
    unnamed = records.groupBy(*KEYS).agg(F.max(F.col("verified_peak") != "").alias("named")).filter("not coalesce(named, false)").select(*KEYS)
    pages = records.join(unnamed, KEYS).withColumn("words", text.long_words(F.col("visible_text"))).filter("words >= 3")
    pages = sessions.top_k(pages, KEYS, 6, F.desc("words"), "record_id").select(*KEYS, "record_id", "visible_text")
    hits = resolve.names_in_text(pages, resolve.spellings(table(spark, sf_dir, "peaks")), key="record_id", text="visible_text").select("record_id", "normal")
    size = F.struct((-F.size(F.split("normal", " "))).alias("w"), (-F.length("normal")).alias("l"), "normal")
    return pages.select(*KEYS, "record_id").join(hits, "record_id").groupBy(*KEYS).agg(F.min(size)["normal"].alias("name"))


# --- predicates, rollups -------------------------------------------------------


def unique_photos(spark, sf_dir):
    p = library._photos(spark, sf_dir, "duplicate_role")
    return p.filter(F.col("duplicate_role").isNull() | (F.col("duplicate_role") == "keep")).select("source_path")


def dedupe_stats(spark, sf_dir):
    """Groups, members and bytes of all but the keeper, per kind of group."""
    members = library._group_members(spark, sf_dir).join(library._photos(spark, sf_dir), "source_path")
    members = members.select("group_id", "kind", "source_path", "size_bytes", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(duplicates.metadata_keys("source_path"))]).alias("k"))
    per = members.groupBy("group_id", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("b"), F.min(F.struct("k", F.coalesce("size_bytes", F.lit(0)).alias("size")))["size"].alias("kept"))
    return per.groupBy("kind").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("spare"), F.sum(F.col("b") - F.col("kept")).alias("spare_bytes"))


def choice_reasons(spark, sf_dir):
    return library._records(spark, sf_dir).select("record_id", events.explained().alias("why"))


def country_filter(spark, sf_dir):
    return table(spark, sf_dir, "peaks").filter(F.upper("country").isin(COUNTRIES)).select("peak_id", "country")


def names_a_place(spark, sf_dir):
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return library._records(spark, sf_dir).agg(F.count_if(there("verified_peak") | there("crag_name") | there("mountain_range")).alias("placed"), F.count("*").alias("records"))


def timestamp_sources(spark, sf_dir):
    return table(spark, sf_dir, "photos").groupBy("timestamp_source").agg(F.count("*").alias("n"))


def specific_best(spark, sf_dir):
    """The most specific spelling of each summit: most words, then most letters, then the first."""
    known = resolve.spellings(table(spark, sf_dir, "peaks"))
    size = F.struct((-F.size(F.split("normal", " "))).alias("w"), (-F.length("normal")).alias("l"), "normal")
    return known.groupBy("peak_id").agg(F.min(size)["normal"].alias("name"))


def natural_places(spark, sf_dir):
    """Forward lookup: of each summit name the entry of the best kind (a peak before a massif, this before others), then the smallest id; saddles and ridges are no places."""
    p = table(spark, sf_dir, "peaks").filter("kind not in ('saddle', 'ridge', 'arete')").withColumn("normal", text.normalise_name(F.col("peak_name"))).filter("normal <> ''")
    rank = F.when(F.col("kind") == "peak", 0).when(F.col("kind") == "massif", 1).otherwise(2)
    return p.groupBy("normal").agg(F.min(F.struct(rank.alias("r"), "peak_id"))["peak_id"].alias("peak_id"))


def rounded_positions(spark, sf_dir):
    """Cache keys of positions, two decimals of either coordinate, and how many photos share one."""
    p = table(spark, sf_dir, "photos").filter("lat is not null and lon is not null")
    key = F.concat_ws(",", *[F.round(F.col(c) * 100).cast("bigint").cast("string") for c in ("lat", "lon")])
    return p.groupBy(F.concat(F.lit("offline:"), key).alias("key")).agg(F.count("*").alias("n"))


def exif_times(spark, sf_dir):
    """Times of the analyses that are written as cameras write them."""
    return table(spark, sf_dir, "analysis").select("analysis_id", time.exif_datetime(F.col("taken_at")).alias("ts")).filter("ts is not null")


def unplaceable_photos(spark, sf_dir):
    """Records whose keywords or scene say that the frame cannot be placed."""
    scene = F.col("scene")
    said = F.when(scene == "document_or_screen", "document").when(scene == "interior", "indoors").when(scene == "people_portrait", "portrait").otherwise(scene)
    tags = F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.array(said))
    return library._records(spark, sf_dir).filter(classify.unplaceable(tags)).select("record_id")


def clock_tags(spark, sf_dir):
    """Keywords of each record with the season and the part of the day of its photo."""
    taken = table(spark, sf_dir, "photos").groupBy(F.col("content_key").alias("content_hash")).agg(F.min("taken_ts").alias("ts"))
    r = library._records(spark, sf_dir).select("record_id", "content_hash", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return r.join(taken, "content_hash").select("record_id", F.array_join(classify.with_clock(F.col("keywords"), F.col("ts")), ";").alias("tags"))


def clean_lists(spark, sf_dir):
    return library._records(spark, sf_dir).select("record_id", F.array_join(store.clean_list(F.col("gear_visible"), 3), ";").alias("gear"))


def json_maps(spark, sf_dir):
    """Entries of the JSON maps of events, by key."""
    e = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("bigint")).alias("total"))


def numbers_of_text(spark, sf_dir):
    """Coordinates of payloads as numbers, whatever they are written as; what is none is null."""
    a = table(spark, sf_dir, "analysis")
    return a.select("analysis_id", F.get_json_object("payload", "$.latitude").try_cast("double").alias("lat"), F.get_json_object("payload", "$.elevation_m").try_cast("double").alias("elevation")).filter("lat is not null or elevation is not null")


def content_keys(spark, sf_dir):
    """Identity of texts by their bytes, as of files."""
    return table(spark, sf_dir, "ocr_text").filter("text is not null").select("read_id", files.content_key(F.encode("text", "UTF-8")).alias("key"))


def file_survey(spark, sf_dir):
    """The files of the folder of tables itself, by what they are."""
    return files.survey(files.walk(spark, sf_dir))


# --- pixels (vectors of the embeddings table stand for pictures) -----------------


def _pictures(spark, sf_dir, n):
    """Brightness of ``n`` pixels: the first numbers of each vector, spread around the middle grey."""
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 64)
    grey = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.get("embedding", i % 64).cast("double") * 300.0 + 128.0 + F.col("vec_id") % 130 - 20))))
    return e.select("vec_id", grey.alias("px"))


def frame_stats(spark, sf_dir):
    p = _pictures(spark, sf_dir, 64).select("vec_id", pixels.mean(F.col("px")).alias("m"), pixels.stddev(F.col("px")).alias("s"), pixels.edges(F.col("px"), 8).alias("e"))
    return p.select("vec_id", F.round("m", 6).alias("mean"), F.round("s", 6).alias("stddev"), F.round("e", 6).alias("edges"), pixels.emptiness(F.col("m"), F.col("s")).alias("reason"))


def difference_hashes(spark, sf_dir):
    return _pictures(spark, sf_dir, 72).select("vec_id", pixels.difference_hash(F.col("px")).alias("h"))


def scenic_scores(spark, sf_dir):
    return _pictures(spark, sf_dir, 64).select("vec_id", F.round(pixels.scenic(F.col("px"), 8, 8), 6).alias("score"))


# --- side tables ------------------------------------------------------------------


def text_reads(spark, sf_dir):
    """What is known of the text of each photo: never read, read without text, or the latest read's length."""
    reads = store.latest(table(spark, sf_dir, "ocr_text").filter("content_hash <> ''").select("content_hash", "read_id", "text"), "content_hash", "read_id")
    keys = table(spark, sf_dir, "photos").select(F.col("content_key").alias("content_hash")).filter("content_hash is not null").distinct()
    state = F.when(F.col("text").isNull(), "never read").when(F.trim("text") == "", "no text").otherwise("text")
    return keys.join(reads.withColumn("text", F.coalesce("text", F.lit(""))), "content_hash", "left").select("content_hash", state.alias("state"), F.length("text").alias("chars"))


def embedding_reads(spark, sf_dir):
    """The stored vector of each photo for one model: a later write of another model has replaced it, one of another length is none."""
    rows = table(spark, sf_dir, "clip_embedding").filter("content_hash is not null").groupBy("content_hash").agg(F.max(F.struct("made_at", "model", "dims", F.size("vector").alias("size"))).alias("r")).select("content_hash", "r.*")
    return rows.filter("model = 'vit-small-q128' and size = dims").select("content_hash", "dims")


def tag_rows_read(spark, sf_dir):
    """Lists of words stored as JSON; what is no list of texts is null."""
    a = table(spark, sf_dir, "analysis").select("analysis_id", F.get_json_object("payload", "$.keywords").alias("j")).filter("j is not null")
    return a.select("analysis_id", F.size(F.from_json("j", "array<string>")).alias("n"))


def pages_by_score(spark, sf_dir):
    """Photos that look like pages, best first within the table."""
    p = library._prompts(spark, sf_dir, 5).tolist()
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.round(classify.first_share(F.col("embedding"), p, 2, fixed.PAGE_SCALE), 6).alias("score"))
    return s.filter(F.col("score") >= fixed.PAGE_THRESHOLD).orderBy(F.desc("score"), "vec_id")


def paperwork_scores(spark, sf_dir):
    """Share of the last four of seven prompts, and whether it is paperwork."""
    p = library._prompts(spark, sf_dir, 7).tolist()
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.round(1 - classify.first_share(F.col("embedding"), p, 3, fixed.SOFTMAX_SCALE), 6).alias("score"))
    return s.select("vec_id", "score", (F.col("score") >= fixed.PAPERWORK_THRESHOLD).alias("paperwork"))


def result_lines(spark, sf_dir):
    """What each reply line is: an analysis, or why it is none; null and blank lines are passed over."""
    a = table(spark, sf_dir, "analysis").filter("trim(raw_response) <> ''").select("analysis_id", "raw_response", schema_drift.reply_object(F.col("raw_response")).alias("o"))
    known = F.try_variant_get(F.try_parse_json("o"), "$", "map<string,variant>").isNotNull()
    return a.select("analysis_id", F.when(F.try_parse_json("raw_response").isNull(), "corrupt line").when(known, "analysis").otherwise("unparseable response").alias("outcome"))


def reclaimed_results(spark, sf_dir):
    """Results by the path recorded with them, kept where no photo has that path any more."""
    a = table(spark, sf_dir, "analysis").groupBy("source_path").agg(F.count("*").alias("results"))
    p = table(spark, sf_dir, "photos").select("source_path", F.lit(True).alias("there")).distinct()
    return a.join(p, "source_path", "left").groupBy(F.coalesce("there", F.lit(False)).alias("has_photo")).agg(F.count("*").alias("paths"), F.sum("results").alias("results"))


def reply_records(spark, sf_dir):
    """Reply of every analysis as a typed record: texts trimmed, blank ones null, numbers or null, closed sets, lists of at most 20."""
    a = table(spark, sf_dir, "analysis").select("analysis_id", F.try_variant_get(F.try_parse_json(schema_drift.reply_object(F.col("raw_response"))), "$", "map<string,variant>").alias("m")).filter("m is not null")
    return a.select("analysis_id", *store.typed_record(F.col("m")))


def stored_columns(spark, sf_dir):
    """The ten columns that the store keeps of a payload."""
    j = table(spark, sf_dir, "analysis").filter(F.try_parse_json("payload").isNotNull())
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return j.select("analysis_id", *[get(k).alias(k) for k in ("rock_type", "season", "time_of_day", "sharpness", "crag_name", "locality", "evidence_basis", "caption")], get("aesthetic_score").try_cast("double").alias("score"), (get("is_guidebook_page") == "true").alias("guidebook"))


def facets_all(spark, sf_dir):
    """The 60 most frequent values of every field that can be filtered."""
    return search.facets(search.public(library._records(spark, sf_dir)), sorted(set(search.FILTERS.values())))


def match_count(spark, sf_dir):
    """How many public records match the words, with and without the filters; exact, not capped."""
    hits = library.search_bm25(spark, sf_dir).select("record_id").join(search.public(library._records(spark, sf_dir)), "record_id")
    return hits.agg(F.count("*").alias("matches"), F.count_if(search.matching(FILTERED)).alias("filtered"))


def search_page(spark, sf_dir):
    """One page of a search by words, filters and grade, best first, with the latest of equals."""
    r = search.public(library._records(spark, sf_dir)).filter(search.matching({"min_score": 2}))
    r = search.with_grade(r, search.grade_bridge(r), GRADE)
    page = library.search_bm25(spark, sf_dir).join(r.select("record_id", "activity"), "record_id")
    return page.orderBy(F.desc("score"), "record_id").limit(20)


def search_index(spark, sf_dir):
    """The same search through a stored index: built for one half of the records, brought up to date for the other, pruned to the tokens asked for."""
    bodies = library._bodies(spark, sf_dir)
    folder = shared_folder(spark, "index")
    index.build(bodies.filter("record_id % 2 = 0"), folder)
    index.update(bodies.filter("record_id % 2 = 1 or record_id % 10 = 0"), folder, spark)
    return index.search(spark, folder, library.SEARCH).select("record_id", F.round("score", 6).alias("score"))


def stream_merge(spark, sf_dir):
    """The latest event of each user after a stream of events was folded batch by batch into a keyed table."""
    folder = shared_folder(spark, "ledger")
    events_ = live.stream_table(spark, sf_dir, "events.parquet").select("user_id", "event_id", "event_type")
    live.merge_batches(events_, f"{folder}/table", "user_id", "event_id", f"{folder}/state")
    return live.merged(spark, f"{folder}/table")


def gazetteer_roundtrip(spark, sf_dir):
    """Summits per country after the gazetteer was written as JSON and read back."""
    path = shared_folder(spark, "gazetteer")
    table(spark, sf_dir, "peaks").write.json(path)
    back = spark.read.schema(table(spark, sf_dir, "peaks").schema).json(path)
    return back.groupBy("country").agg(F.count("*").alias("n"), F.sum("elevation").alias("heights"), F.sum(F.size("aliases")).alias("aliases"))


QUERIES = {f.__name__: f for f in (
    event_summary, event_locations, event_folders, region_fill, event_times, plan_rollup, edited_events, verified_claims, promoted_claims, text_anchors, ocr_named,
    unique_photos, dedupe_stats, choice_reasons, country_filter, names_a_place, timestamp_sources, specific_best, natural_places, rounded_positions, exif_times, unplaceable_photos, clock_tags, clean_lists, json_maps, numbers_of_text, content_keys, file_survey,
    frame_stats, difference_hashes, scenic_scores, text_reads, embedding_reads, tag_rows_read, pages_by_score, paperwork_scores, result_lines, reclaimed_results, reply_records, stored_columns,
    facets_all, match_count, search_page, search_index, stream_merge, gazetteer_roundtrip,
)}

from ridgeline.plans.events_sql import SQL  # noqa: E402, F401
