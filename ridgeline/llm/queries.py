"""Queries of the training-text problems, with the SQL of those that SQL can express. Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import components, language, leakage, neighbours, ocr, packing, survivorship
from ridgeline.sources.tables import spread, table


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = ocr.pages_of(("ocr_text", spread(table(spark, sf_dir, "ocr_text")), "read_id", "text"), ("photo_analysis", spread(table(spark, sf_dir, "photo_analysis").select("record_id", "visible_text")), "record_id", "visible_text"))
    peaks = table(spark, sf_dir, "peaks")
    names = peaks.select(F.explode(F.concat(F.array("peak_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return pages, spread(table(spark, sf_dir, "documents").select("text")), names


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.noise(*_pages(spark, sf_dir))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    return ocr.repaired(*_pages(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(neighbours.usable(table(spark, sf_dir, "clip_embedding")), 5))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.survivors(table(spark, sf_dir, "dup_group"), table(spark, sf_dir, "photos"))


def p5_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden_records(table(spark, sf_dir, "dup_group"), table(spark, sf_dir, "photos"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "match_pair").filter("verdict = 'match'")
    return components.components(matches, "hash_a", "hash_b").select(F.col("vertex").alias("content_hash"), F.col("label").alias("group_hash"))


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p6_found(spark, sf_dir).groupBy("group_hash").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = [(r.target_name, r.capacity_tokens) for r in table(spark, sf_dir, "pack_capacity").collect()]  # the targets: a parameter
    return packing.pack(packing.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), capacities)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, tokens and share of room used per target."""
    return packing.utilisation(_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each leaked run stands in the text, and its number of words."""
    return leakage.spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item"))


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, language.Model, frozenset[str]]:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    model = language.train(documents, table(spark, sf_dir, "lang_sample"))
    documents, names = language.with_names(documents, table(spark, sf_dir, "peaks"))
    return documents, model, names


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, model, names = _languages(spark, sf_dir)
    return language.doubtful(documents, model, names=names)


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's main language with its confidence."""
    documents, model, names = _languages(spark, sf_dir)
    return language.document_languages(documents, model, names=names)


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with language, with its confidence."""
    documents, model, names = _languages(spark, sf_dir)
    return language.segment(documents, model, names=names)


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired, "p4_found": p4_found, "p5_found": p5_found, "p5_golden": p5_golden, "p6_found": p6_found, "p6_sizes": p6_sizes, "p8_packed": p8_packed, "p8_utilisation": p8_utilisation, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_documents": p10_documents, "p10_segments": p10_segments}

_P5 = """
WITH g AS (SELECT group_id, arg_max(photos, found_at) AS photos FROM dup_group GROUP BY group_id),
m AS (SELECT DISTINCT group_id, source_path FROM (SELECT group_id, unnest(photos) AS source_path FROM g) WHERE source_path IS NOT NULL),
s AS (SELECT * FROM photos QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY scanned_at DESC NULLS LAST, scan_row_id DESC) = 1),
r AS (SELECT m.group_id, s.*, row_number() OVER (PARTITION BY m.group_id ORDER BY coalesce(width::BIGINT * height, 0) DESC, coalesce(size_bytes, -1) DESC,
  (coalesce(timestamp_source, '') = 'exif')::INT DESC, (lat IS NOT NULL AND lon IS NOT NULL)::INT DESC, source_path) AS k,
  CASE timestamp_source WHEN 'exif' THEN 0 WHEN 'filename' THEN 1 WHEN 'mtime' THEN 2 WHEN 'none' THEN 3 ELSE 4 END AS o FROM m JOIN s USING (source_path)),
f AS (SELECT group_id, arg_min(source_path, k) AS record, arg_min(source_path, k) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS position,
  arg_min(source_path, k) FILTER (trim(camera_model) <> '') AS camera_model, arg_min(source_path, o * 1000000 + k) FILTER (taken_ts IS NOT NULL) AS taken_ts FROM r GROUP BY group_id)
"""
_P6 = """
WITH RECURSIVE e AS (SELECT hash_a AS a, hash_b AS b FROM match_pair WHERE verdict = 'match' AND hash_a IS NOT NULL AND hash_b IS NOT NULL),
arcs AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
reach(v, w) AS (SELECT a, a FROM arcs UNION SELECT r.v, arcs.b FROM reach r JOIN arcs ON arcs.a = r.w),
labels AS (SELECT v AS content_hash, min(w) AS group_hash FROM reach GROUP BY v)
"""
_P4 = """
WITH l AS (SELECT content_hash, max({'t': made_at, 'm': model, 'd': dims, 'v': vector::DOUBLE[]}) AS r FROM clip_embedding WHERE content_hash IS NOT NULL GROUP BY content_hash),
u AS (SELECT content_hash AS h, r.m AS m, r.v AS v FROM l WHERE r.v IS NOT NULL AND len(r.v) = r.d AND NOT list_bool_or([isnan(x) OR x IS NULL FOR x IN r.v]) AND list_bool_or([x <> 0 FOR x IN r.v])),
p AS (SELECT a.h AS a, b.h AS b, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM u a JOIN u b ON a.m = b.m AND a.h <> b.h),
t AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS hash_a, greatest(a, b) AS hash_b FROM t
"""
_WORDS = "regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[\\p{{M}}\\p{{Cf}}]+', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_P9 = f"""
WITH d AS (SELECT doc_id AS k, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id AS k, {_WORDS.format("passage")} AS w FROM eval_item WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT k, array_to_string(w[i:i + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS t(i)), eg AS (SELECT DISTINCT k, array_to_string(w[i:i + 11], ' ') AS g FROM e, unnest(range(1, len(w) - 10)) AS t(i))
SELECT DISTINCT dg.k AS doc_id, eg.k AS item_id FROM dg JOIN eg USING (g)
"""
SQL = {
    "p4_found": _P4,
    "p9_found": _P9,
    "p5_found": _P5 + """SELECT group_id, 'record' AS field_name, record AS source_path FROM f WHERE record IS NOT NULL
UNION ALL SELECT group_id, 'position', position FROM f WHERE position IS NOT NULL
UNION ALL SELECT group_id, 'camera_model', camera_model FROM f WHERE camera_model IS NOT NULL
UNION ALL SELECT group_id, 'taken_ts', taken_ts FROM f WHERE taken_ts IS NOT NULL""",
    "p5_golden": _P5 + """SELECT f.group_id, record AS record_from, position AS position_from, f.camera_model AS camera_model_from, f.taken_ts AS taken_ts_from, a.size_bytes, a.width, a.height, b.lat, b.lon, c.camera_model, d.taken_ts
FROM f JOIN s a ON a.source_path = record LEFT JOIN s b ON b.source_path = position LEFT JOIN s c ON c.source_path = f.camera_model LEFT JOIN s d ON d.source_path = f.taken_ts""",
    "p6_found": _P6 + "SELECT content_hash, group_hash FROM labels",
    "p6_sizes": _P6 + "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM labels GROUP BY group_hash) GROUP BY size",
}
