"""Queries of the general data problems: schema drift (1), timestamps (3) and
places (7). Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import schema_drift, spatial, timestamps
from ridgeline.session import cut
from ridgeline.sources.tables import spread, table

NEAR_KM = 4.0


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(spread(table(spark, sf_dir, "analysis").select("export_file", "payload", "raw_response")), table(spark, sf_dir, "store_file"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("export_file", "doc_kind", "change_kind", "field_name", "new_value")


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All analyses under one schema, whatever keys and types their files used, with every field that any file has."""
    rows = table(spark, sf_dir, "analysis").select("analysis_id", "export_file", "content_hash", "payload", "raw_response")
    # read by the changes and by the schema
    prof = cut(schema_drift.profile(schema_drift.documents(spread(rows.select("export_file", "payload", "raw_response")))))
    renames = schema_drift.changes(rows, table(spark, sf_dir, "store_file"), prof=prof).filter("change_kind = 'renamed'")
    target, other_keys = schema_drift.schema(prof, renames, rows.columns)
    return schema_drift.consistent(rows, other_keys, target)


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file and payload field: documents with the key, and with a value."""
    rows = table(spark, sf_dir, "analysis").select("export_file", "payload", F.lit(None).cast("string").alias("raw_response"))
    return schema_drift.profile(schema_drift.documents(rows)).filter("key <> ''").select("export_file", F.col("key").alias("field_name"), "n", "filled")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(timestamps.stacked(spread(table(spark, sf_dir, "analysis").select("analysis_id", "export_file", "taken_at", "analysed_at"))), table(spark, sf_dir, "store_file"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).filter(F.col("utc_micros").isNotNull()).select("analysis_id", "field_name", "utc_micros")


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its status, format and posterior."""
    return _times(spark, sf_dir).select("analysis_id", "field_name", "value", "status", "component", F.round("posterior", 6).alias("posterior"), "utc_micros")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "photo_analysis").select("record_id", "latitude", "longitude")
    peaks = table(spark, sf_dir, "peaks").select("peak_id", "lat", "lon")
    close = spatial.within_circles(records, peaks, NEAR_KM, point=("record_id", "latitude", "longitude"), target=("peak_id", "lat", "lon"))
    inside = spatial.containing(records, table(spark, sf_dir, "areas"), point=("record_id", "latitude", "longitude"))
    return close.select("record_id", F.lit("peak").alias("target_kind"), F.col("peak_id").alias("target_id")).unionByName(inside.select("record_id", F.lit("area").alias("target_kind"), F.col("area_id").alias("target_id")))


QUERIES = {"p1_found": p1_found, "p1_table": p1_table, "p1_fields": p1_fields, "p3_found": p3_found, "p3_normalised": p3_normalised, "p7_found": p7_found}



def _moments() -> str:
    """SQL of p3_found from the patterns of the components: slash dates by the zone's order where both are days of the calendar."""
    t = timestamps
    n, slash = len(t.COMPONENTS), t.NAMES.index("slash_day_first")
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    shapes = [(i, p) for i, (_, p, _) in enumerate(t.COMPONENTS) if i != slash + 1] + [(n + i, p) for i, (_, p, _) in enumerate(t.EPOCHS)]
    which = " ".join(f"WHEN regexp_matches(v, {quote(p)}) THEN {i}" for i, p in shapes)
    # (DuckDB has nine groups; the tenth is the zone in brackets at the end)
    group = lambda p, g: "''" if not g else f"regexp_extract(v, {quote(p)}, {g})" if g < 10 else "regexp_extract(v, '\\[([A-Za-z0-9_+/-]+)\\]$', 1)"
    parts = " ".join(f"WHEN {i} THEN [{', '.join(group(p, g) for g in order)}]" for i, (_, p, order) in enumerate(t.COMPONENTS) if i != slash + 1)
    fold = str.maketrans("éûä", "eua")
    heads = {h.translate(fold)[:3]: m for m, names in t.MONTHS.items() for h in names if not h.startswith("jui")}
    month = f"coalesce(try_cast(p[2] AS INT), CASE substring(mn, 1, 4) WHEN 'juin' THEN 6 WHEN 'juil' THEN 7 END, CASE substring(mn, 1, 3) {' '.join(f'WHEN {quote(h)} THEN {m}' for h, m in heads.items())} END)"
    named = " ".join(f"WHEN {quote(z)} THEN {m}" for z, m in (t.ABBREVIATIONS | {"Z": 0}).items())
    date = lambda m, d: f"try_cast(p[1] || '-' || lpad({m}::VARCHAR, 2, '0') || '-' || lpad({d}::VARCHAR, 2, '0') AS DATE)"
    epoch = " ".join(f"WHEN {n + i} THEN " + (f"floor(regexp_extract(v, '^(-?[0-9]+)', 1)::HUGEINT / {-k}.0)::BIGINT" if k < 0 else f"regexp_extract(v, '^(-?[0-9]+)', 1)::BIGINT * {k}") for i, (_, _, k) in enumerate(t.EPOCHS))
    return f"""WITH x AS (SELECT analysis_id, 'taken_at' AS field_name, export_file, taken_at AS value FROM analysis UNION ALL SELECT analysis_id, 'analysed_at', export_file, analysed_at FROM analysis),
v AS (SELECT analysis_id, field_name, home_zone, regexp_replace(value, '^[\\s\\x00\\x{{A0}}]+|[\\s\\x00\\x{{A0}}]+$', '', 'g') AS v FROM x LEFT JOIN store_file USING (export_file)), w AS (SELECT *, CASE {which} END AS c FROM v), q AS (SELECT *, CASE c {parts} END AS p FROM w),
m AS (SELECT *, translate(lower(p[2]), 'éûä', 'eua') AS mn, try_cast(p[3] AS INT) AS d, try_cast(p[4] AS INT) AS h0, try_cast(p[5] AS INT) AS mi, coalesce(try_cast(p[6] AS INT), 0) AS se, upper(p[8]) AS half, nullif(p[10], '') AS own_zone, regexp_replace(p[9], '^(UTC|GMT)?[+-]|:', '', 'g') AS dg FROM q),
o AS (SELECT *, {month} AS mo, CASE WHEN regexp_matches(p[9], '[+-]') THEN (CASE WHEN contains(p[9], '-') THEN -1 ELSE 1 END) * (substring(dg, 1, 2)::INT * 60 + coalesce(try_cast(substring(dg, 3, 2) AS INT), 0)) ELSE CASE upper(p[9]) {named} END END AS off, CASE WHEN half = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END END AS h FROM m),
k AS (SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND se <= 59 AND (p[9] = '' OR off IS NOT NULL) THEN (h * 3600 + mi * 60 + se)::BIGINT * 1000000 + CASE WHEN p[7] <> '' THEN rpad(substring(p[7], 1, 6), 6, '0')::BIGINT ELSE 0 END END AS clock, {date("mo", "d")} AS d1, CASE WHEN c = {slash} THEN {date("d", "mo")} END AS d2 FROM o),
r AS (SELECT *, CASE WHEN c >= {n} THEN CASE c {epoch} END + CASE WHEN regexp_matches(v, '[.,]') THEN rpad(substring(regexp_extract(v, '[.,]([0-9]+)$', 1), 1, 6), 6, '0')::BIGINT ELSE 0 END
  ELSE epoch_us((CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL AND starts_with(coalesce(home_zone, ''), 'America/') THEN d2 ELSE coalesce(d1, d2) END)::TIMESTAMP) + clock END AS wall, CASE WHEN c >= {n} THEN 0 ELSE off END AS fixed FROM k),
z AS (SELECT *, CASE WHEN coalesce(own_zone, home_zone) IN (SELECT name FROM pg_timezone_names()) THEN coalesce(own_zone, home_zone) END AS zone, make_timestamp(wall) AS ts FROM r WHERE wall IS NOT NULL),
u AS (SELECT *, CASE WHEN fixed IS NULL AND zone IS NOT NULL THEN timezone(zone, ts) END AS late FROM z)
SELECT analysis_id, field_name, CASE WHEN fixed IS NOT NULL THEN wall - fixed::BIGINT * 60000000 WHEN timezone(zone, late - INTERVAL 1 HOUR) = ts THEN epoch_us(late) - 3600000000 ELSE epoch_us(late) END AS utc_micros FROM u WHERE fixed IS NOT NULL OR late IS NOT NULL"""


SQL = {
    "p3_found": _moments(),
    "p1_fields": """
WITH docs AS (SELECT export_file, payload::JSON AS j FROM analysis WHERE json_valid(payload)),
pairs AS (SELECT export_file, j, unnest(json_keys(j)) AS field_name FROM docs WHERE json_type(j) = 'OBJECT')
SELECT export_file, field_name, count(*) AS n, count(*) FILTER (json_type(j, '$."' || field_name || '"') <> 'NULL') AS filled FROM pairs GROUP BY ALL
""",
    "p7_found": """
WITH pts AS (SELECT record_id, latitude AS y, longitude AS x FROM photo_analysis WHERE NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180),
near AS (SELECT record_id, peak_id FROM pts JOIN peaks ON lat IS NOT NULL AND lon IS NOT NULL AND abs(lat - y) < 0.04
  AND 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) <= 4.0),
rings AS (SELECT area_id, ring_no, is_hole, ring_lat AS la, ring_lon AS lo, len(ring_lat) AS n FROM areas),
edges AS (SELECT area_id, ring_no, is_hole, la[i] AS y1, lo[i] AS x1, la[i % n + 1] AS y2, lo[i % n + 1] AS x2 FROM rings, unnest(range(1, n + 1)) AS t(i)),
crossed AS (SELECT record_id, area_id, ring_no, is_hole FROM pts JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
  GROUP BY record_id, area_id, ring_no, is_hole HAVING count(*) % 2 = 1),
inside AS (SELECT record_id, area_id FROM crossed GROUP BY record_id, area_id HAVING NOT bool_or(is_hole))
SELECT record_id, 'peak' AS target_kind, peak_id AS target_id FROM near UNION ALL SELECT record_id, 'area', area_id FROM inside
""",
}
