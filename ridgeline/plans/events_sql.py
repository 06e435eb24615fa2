"""DuckDB SQL of the queries of events, side tables and the stored index, written
from their meaning over the whole tables."""

from __future__ import annotations

from ridgeline.functions import fixed
from ridgeline.functions.time import EXIF_FORM
from ridgeline.operators.search import FILTERS
from ridgeline.operators.store import CLOSED, RECORD
from ridgeline.plans.library_sql import _KEEP, _LP, _MEMBERS, _PUBLIC, _SESSIONS, _SPELL, _STRENGTH, _SUMMARY, _km, _label, _list, _normal, _slug
from ridgeline.plans.library_sql import SQL as LIBRARY

_VOTED = ["crag_name", "mountain_range", "region", "locality", "country", "country_code", "season", "activity"]
_RECORDS = f"""{_SESSIONS}, r1 AS (SELECT * FROM photo_analysis QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY record_id) = 1),
er AS (SELECT sess.top_folder, session_no, sess.source_path AS pth, taken_ts, r1.* FROM sess JOIN r1 ON r1.content_hash = sess.content_key)"""
_PRIOR = "CASE evidence_basis " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.PEAK_PRIOR.items()) + " ELSE 0 END"


def _vote(v: str) -> str:
    value = "CASE WHEN activity NOT IN ('unknown', 'none') THEN activity END" if v == "activity" else v
    return f"v_{v} AS (SELECT top_folder, session_no, {v} FROM (SELECT top_folder, session_no, {value} AS {v}, count(*) AS n, min(pth) AS f FROM er WHERE {value} <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY n DESC, f) = 1)"


_EVENTS = f"""{_RECORDS}, {", ".join(_vote(v) for v in _VOTED)},
cs AS (SELECT top_folder, session_no, verified_peak AS peak, {_STRENGTH.replace("basis", "evidence_basis").replace("confidence", "location_confidence")} AS s FROM er WHERE verified_peak <> ''),
cr AS (SELECT *, row_number() OVER (PARTITION BY top_folder, session_no, peak ORDER BY s DESC) - 1 AS k FROM cs), cp AS (SELECT top_folder, session_no, peak, round(1 - product(1 - s * pow(0.6::DOUBLE, k)), 12) AS p, count(*) AS n FROM cr GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY top_folder, session_no ORDER BY p DESC, peak) AS rank FROM cp),
bs AS (SELECT top_folder, session_no, verified_peak AS peak, evidence_basis AS basis, verified_lat, verified_lon, verified_country FROM er WHERE verified_peak <> '' QUALIFY row_number() OVER (PARTITION BY top_folder, session_no, verified_peak ORDER BY {_PRIOR} DESC, pth) = 1),
tp AS (SELECT a.*, basis, verified_lat, verified_lon, verified_country, b.peak AS runner_up, b.p AS runner_up_probability FROM rk a JOIN bs USING (top_folder, session_no, peak) LEFT JOIN rk b ON b.top_folder = a.top_folder AND b.session_no = a.session_no AND b.rank = 2 WHERE a.rank = 1),
kw AS (SELECT top_folder, session_no, array_to_string(list_sort(list(DISTINCT w))[1:12], ';') AS keywords FROM (SELECT top_folder, session_no, unnest(keywords) AS w FROM er) WHERE w <> '' GROUP BY ALL),
ct AS (SELECT top_folder, session_no, count(*) AS considered, min(taken_ts) AS start_ts FROM er GROUP BY ALL),
ev AS (SELECT ct.*, CASE WHEN p >= 0.5 THEN peak END AS verified_peak, CASE WHEN p < 0.5 THEN peak END AS rejected_peak, CASE WHEN p >= 0.5 THEN verified_lat END AS vlat, CASE WHEN p >= 0.5 THEN verified_lon END AS vlon, verified_country, basis AS evidence_basis, p AS probability, tp.n AS agreement, runner_up, runner_up_probability,
  crag_name, mountain_range, region, locality, country, country_code, coalesce(season, 'unknown') AS season, coalesce(activity, 'unknown') AS activity, keywords
  FROM ct LEFT JOIN tp USING (top_folder, session_no) LEFT JOIN kw USING (top_folder, session_no) {" ".join(f"LEFT JOIN v_{v} USING (top_folder, session_no)" for v in _VOTED)})"""
_LOCATED = f"""{_EVENTS}, gz AS (SELECT top_folder, session_no, vlat AS lat, vlon AS lon, 'gazetteer' AS source FROM ev WHERE vlat IS NOT NULL AND vlon IS NOT NULL),
pt AS (SELECT er.top_folder, er.session_no, pth, latitude AS a, longitude AS o FROM er ANTI JOIN gz USING (top_folder, session_no) WHERE NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180),
pr AS (SELECT x.top_folder, x.session_no, x.pth AS seed, y.pth AS other, y.a, y.o FROM pt x JOIN pt y USING (top_folder, session_no) WHERE {_km('x.a', 'x.o', 'y.a', 'y.o')} <= 25),
sz AS (SELECT top_folder, session_no, seed, count(*) AS agreeing FROM pr GROUP BY ALL), tot AS (SELECT top_folder, session_no, count(*) AS n FROM pt GROUP BY ALL), bst AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY agreeing DESC, seed) = 1),
ch AS (SELECT * FROM bst JOIN tot USING (top_folder, session_no) WHERE agreeing >= 2 AND agreeing / n >= 0.4), mem AS (SELECT ch.top_folder, ch.session_no, agreeing, other, a, o FROM ch JOIN pr ON pr.top_folder = ch.top_folder AND pr.session_no = ch.session_no AND pr.seed = ch.seed),
co AS (SELECT x.top_folder, x.session_no, x.agreeing, x.other, x.a, x.o, sum({_km('x.a', 'x.o', 'y.a', 'y.o')}) AS d FROM mem x JOIN mem y USING (top_folder, session_no) GROUP BY ALL),
cn AS (SELECT top_folder, session_no, a AS lat, o AS lon, 'consensus' AS source FROM co QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY CASE WHEN agreeing <= 2 THEN 0 ELSE round(d, 9) END, other) = 1),
loc AS (SELECT * FROM gz UNION ALL SELECT * FROM cn)"""
_clear = lambda c: f"CASE WHEN lower({_slug(c)}) NOT IN ({_list(fixed.VAGUE_REGIONS)}) THEN {c} END"
_PX = "px AS (SELECT vec_id, [least(255.0, greatest(0.0, floor(embedding[i % 64 + 1]::DOUBLE * 300.0 + 128.0 + vec_id % 130 - 20)))::DOUBLE FOR i IN range(0, {n})] AS px FROM embeddings WHERE len(embedding) >= 64)"
_sd = lambda x: f"sqrt(list_sum([pow(v - list_sum({x}) / len({x}), 2) FOR v IN {x}]) / len({x}))"
_mean = lambda x: f"(list_sum({x}) / len({x}))"
_EDGES = "(list_sum([abs(px[i] - px[i + 1]) FOR i IN range(1, 64) IF i % 8 <> 0]) / 56)"
_HITS = f"""{_SPELL}, shown AS (SELECT record_id, array_to_string(list_filter(list_concat(coalesce(place_names_visible, []), [visible_text]), lambda x: x IS NOT NULL), chr(10)) AS s FROM photo_analysis WHERE NOT coalesce(is_personal_document, false)),
w AS (SELECT record_id, list_filter(regexp_split_to_array(s, '[^0-9A-Za-zÀ-ɏ]+'), lambda x: x <> '') AS ws FROM shown WHERE s <> ''), n4 AS (SELECT record_id, ws, unnest(range(1, 5)) AS n FROM w), p4 AS (SELECT record_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS position FROM n4 WHERE len(ws) >= n),
g4 AS (SELECT record_id, n, position, array_to_string(ws[position:position + n - 1], ' ') AS span FROM p4), f4 AS (SELECT record_id, n, position, {_normal('span')} AS normal FROM g4), h4 AS (SELECT record_id, normal, max(n) AS n_words, min(position) AS position FROM f4 WHERE (n > 1 OR len(normal) >= 8) AND normal IN (SELECT normal FROM spell) GROUP BY ALL),
hits AS (SELECT record_id, normal, row_number() OVER (PARTITION BY record_id ORDER BY n_words DESC, position, normal) AS rank FROM h4 QUALIFY rank <= 5)"""
_OUT = "CASE WHEN json_valid(raw_response) THEN raw_response::JSON END"
_INNER = f"""rr AS (SELECT analysis_id, raw_response, {_OUT} AS r FROM analysis WHERE trim(raw_response) <> ''), ww AS (SELECT *, coalesce((r->>'$.response.candidates[0].content.parts[0].text'), (r->>'$.candidates[0].content.parts[0].text')) AS w, ((r->'$.response') IS NOT NULL OR (r->'$.candidates') IS NOT NULL) AS wrapped FROM rr),
uu AS (SELECT *, CASE WHEN w IS NOT NULL THEN regexp_replace(w, '^\\s*```[A-Za-z]*\\s*|\\s*```\\s*$', '', 'g') WHEN NOT wrapped THEN r::VARCHAR END AS o FROM ww), jj AS (SELECT analysis_id, r, CASE WHEN json_valid(o) THEN CASE WHEN json_type(o::JSON) = 'OBJECT' THEN o::JSON END END AS j FROM uu)"""
_text = lambda k: f"nullif(trim(j->>'$.{k}'), '')"


def _closed(k: str) -> str:
    allowed, default, aliases = CLOSED[k]
    v = f"regexp_replace(lower(trim(j->>'$.{k}')), '\\s+', '_', 'g')"
    cases = "".join(f"WHEN {v} = '{a}' THEN '{b}' " for a, b in (aliases or {}).items())
    return f"CASE {cases}WHEN {v} IN ({_list(allowed)}) THEN {v} ELSE '{default}' END AS {k}"


def _items(k: str) -> str:
    whole = f"CASE WHEN json_type(j, '$.{k}') = 'ARRAY' THEN (j->'$.{k}')::VARCHAR[] ELSE [] END"
    return f"array_to_string(list_filter([trim(x) FOR x IN {whole}], lambda x: x IS NOT NULL AND x <> '')[1:20], ';') AS {k}"


_BM25 = LIBRARY["search_bm25"].removesuffix("SELECT record_id, score FROM bm")
_DOT = "WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT {n}), s AS (SELECT e.vec_id, k, {scale} * list_dot_product(e.embedding::DOUBLE[], p.v) AS s FROM embeddings e, p), x AS (SELECT vec_id, k, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s)"
_SPECIFIC = "len(string_split(normal, ' ')) DESC, len(normal) DESC, normal"

SQL: dict[str, str] = {
    "event_summary": f"WITH {_EVENTS} SELECT top_folder, session_no, considered, verified_peak, rejected_peak, evidence_basis, round(probability, 6) AS probability, agreement, runner_up, round(runner_up_probability, 6) AS runner_up_probability, {', '.join(_VOTED)}, keywords FROM ev",
    "event_locations": f"WITH {_LOCATED} SELECT top_folder, session_no, lat, lon, source FROM loc",
    "event_folders": f"WITH {_EVENTS}, np AS (SELECT *, concat_ws('_', nullif({_slug('coalesce(verified_country, country_code)')}, ''), nullif({_slug('coalesce(' + _clear('region') + ', ' + _clear('mountain_range') + ')')}, ''), nullif({_slug('coalesce(verified_peak, crag_name)')}, '')) AS parts, {_slug('nullif(activity, ' + chr(39) + 'unknown' + chr(39) + ')')} AS act FROM ev), nn AS (SELECT *, coalesce(strftime(start_ts, '%Y'), '0000') AS year, substring(CASE WHEN act <> '' AND NOT contains(lower(parts), lower(act)) THEN concat_ws('_', nullif(parts, ''), act) ELSE parts END, 1, 60) AS name FROM np), fd AS (SELECT *, CASE WHEN name <> '' THEN substring(name || coalesce(strftime(start_ts, '_%d_%m'), ''), 1, 60) ELSE 'Event' || CASE WHEN session_no < 1000 THEN lpad(session_no::VARCHAR, 3, '0') ELSE session_no::VARCHAR END END AS fn FROM nn), fk AS (SELECT *, row_number() OVER (PARTITION BY top_folder, year, lower(fn) ORDER BY session_no) AS k FROM fd) SELECT top_folder, session_no, year, fn || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS folder FROM fk",
    "region_fill": f"WITH {_LOCATED}, edges AS (SELECT area_id, ring_no, is_hole, ring_lat[i] AS y1, ring_lon[i] AS x1, ring_lat[i % len(ring_lat) + 1] AS y2, ring_lon[i % len(ring_lat) + 1] AS x2 FROM areas, unnest(range(1, len(ring_lat) + 1)) AS t(i)), crossed AS (SELECT top_folder, session_no, area_id, is_hole FROM loc JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY top_folder, session_no, area_id, ring_no, is_hole HAVING count(*) % 2 = 1), ins AS (SELECT top_folder, session_no, area_id FROM crossed GROUP BY ALL HAVING NOT bool_or(is_hole)), fst AS (SELECT top_folder, session_no, min(area_id) AS area_id FROM ins GROUP BY ALL), nm AS (SELECT area_id, min(area_name) AS area_name, min(country) AS area_country FROM areas GROUP BY area_id), ht AS (SELECT * FROM fst JOIN nm USING (area_id)) SELECT ev.top_folder, ev.session_no, coalesce(area_name, region) AS region, coalesce(area_country, country_code) AS country_code, CASE WHEN area_name IS NULL THEN mountain_range END AS mountain_range FROM ev LEFT JOIN ht USING (top_folder, session_no)",
    "event_times": f"WITH {_SUMMARY} SELECT top_folder, session_no, strftime(start_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_ts) % 1000000 = 0 THEN '' ELSE strftime(start_ts, '.%f') END AS start_text, round((epoch_us(end_ts) - epoch_us(start_ts)) / 86400e6, 6) AS span_days, strftime(start_ts, '%Y') AS year, strftime(start_ts, '%d_%m') AS day_month FROM summary WHERE start_ts IS NOT NULL",
    "plan_rollup": f"WITH {_SUMMARY} SELECT count(*) AS sessions, sum(items)::BIGINT AS photos, sum(bytes)::BIGINT AS bytes, count(*) FILTER (start_ts IS NULL) AS undated, sum(no_position)::BIGINT AS no_position, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM summary",
    "edited_events": f"WITH {_SUMMARY}, e AS (SELECT top_folder, session_no, items, CASE WHEN session_no % 3 = 0 THEN 'Tour_' || session_no END AS name, max(CASE WHEN session_no = 1 OR session_no % 5 <> 0 THEN session_no END) OVER (PARTITION BY top_folder ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS surviving FROM summary), ln AS (SELECT *, CASE WHEN name IS NOT NULL THEN {_label(chr(39) + 'Tour ' + chr(34) + chr(39) + ' || session_no || ' + chr(39) + chr(34) + ' *?' + chr(39))} END AS clean FROM e) SELECT top_folder, surviving AS session_no, max(CASE WHEN session_no = surviving THEN clean END) AS name, sum(items)::BIGINT AS items, count(*) AS n_events FROM ln GROUP BY top_folder, surviving",
    "verified_claims": "WITH fz AS (" + LIBRARY["fuzzy_resolve"].replace("SELECT substring(peak_name, 1, 2) || substring(peak_name, 4) AS name FROM photo_analysis WHERE peak_name IS NOT NULL", "SELECT peak_name AS name FROM photo_analysis WHERE peak_name <> ''") + ") SELECT record_id, peak_id, CASE WHEN peak_id IS NULL THEN peak_name END AS rejected_peak FROM photo_analysis LEFT JOIN fz ON name = peak_name AND rank = 1 WHERE peak_name <> ''",
    "promoted_claims": f"WITH {_HITS}, kn AS (SELECT normal, min(peak_id) AS peak_id FROM spell GROUP BY normal) SELECT r.record_id, kn.peak_id, CASE WHEN evidence_basis IN ('sign_in_scene', 'printed_page') THEN evidence_basis WHEN coalesce(is_guidebook_page, false) THEN 'printed_page' ELSE 'sign_in_scene' END AS evidence_basis FROM photo_analysis r JOIN hits ON hits.record_id = r.record_id AND rank = 1 JOIN kn USING (normal) WHERE coalesce(verified_peak, '') = ''",
    "text_anchors": f"WITH {_RECORDS}, {_HITS} SELECT DISTINCT top_folder, session_no, normal FROM er JOIN hits USING (record_id)",
    "ocr_named": f"WITH {_RECORDS}, unn AS (SELECT top_folder, session_no FROM er GROUP BY ALL HAVING NOT coalesce(bool_or(verified_peak <> ''), false)), pg AS (SELECT top_folder, session_no, record_id, visible_text, len(regexp_extract_all(visible_text, '[A-Za-zÀ-ɏ]{{4,}}')) AS words FROM er JOIN unn USING (top_folder, session_no) WHERE words >= 3 QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY words DESC, record_id) <= 6), {_HITS.replace('shown AS (SELECT record_id, array_to_string(list_filter(list_concat(coalesce(place_names_visible, []), [visible_text]), lambda x: x IS NOT NULL), chr(10)) AS s FROM photo_analysis WHERE NOT coalesce(is_personal_document, false))', 'shown AS (SELECT record_id, visible_text AS s FROM pg)')} SELECT top_folder, session_no, normal AS name FROM pg JOIN hits USING (record_id) QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY {_SPECIFIC}) = 1",
    "unique_photos": f"WITH {_LP} SELECT source_path FROM lp WHERE duplicate_role IS NULL OR duplicate_role = 'keep'",
    "dedupe_stats": f"WITH {_LP}, {_MEMBERS}, k AS (SELECT group_id, kind, coalesce(size_bytes, 0) AS b, row_number() OVER (PARTITION BY group_id ORDER BY {_KEEP.replace('source_path', 'lp.source_path')}) AS k FROM members JOIN lp ON lp.source_path = members.source_path) SELECT kind, count(DISTINCT group_id) AS groups, count(*) FILTER (k > 1) AS spare, coalesce(sum(b) FILTER (k > 1), 0)::BIGINT AS spare_bytes FROM k GROUP BY kind",
    "choice_reasons": "SELECT record_id, concat_ws(', ', coalesce(sharpness, 'unknown'), CASE WHEN gaze NOT IN ('no_people', 'unknown') THEN replace(gaze, '_', ' ') END, CASE WHEN eyes_closed_count > 0 THEN eyes_closed_count || ' blinking' END, CASE WHEN composition <> 'unknown' THEN composition || ' composition' END, CASE WHEN aesthetic_score > 0 THEN 'rated ' || aesthetic_score || '/5' END) AS why FROM photo_analysis",
    "country_filter": "SELECT peak_id, country FROM peaks WHERE upper(country) IN ('CH', 'FR', 'NO')",
    "names_a_place": "SELECT count(*) FILTER (verified_peak <> '' OR crag_name <> '' OR mountain_range <> '') AS placed, count(*) AS records FROM photo_analysis",
    "timestamp_sources": "SELECT timestamp_source, count(*) AS n FROM photos GROUP BY timestamp_source",
    "specific_best": f"WITH {_SPELL} SELECT peak_id, normal AS name FROM spell QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY {_SPECIFIC}) = 1",
    "natural_places": f"WITH n AS (SELECT peak_id, kind, {_normal('peak_name')} AS normal FROM peaks WHERE kind NOT IN ('saddle', 'ridge', 'arete')) SELECT normal, peak_id FROM n WHERE normal <> '' QUALIFY row_number() OVER (PARTITION BY normal ORDER BY CASE kind WHEN 'peak' THEN 0 WHEN 'massif' THEN 1 ELSE 2 END, peak_id) = 1",
    "rounded_positions": "SELECT 'offline:' || round(lat * 100)::BIGINT || ',' || round(lon * 100)::BIGINT AS key, count(*) AS n FROM photos WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY key",
    "exif_times": f"WITH t AS (SELECT analysis_id, regexp_replace(taken_at, '^[\\s\\x00]+|[\\s\\x00]+$', '', 'g') AS t FROM analysis), m AS (SELECT analysis_id, try_cast(regexp_replace(t, '{EXIF_FORM}', '\\1-\\3-\\4 \\5\\6') AS TIMESTAMP) AS ts FROM t WHERE regexp_matches(t, '{EXIF_FORM}') AND regexp_extract(t, '^....(.)', 1) = regexp_extract(t, '^.......(.)', 1) AND t NOT LIKE '0000%') SELECT * FROM m WHERE ts IS NOT NULL",
    "unplaceable_photos": f"SELECT record_id FROM photo_analysis WHERE list_has_any(list_concat(coalesce(keywords, []), [CASE scene WHEN 'document_or_screen' THEN 'document' WHEN 'interior' THEN 'indoors' WHEN 'people_portrait' THEN 'portrait' ELSE scene END]), [{_list(fixed.UNPLACEABLE)}])",
    "clock_tags": f"WITH t AS (SELECT content_key, min(taken_ts) AS ts FROM photos GROUP BY content_key), r AS (SELECT record_id, coalesce(keywords, []) AS kw, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) < 6 THEN 'spring' WHEN month(ts) < 9 THEN 'summer' WHEN month(ts) < 12 THEN 'autumn' END AS sn, CASE WHEN hour(ts) < 6 OR hour(ts) > 20 THEN 'night' WHEN hour(ts) < 9 THEN 'early morning' WHEN hour(ts) > 17 THEN 'evening' END AS pt FROM photo_analysis JOIN t ON content_key = content_hash), l AS (SELECT record_id, CASE WHEN list_has_any(kw, [{_list(fixed.DOCUMENT_TAGS)}]) THEN kw ELSE list_concat(kw, list_filter([sn, pt], lambda x: x IS NOT NULL)) END AS l, list_has_any(kw, [{_list(fixed.DOCUMENT_TAGS)}]) AS doc FROM r) SELECT record_id, array_to_string(CASE WHEN doc THEN l ELSE list_filter(l, lambda x, i: list_position(l, x) = i)[1:{fixed.MAX_TAGS}] END, ';') AS tags FROM l",
    "clean_lists": "SELECT record_id, array_to_string(list_filter([trim(x) FOR x IN gear_visible], lambda x: x IS NOT NULL AND x <> '')[1:3], ';') AS gear FROM photo_analysis",
    "json_maps": "WITH k AS (SELECT props::JSON AS j, unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, sum(try_cast(json_extract_string(j, '$.' || key) AS BIGINT))::BIGINT AS total FROM k GROUP BY key",
    "numbers_of_text": "WITH j AS (SELECT analysis_id, payload::JSON AS p FROM analysis WHERE json_valid(payload)), v AS (SELECT analysis_id, try_cast(p->>'$.latitude' AS DOUBLE) AS lat, try_cast(p->>'$.elevation_m' AS DOUBLE) AS elevation FROM j) SELECT * FROM v WHERE lat IS NOT NULL OR elevation IS NOT NULL",
    "content_keys": "WITH b AS (SELECT read_id, encode(text) AS b FROM ocr_text WHERE text IS NOT NULL) SELECT read_id, sha256(encode(octet_length(b)::VARCHAR) || b[1:131072] || CASE WHEN octet_length(b) > 262144 THEN b[octet_length(b) - 131071:octet_length(b)] ELSE ''::BLOB END) AS key FROM b",
    "frame_stats": f"WITH {_PX.format(n=64)}, s AS (SELECT vec_id, {_mean('px')} AS m, {_sd('px')} AS s, {_EDGES} AS e FROM px) SELECT vec_id, round(m, 6) AS mean, round(s, 6) AS stddev, round(e, 6) AS edges, CASE WHEN s <= 8 THEN CASE WHEN m <= 24 THEN 'black' WHEN m >= 232 THEN 'white' ELSE 'blank' END END AS reason FROM s",
    "difference_hashes": f"WITH {_PX.format(n=72)}, b AS (SELECT vec_id, [CASE WHEN px[(i // 8) * 9 + i % 8 + 1] > px[(i // 8) * 9 + i % 8 + 2] THEN 1 ELSE 0 END FOR i IN range(0, 64)] AS b FROM px) SELECT vec_id, (list_sum([(b[i + 1]::HUGEINT << (63 - i)) FOR i IN range(1, 64)])::HUGEINT - b[1]::HUGEINT * 9223372036854775808)::BIGINT AS h FROM b",
    "scenic_scores": f"WITH {_PX.format(n=64)}, s AS (SELECT vec_id, greatest(0.0, ({_mean('px[1:16]')} - {_mean('px[17:64]')}) / 128.0) AS br, greatest(0.0, ({_sd('px[17:64]')} - {_sd('px[1:16]')}) / 64.0) AS sm, {_EDGES} AS e FROM px) SELECT vec_id, round(2.0 * least(1.0, br + sm * 0.6::DOUBLE) + greatest(0.0, least(1.0, e / 18.0)) * CASE WHEN e > 26 THEN 0.6::DOUBLE ELSE 1 END + 0.35::DOUBLE, 6) AS score FROM s",
    "text_reads": "WITH k AS (SELECT DISTINCT content_key AS content_hash FROM photos WHERE content_key IS NOT NULL), r AS (SELECT content_hash, coalesce(arg_max(coalesce(text, ''), read_id), '') AS text FROM ocr_text WHERE content_hash <> '' GROUP BY content_hash) SELECT content_hash, CASE WHEN text IS NULL THEN 'never read' WHEN trim(text, ' ') = '' THEN 'no text' ELSE 'text' END AS state, len(text) AS chars FROM k LEFT JOIN r USING (content_hash)",
    "embedding_reads": "WITH l AS (SELECT content_hash, max({'t': made_at, 'm': model, 'd': dims, 'n': len(vector)}) AS r FROM clip_embedding WHERE content_hash IS NOT NULL GROUP BY content_hash) SELECT content_hash, r.d AS dims FROM l WHERE r.m = 'vit-small-q128' AND r.n = r.d",
    "tag_rows_read": "WITH j AS (SELECT analysis_id, payload::JSON AS p FROM analysis WHERE json_valid(payload)) SELECT analysis_id, CASE WHEN json_type(p, '$.keywords') = 'ARRAY' THEN json_array_length(p, '$.keywords') END AS n FROM j WHERE (p->>'$.keywords') IS NOT NULL",
    "pages_by_score": _DOT.format(n=5, scale=100) + ", r AS (SELECT vec_id, round(sum(e) FILTER (k <= 2) / sum(e), 6) AS score FROM x GROUP BY vec_id) SELECT * FROM r WHERE score >= 0.5",
    "paperwork_scores": _DOT.format(n=7, scale=30) + ", r AS (SELECT vec_id, round(1 - sum(e) FILTER (k <= 3) / sum(e), 6) AS score FROM x GROUP BY vec_id) SELECT *, score >= 0.9 AS paperwork FROM r",
    "result_lines": f"WITH {_INNER} SELECT analysis_id, CASE WHEN r IS NULL THEN 'corrupt line' WHEN j IS NOT NULL THEN 'analysis' ELSE 'unparseable response' END AS outcome FROM jj",
    "reclaimed_results": "WITH a AS (SELECT source_path, count(*) AS results FROM analysis GROUP BY source_path) SELECT coalesce(source_path IN (SELECT source_path FROM photos WHERE source_path IS NOT NULL), false) AS has_photo, count(*) AS paths, sum(results)::BIGINT AS results FROM a GROUP BY 1",
    "reply_records": f"WITH {_INNER} SELECT analysis_id, {', '.join(f'{_text(k)} AS {k}' for k in RECORD['text'])}, {', '.join(f'try_cast(j->>{chr(39)}$.{k}{chr(39)} AS DOUBLE) AS {k}' for k in RECORD['number'])}, {', '.join(f'coalesce(try_cast(j->>{chr(39)}$.{k}{chr(39)} AS BOOLEAN), false) AS {k}' for k in RECORD['truth'])}, {', '.join(_items(k) for k in RECORD['list'])}, {', '.join(_closed(k) for k in CLOSED)}, substring(upper({_text('country_code')}), 1, 2) AS country_code FROM jj WHERE j IS NOT NULL",
    "stored_columns": f"SELECT analysis_id, {', '.join(f'p->>{chr(39)}$.{k}{chr(39)} AS {k}' for k in ('rock_type', 'season', 'time_of_day', 'sharpness', 'crag_name', 'locality', 'evidence_basis', 'caption'))}, try_cast(p->>'$.aesthetic_score' AS DOUBLE) AS score, (p->>'$.is_guidebook_page') = 'true' AS guidebook FROM (SELECT analysis_id, payload::JSON AS p FROM analysis WHERE json_valid(payload))",
    "facets_all": f"WITH {_PUBLIC}, f AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS field, {c} AS value FROM pub' for c in sorted(set(FILTERS.values())))}) SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank FROM f WHERE value IS NOT NULL GROUP BY field, value QUALIFY rank <= 60",
    "match_count": _BM25 + "SELECT count(*) AS matches, count(*) FILTER (activity = 'hiking') AS filtered FROM bm JOIN pub USING (record_id)",
    "search_page": _BM25 + "SELECT record_id, score, activity FROM bm JOIN pub USING (record_id) WHERE aesthetic_score >= 2 AND list_contains(climbing_grades, '6b') ORDER BY score DESC, record_id LIMIT 20",
    "search_index": LIBRARY["search_bm25"],
    "stream_merge": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "gazetteer_roundtrip": "SELECT country, count(*) AS n, sum(elevation)::BIGINT AS heights, sum(len(aliases))::BIGINT AS aliases FROM peaks GROUP BY country",
}
