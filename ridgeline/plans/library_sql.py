"""DuckDB SQL of the library queries that SQL can express, written from their
meaning over the whole tables."""

from __future__ import annotations

from ridgeline.functions import fixed

_LP = "lp AS (SELECT * FROM photos QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY scanned_at DESC NULLS LAST, scan_row_id DESC) = 1)"
_BASE = "regexp_extract({}, '([^/\\\\]*)$', 1)"
_base = _BASE.format
_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_PATHS = "paths AS (SELECT source_path AS path, size_bytes FROM photos UNION ALL SELECT export_file, NULL FROM store_file), named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths), cut AS (SELECT *, lower(regexp_extract(base, '[^.].*(\\.[^.]*)$', 1)) AS ext FROM named), judged AS (SELECT *, CASE WHEN base LIKE '.%' THEN 'hidden file' WHEN ext = '' THEN 'no extension' WHEN ext NOT IN (" + _list(fixed.STANDARD_IMAGES + fixed.RAW_IMAGES) + ") THEN 'not an image' END AS reason FROM cut)"
_NAMED_TS = "try_cast(CASE WHEN regexp_extract(f, p, 1) <> '' THEN regexp_extract(f, p, 1) || '-' || regexp_extract(f, p, 2) || '-' || regexp_extract(f, p, 3) || ' ' || coalesce(nullif(regexp_extract(f, p, 4), ''), '00') || ':' || coalesce(nullif(regexp_extract(f, p, 5), ''), '00') || ':' || coalesce(nullif(regexp_extract(f, p, 6), ''), '00') END AS TIMESTAMP)".replace(" p,", " '" + fixed.FILENAME_DATE + "',")
_FOLD = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"
_fold = _FOLD.format
_NORMAL = "trim(regexp_replace(regexp_replace(lower(" + _FOLD + "), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_normal = _NORMAL.format
_SLUG = "regexp_replace(substring(regexp_replace(regexp_replace(" + _FOLD + ", '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '')"
_slug = _SLUG.format


def _label(x: str, n: int = 60) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace({_fold(x)}, '[<>:\"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '[\\s._-]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"regexp_replace(substring(CASE WHEN upper({plain}) IN ({_list(fixed.RESERVED_NAMES)}) THEN {plain} || '_place' ELSE {plain} END, 1, {n}), '[_. ]+$', '')"


_WORDS = "list_filter(string_split({0}, ' '), lambda w: len(w) > 1)"
_TOKENS = "CASE WHEN len(list_filter({0}, lambda w: w NOT IN ({1}))) > 0 THEN list_filter({0}, lambda w: w NOT IN ({1})) ELSE {0} END"


def _tokens(x: str) -> str:
    return _TOKENS.format(_WORDS.format(x), _list(fixed.STOPWORDS))


_H = "(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))"
_KM = "2 * 6371.0088 * asin(sqrt(CASE WHEN " + _H + " > 1 THEN 1.0 ELSE " + _H + " END))"
_km = _KM.format
_tenths = lambda u: f"(round(gap / {u}.0)::BIGINT // 10) || '.' || (round(gap / {u}.0)::BIGINT % 10)"
_GAP = f"(CASE WHEN gap < 172800 THEN {_tenths(360)} || 'h' WHEN gap < 5184000 THEN {_tenths(8640)} || ' days' ELSE round(gap / 86400.0)::BIGINT || ' days' END)"
_SESSIONS = f"""{_LP},
o AS (SELECT *, lag(taken_ts) OVER w AS prev_ts, row_number() OVER w AS rn, max((taken_ts IS NOT NULL)::INT) OVER (PARTITION BY top_folder) AS dated FROM lp WINDOW w AS (PARTITION BY top_folder ORDER BY taken_ts ASC NULLS LAST, source_path)),
g AS (SELECT *, (epoch_us(taken_ts) - epoch_us(prev_ts)) / 1e6 AS gap FROM o),
t AS (SELECT *, (coalesce(gap > 43200, false) OR (taken_ts IS NULL AND rn > 1 AND dated = 1)) AS tsplit FROM g),
u AS (SELECT *, sum(tsplit::INT) OVER (PARTITION BY top_folder ORDER BY taken_ts ASC NULLS LAST, source_path ROWS UNBOUNDED PRECEDING) AS seg FROM t),
f AS (SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN {{'a': lat, 'b': lon}} END AS fix FROM u),
l AS (SELECT *, last_value(fix IGNORE NULLS) OVER (PARTITION BY top_folder, seg ORDER BY taken_ts ASC NULLS LAST, source_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM f),
j AS (SELECT *, coalesce(NOT tsplit AND {_km("lf.a", "lf.b", "fix.a", "fix.b")} > 15 AND gap >= 1200, false) AS jsplit FROM l),
sess AS (SELECT *, (sum((tsplit OR jsplit)::INT) OVER (PARTITION BY top_folder ORDER BY taken_ts ASC NULLS LAST, source_path ROWS UNBOUNDED PRECEDING) + 1)::BIGINT AS session_no,
  CASE WHEN tsplit AND taken_ts IS NULL THEN 'no timestamp' WHEN tsplit THEN 'time gap ' || {_GAP} WHEN jsplit THEN 'location jump ' || round({_km("lf.a", "lf.b", "fix.a", "fix.b")})::BIGINT || 'km' END AS reason FROM j)"""
_SUMMARY = _SESSIONS + """,
cam AS (SELECT top_folder, session_no, trim(camera_model) AS cam, min({'n': taken_ts IS NULL, 't': taken_ts, 'p': source_path}) AS first_use FROM sess WHERE trim(camera_model) <> '' GROUP BY ALL),
cams AS (SELECT top_folder, session_no, string_agg(cam, ', ' ORDER BY first_use.n, first_use.t, first_use.p) AS cameras FROM cam GROUP BY ALL),
agg AS (SELECT top_folder, session_no, min(taken_ts) AS start_ts, max(taken_ts) AS end_ts, count(*) AS items, count(*) FILTER (lat IS NULL OR lon IS NULL) AS no_position,
  count(*) FILTER (coalesce(timestamp_source <> 'exif', true)) AS no_exif_time, sum(size_bytes)::BIGINT AS bytes FROM sess GROUP BY ALL),
summary AS (SELECT agg.*, coalesce(cameras, '') AS cameras FROM agg LEFT JOIN cams USING (top_folder, session_no))"""
_PUBLIC = "pub AS (SELECT * FROM photo_analysis WHERE NOT coalesce(is_personal_document, false))"
_BODY = _PUBLIC + """, bodies AS (SELECT record_id, concat_ws(' ', coalesce(caption, ''), coalesce(notes, ''), coalesce(visible_text, ''), coalesce(route_name, ''), coalesce(verified_peak, ''), coalesce(peak_name, ''), coalesce(mountain_range, ''), coalesce(region, ''),
  coalesce(array_to_string(keywords, ' '), ''), coalesce(array_to_string(place_names_visible, ' '), ''), coalesce(array_to_string(climbing_grades, ' '), '')) AS body FROM pub),
toks AS (SELECT record_id, list_filter(string_split(regexp_replace(""" + _fold("lower(body)") + """, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS t FROM bodies), live AS (SELECT record_id, t, len(t) AS length FROM toks WHERE len(t) > 0),
size AS (SELECT count(*) AS n, avg(length) AS mean FROM live), post AS (SELECT record_id, length, unnest(t) AS token FROM live), tf AS (SELECT record_id, token, length, count(*) AS tf FROM post WHERE token IN ('storm', 'after') GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm AS (SELECT record_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (token), size GROUP BY record_id HAVING count(*) = 2)"""
_STRENGTH = "least(0.95::DOUBLE, (CASE basis WHEN 'sign_in_scene' THEN 0.92 WHEN 'printed_page' THEN 0.72 WHEN 'landmark_recognition' THEN 0.28 ELSE CASE WHEN basis IS NULL OR basis IN ('none', 'generic_inference', '') THEN 0.28 ELSE 0 END END)::DOUBLE * (CASE confidence WHEN 'high' THEN 1.1 WHEN 'low' THEN 0.9 ELSE 1.0 END)::DOUBLE)"
_CLAIMS = "claims AS (SELECT record_id, mountain_range AS session, verified_peak AS peak, evidence_basis AS basis, location_confidence AS confidence, verified_lat AS lat, verified_lon AS lon, latitude, longitude FROM photo_analysis WHERE mountain_range IS NOT NULL)"
_KEEP = "coalesce(width::BIGINT * height, 0) DESC, coalesce(size_bytes, -1) DESC, (coalesce(timestamp_source, '') = 'exif')::INT DESC, (lat IS NOT NULL AND lon IS NOT NULL)::INT DESC, source_path"
_ONLY_ROLES = f"k AS (SELECT *, count(*) OVER (PARTITION BY content_key) AS n, first_value(source_path) OVER (PARTITION BY content_key ORDER BY {_KEEP}) AS keeper FROM lp WHERE content_key IS NOT NULL), roles AS (SELECT source_path, CASE WHEN source_path = keeper THEN 'keep' ELSE 'exact' END AS role, CASE WHEN source_path <> keeper THEN keeper END AS duplicate_of FROM k WHERE n > 1)"
_ROLES = f"{_LP}, {_ONLY_ROLES}"
_SPELL = f"spell AS (SELECT DISTINCT peak_id, elevation, lat, lon, {_normal('name')} AS normal FROM (SELECT peak_id, elevation, lat, lon, unnest(list_concat([peak_name], coalesce(aliases, []))) AS name FROM peaks WHERE coalesce(lat BETWEEN 35 AND 81 AND lon BETWEEN -25 AND 45, true)) WHERE name IS NOT NULL AND {_normal('name')} <> '')"
_RATIO = "CASE WHEN {0} = {1} THEN 1.0 WHEN len({0}) = 0 OR len({1}) = 0 OR abs(len({0}) - len({1})) / greatest(len({0}), len({1})) > 0.5 THEN 0.0 ELSE 1.0 - levenshtein({0}, {1}) / greatest(len({0}), len({1}))::DOUBLE END"
_HASHES = """v AS (SELECT content_hash AS item, arg_max(vector, made_at) AS v FROM clip_embedding WHERE content_hash IS NOT NULL AND len(vector) >= 64 GROUP BY content_hash), tk AS (SELECT content_key, epoch_us(min(taken_ts)) AS t FROM photos GROUP BY content_key),
hs AS (SELECT item, t, list_reduce(list_prepend(0::UBIGINT, [CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END FOR x IN v[1:64]]), lambda h, x: (h << 1) | x) AS h FROM v LEFT JOIN tk ON content_key = item),
us AS (SELECT *, min(item) OVER (PARTITION BY h, floor(t / 86400000000.0)) AS cl FROM hs WHERE bit_count(h) BETWEEN 12 AND 52)"""
_MEMBERS = "latest AS (SELECT group_id, arg_max(kind, found_at) AS kind, arg_max(photos, found_at) AS photos FROM dup_group WHERE group_id IS NOT NULL GROUP BY group_id), members AS (SELECT DISTINCT group_id, kind, source_path FROM (SELECT group_id, kind, unnest(photos) AS source_path FROM latest) WHERE source_path IS NOT NULL)"
_ROUTES = f"""WITH {_SESSIONS}, {_ONLY_ROLES}, {_MEMBERS},
nk AS (SELECT m.group_id, m.source_path, first_value(m.source_path) OVER (PARTITION BY m.group_id ORDER BY {_KEEP.replace("source_path", "m.source_path")}) AS keeper FROM members m JOIN lp USING (source_path) WHERE kind = 'near'),
nall AS (SELECT m.group_id, m.source_path, k.keeper FROM members m JOIN (SELECT DISTINCT group_id, keeper FROM nk) k USING (group_id) WHERE kind = 'near' AND m.source_path <> k.keeper), near AS (SELECT source_path, arg_min(keeper, group_id) AS keeper FROM nall GROUP BY source_path),
ev AS (SELECT source_path, size_bytes, reject_reason, coalesce(strftime(min(taken_ts) OVER (PARTITION BY top_folder, session_no), '%Y'), '0000') || '/' || {_label("top_folder")} || '_Event' || CASE WHEN session_no < 1000 THEN lpad(session_no::VARCHAR, 3, '0') ELSE session_no::VARCHAR END AS event, regexp_extract(source_path, '([^/]*)$', 1) AS base FROM sess),
kp AS (SELECT ev.*, coalesce(roles.duplicate_of, near.keeper) AS keeper FROM ev LEFT JOIN roles ON roles.source_path = ev.source_path AND role = 'exact' LEFT JOIN near ON near.source_path = ev.source_path),
rt AS (SELECT kp.*, CASE WHEN kp.reject_reason IS NOT NULL THEN 'rejected' WHEN kp.keeper IS NOT NULL THEN 'duplicate' ELSE 'normal' END AS route, k2.event AS keeper_event FROM kp LEFT JOIN ev k2 ON k2.source_path = kp.keeper),
nm AS (SELECT source_path, size_bytes, route, CASE route WHEN 'rejected' THEN 'rejected/' || reject_reason WHEN 'duplicate' THEN coalesce(keeper_event, event) ELSE event END AS folder, CASE route WHEN 'duplicate' THEN regexp_replace(base, '(.)\\.[^.]*$', '\\1') || '_duplicate' || regexp_extract(base, '.(\\.[^.]*)$', 1) ELSE base END AS name FROM rt),
pt AS (SELECT *, regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) AS st, regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) AS ex, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY route = 'duplicate', source_path) AS n FROM nm),
cl AS (SELECT folder, regexp_extract(lower(st), '^(.*)_([1-9][0-9]{{0,8}})$', 1) AS s0, lower(ex) AS e0, try_cast(regexp_extract(lower(st), '^(.*)_([1-9][0-9]{{0,8}})$', 2) AS BIGINT) AS t FROM pt),
tn AS (SELECT folder, s0, e0, list_sort(list(DISTINCT t)) AS ts FROM cl WHERE t >= 2 GROUP BY ALL),
routes AS (SELECT pt.source_path, size_bytes, route, pt.folder || '/' || CASE WHEN n = 1 THEN name ELSE st || '_' || list_reduce(list_prepend(n, coalesce(ts, [])), lambda x, t: CASE WHEN t <= x THEN x + 1 ELSE x END) || ex END AS dest FROM pt LEFT JOIN tn ON tn.folder = pt.folder AND s0 = lower(st) AND e0 = lower(ex))"""



def _tags() -> str:
    """Tags from the softmax of each facet's prompts: labels share their prompts' probabilities, the first of the most probable ones counts from its threshold on."""
    n = sum(len(x) for _, x in fixed.FACETS.values()) + 2 * len(fixed.BINARY)
    at, facets = 1, []
    for name, (threshold, labels) in fixed.FACETS.items():
        part = f"s[{at}:{at + len(labels) - 1}]"
        shares = [f"list_sum([e_{name}[k] FOR k IN {[k for k, x in enumerate(labels, 1) if x == label]}]) / list_sum(e_{name})" for label in dict.fromkeys(labels)]
        values = [f"'{label}'" if label else "NULL" for label in dict.fromkeys(labels)]
        facets.append((name, f"[exp(x - list_max({part})) FOR x IN {part}] AS e_{name}", f"[{', '.join(shares)}] AS p_{name}", f"CASE WHEN list_max(p_{name}) >= {threshold}::DOUBLE THEN ([{', '.join(values)}])[list_position(p_{name}, list_max(p_{name}))] END AS {name}"))
        at += len(labels)
    pairs = []
    for k, (name, threshold) in enumerate(fixed.BINARY.items()):
        pairs.append(f"CASE WHEN 1 / (1 + exp(s[{at + 2 * k + 1}] - s[{at + 2 * k}])) >= {threshold}::DOUBLE THEN '{name}' END")
    return f"""WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT {n}),
a AS (SELECT e.vec_id, list({fixed.SOFTMAX_SCALE}::DOUBLE * list_dot_product(e.embedding::DOUBLE[], p.v) ORDER BY k) AS s FROM embeddings e, p GROUP BY e.vec_id),
b AS (SELECT *, {", ".join(f[1] for f in facets)} FROM a), c AS (SELECT *, {", ".join(f[2] for f in facets)} FROM b), d AS (SELECT vec_id, {", ".join(f[3] for f in facets)}, list_filter([{", ".join(pairs)}], lambda x: x IS NOT NULL) AS weather FROM c),
f AS (SELECT vec_id, subject, coalesce(subject IN ({_list(fixed.DOCUMENT_TAGS)}), false) AS paper, people, activity, terrain, weather FROM d),
g AS (SELECT vec_id, CASE WHEN paper THEN NULL ELSE people END AS people, CASE WHEN paper OR people IS NULL THEN NULL ELSE activity END AS activity, CASE WHEN paper THEN NULL ELSE terrain END AS terrain, subject, CASE WHEN paper OR terrain = 'indoors' THEN [] ELSE weather END AS weather FROM f),
h AS (SELECT vec_id, people, list_filter(list_concat([activity, terrain, subject], weather), lambda x: x IS NOT NULL) AS l FROM g),
i AS (SELECT vec_id, CASE WHEN people IS NOT NULL AND NOT list_contains(l, 'portrait') THEN list_append(l, people) ELSE l END AS l FROM h)
SELECT vec_id, array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k)[1:{fixed.MAX_TAGS}], ',') AS tags FROM i"""


SQL: dict[str, str] = {
    "scan_skip_reasons": f"WITH {_PATHS} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason",
    "survey_by_ext": f"WITH {_PATHS} SELECT ext, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM judged GROUP BY ext",
    "count_images": f"WITH {_PATHS} SELECT count(*) FILTER (reason IS NULL) AS images FROM judged",
    "filename_datetime": f"SELECT scan_row_id, {_NAMED_TS} AS named_ts FROM (SELECT scan_row_id, regexp_extract(source_path, '([^/]*)$', 1) AS f FROM photos)",
    "timestamp_fallback": f"WITH x AS (SELECT scan_row_id, scanned_at, CASE WHEN timestamp_source = 'exif' THEN taken_ts END AS e, {_NAMED_TS} AS n FROM (SELECT *, regexp_extract(source_path, '([^/]*)$', 1) AS f FROM photos)) SELECT scan_row_id, coalesce(e, n, scanned_at) AS ts, CASE WHEN e IS NOT NULL THEN 'exif' WHEN n IS NOT NULL THEN 'filename' WHEN scanned_at IS NOT NULL THEN 'mtime' ELSE 'none' END AS source FROM x",
    "camera_labels": "WITH c AS (SELECT nullif(trim(camera_make), '') AS mk, nullif(trim(camera_model), '') AS md FROM photos) SELECT CASE WHEN mk IS NULL OR starts_with(lower(md), lower(mk)) THEN md WHEN md IS NULL THEN mk ELSE mk || ' ' || md END AS camera, count(*) AS n FROM c GROUP BY ALL",
    "dms_to_degrees": "WITH p AS (SELECT scan_row_id, lat, floor(abs(lat)) AS d, floor((abs(lat) - floor(abs(lat))) * 60) AS m FROM photos WHERE lat IS NOT NULL), q AS (SELECT *, round((abs(lat) - d - m / 60) * 3600, 3) AS s FROM p) SELECT scan_row_id, round((d + m / 60 + s / 3600) * (CASE WHEN lat < 0 THEN -1 ELSE 1 END), 6) AS degrees FROM q",
    "gps_text": "WITH p AS (SELECT record_id, abs(latitude) AS a FROM photo_analysis WHERE NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180), q AS (SELECT *, floor(a) AS d, floor((a - floor(a)) * 60) AS m FROM p) SELECT record_id, d::BIGINT || '/1 ' || m::BIGINT || '/1 ' || round((a - d - m / 60) * 3600 * 100)::BIGINT || '/100' AS lat_text FROM q",
    "season_timeofday": "SELECT CASE WHEN month(taken_ts) IN (12, 1, 2) THEN 'winter' WHEN month(taken_ts) < 6 THEN 'spring' WHEN month(taken_ts) < 9 THEN 'summer' ELSE 'autumn' END AS season, CASE WHEN hour(taken_ts) < 6 OR hour(taken_ts) > 20 THEN 'night' WHEN hour(taken_ts) < 9 THEN 'early morning' WHEN hour(taken_ts) > 17 THEN 'evening' END AS part, count(*) AS n FROM photos WHERE taken_ts IS NOT NULL GROUP BY ALL",
    "name_normalise": f"WITH n AS (SELECT peak_id, peak_name, {_normal('peak_name')} AS normal FROM peaks) SELECT peak_id, normal, array_to_string({_tokens('normal')}, ' ') AS words, {_slug('peak_name')} AS slug, {_label('peak_name')} AS label FROM n",
    "specific_names": f"WITH w AS (SELECT peak_id, peak_name, list_filter([regexp_replace(x, '^[-–—]+|[-–—]+$', '', 'g') FOR x IN regexp_split_to_array(trim(peak_name), '\\s+')], lambda x: x <> '') AS ws FROM peaks) SELECT peak_id, coalesce((len(ws) >= 2 OR (len(ws) = 1 AND len(peak_name) >= 11)) AND len(list_filter(ws, lambda x: len(x) >= 5 AND lower(x) NOT IN ({_list(fixed.ARTICLES + fixed.GENERIC)}))) > 0, false) AS specific FROM w",
    "route_grades": "WITH r AS (SELECT record_id, concat_ws(' ', route_name, '(' || list_concat(climbing_grades, ['3275 m'])[1] || ')') AS t, route_name FROM photo_analysis WHERE route_name IS NOT NULL AND caption IS NOT NULL) SELECT record_id, coalesce(len(route_name) > 0 AND regexp_matches(t, '(?i)' || regexp_escape(route_name) || '[\\s:.,\\-]{0,4}\\(?" + fixed.GRADE + "([^A-Za-z0-9.,]|$)'), false) AS graded FROM r",
    "blacklist_words": "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), x AS (SELECT doc_id, list_filter(['private', 'wanted', 'road', 'schnee', 'corda', 'pierres'], lambda t: list_contains(ws, t))[1] AS word FROM d) SELECT * FROM x WHERE word IS NOT NULL",
    "text_rank": "WITH r AS (SELECT record_id, country_code, len(regexp_extract_all(visible_text, '[A-Za-zÀ-ɏ]{4,}')) AS words FROM photo_analysis) SELECT record_id, country_code, words, row_number() OVER (PARTITION BY country_code ORDER BY words DESC, record_id) AS rank FROM r WHERE words >= 3 AND country_code IS NOT NULL QUALIFY rank <= 6",
    "size_labels": "SELECT CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1024 ** 2 THEN printf('%.1f KB', round(size_bytes / 1024.0::DOUBLE, 1)) WHEN size_bytes < 1024 ** 3 THEN printf('%.1f MB', round(size_bytes / (1024.0 ** 2), 1)) ELSE printf('%.1f GB', round(size_bytes / (1024.0 ** 3), 1)) END AS size, count(*) AS n FROM photos WHERE size_bytes IS NOT NULL GROUP BY ALL",
    "json_columns": "WITH j AS (SELECT analysis_id, payload::JSON AS p FROM analysis WHERE json_valid(payload)) SELECT analysis_id, p->>'$.rock_type' AS rock, p->>'$.crag_name' AS crag, p->>'$.locality' AS locality, p->>'$.evidence_basis' AS basis FROM j",
    "enum_coercion": f"WITH v AS (SELECT regexp_replace(lower(trim(activity)), '\\s+', '_', 'g') AS a, regexp_replace(lower(trim(evidence_basis)), '\\s+', '_', 'g') AS b, regexp_replace(lower(trim(location_confidence)), '\\s+', '_', 'g') AS c FROM photo_analysis) SELECT CASE WHEN a IN ({_list(fixed.ACTIVITIES)}) THEN a ELSE 'unknown' END AS activity, CASE WHEN b = 'text_in_image' THEN 'printed_page' WHEN b IN ({_list(fixed.EVIDENCE_BASIS)}) THEN b ELSE 'none' END AS basis, CASE WHEN c IN ({_list(fixed.CONFIDENCE)}) THEN c ELSE 'low' END AS confidence, count(*) AS n FROM v GROUP BY ALL",
    "versioned_reparse": "WITH a AS (SELECT analysis_id, schema_version, CASE WHEN json_valid(payload) THEN payload::JSON END AS p, CASE WHEN json_valid(raw_response) THEN raw_response::JSON END AS r FROM analysis), t AS (SELECT *, coalesce((r->>'$.response.candidates[0].content.parts[0].text'), (r->>'$.candidates[0].content.parts[0].text')) AS w, ((r->'$.response') IS NOT NULL OR (r->'$.candidates') IS NOT NULL) AS wrapped FROM a), u AS (SELECT *, CASE WHEN w IS NOT NULL THEN regexp_replace(w, '^\\s*```[A-Za-z]*\\s*|\\s*```\\s*$', '', 'g') WHEN NOT wrapped THEN r::VARCHAR END AS o FROM t) SELECT analysis_id, CASE WHEN schema_version = 4 THEN (p->>'$.country_code') ELSE ((CASE WHEN json_valid(o) THEN o::JSON END)->>'$.country_code') END AS country_code FROM u",
    "keywords_builder": "WITH a AS (SELECT record_id, list_concat([activity, scene, season, time_of_day, mountain_range, coalesce(nullif(verified_peak, ''), peak_name), crag_name, route_name, region, country, rock_type, weather], coalesce(climbing_grades, []), coalesce(keywords, []), CASE WHEN is_guidebook_page THEN ['guidebook'] ELSE [] END, CASE WHEN is_personal_document THEN ['personal-document'] ELSE [] END) AS l FROM photo_analysis), b AS (SELECT record_id, list_filter([trim(x) FOR x IN l IF x NOT IN ('unknown', 'none')], lambda x: x <> '') AS l FROM a), c AS (SELECT record_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM b) SELECT record_id, array_to_string(l[1:40], ';') AS tags FROM c",
    "safe_text": "WITH j AS (SELECT record_id, is_personal_document, array_to_string(list_filter(list_concat(coalesce(place_names_visible, []), [visible_text]), lambda x: x IS NOT NULL), chr(10)) AS s FROM photo_analysis) SELECT record_id, CASE WHEN NOT coalesce(is_personal_document, false) AND s <> '' THEN s END AS shown FROM j",
    "filter_set": f"WITH {_PUBLIC} SELECT record_id, activity, aesthetic_score FROM pub WHERE activity = 'hiking' AND aesthetic_score >= 3",
    "grade_semi_join": f"WITH {_PUBLIC} SELECT record_id FROM pub WHERE list_contains(climbing_grades, '6b')",
    "pending_keys": "SELECT DISTINCT content_key FROM photos WHERE content_key IS NOT NULL AND content_key NOT IN (SELECT content_hash FROM photo_analysis WHERE content_hash IS NOT NULL)",
    "multi_get": "SELECT record_id, content_hash FROM photo_analysis WHERE content_hash IN (SELECT content_key FROM photos WHERE source_path IN (SELECT p FROM (SELECT unnest(photos) AS p FROM dup_group) WHERE p IS NOT NULL))",
    "facets": f"WITH {_PUBLIC}, f AS (SELECT 'activity' AS field, activity AS value FROM pub UNION ALL SELECT 'scene', scene FROM pub UNION ALL SELECT 'region', region FROM pub UNION ALL SELECT 'mountain_range', mountain_range FROM pub UNION ALL SELECT 'verified_peak', verified_peak FROM pub UNION ALL SELECT 'country_code', country_code FROM pub UNION ALL SELECT 'season', season FROM pub) SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank FROM f WHERE value IS NOT NULL GROUP BY field, value QUALIFY rank <= 60",
    "store_stats": "SELECT count(*) AS photos, count(DISTINCT verified_peak) FILTER (NOT coalesce(is_personal_document, false)) AS peaks, count(DISTINCT mountain_range) FILTER (NOT coalesce(is_personal_document, false)) AS ranges, count(*) FILTER (coalesce(is_personal_document, false)) AS personal, (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT model AS m FROM photo_analysis WHERE model IS NOT NULL)) AS models FROM photo_analysis",
    "side_counts": "SELECT 'ocr_text' AS kind, count(*) AS n FROM ocr_text UNION ALL SELECT 'clip_embedding', count(vector) FROM clip_embedding",
    "search_list_page": f"WITH {_LP} SELECT source_path, taken_ts FROM lp ORDER BY taken_ts DESC NULLS LAST, source_path LIMIT 200 OFFSET 100",
    "search_bm25": f"WITH {_BODY} SELECT record_id, score FROM bm",
    "search_phrase": f"WITH {_BODY} SELECT record_id FROM live WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' after the storm ')",
    "search_with_grades": f"WITH {_BODY}, page AS (SELECT record_id, score FROM bm ORDER BY score DESC, record_id LIMIT 50), gr AS (SELECT record_id, string_agg(g, ',' ORDER BY g) AS grades FROM (SELECT DISTINCT record_id, unnest(climbing_grades) AS g FROM photo_analysis) WHERE g IS NOT NULL AND g <> '' GROUP BY record_id) SELECT page.*, grades FROM page LEFT JOIN gr USING (record_id)",
    "session_items": f"WITH {_SESSIONS} SELECT source_path, session_no, reason FROM sess",
    "session_summary": f"WITH {_SUMMARY} SELECT top_folder, session_no, start_ts, end_ts, items, no_position, no_exif_time, bytes, cameras FROM summary",
    "small_sessions": f"WITH {_SUMMARY} SELECT * FROM (SELECT top_folder, session_no, concat_ws('; ', CASE WHEN items < 3 THEN 'fewer than 3 photos' END, CASE WHEN start_ts IS NULL THEN 'no timestamps' END) AS notes, CASE WHEN start_ts IS NULL THEN 'no date' WHEN start_ts::DATE = end_ts::DATE THEN strftime(start_ts, '%Y-%m-%d') ELSE strftime(start_ts, '%Y-%m-%d') || ' to ' || strftime(end_ts, '%Y-%m-%d') END AS dates FROM summary) WHERE notes <> ''",
    "topk_scenic": f"WITH {_SESSIONS} SELECT source_path, row_number() OVER (PARTITION BY top_folder, session_no ORDER BY scenic_score DESC NULLS LAST, taken_ts ASC NULLS FIRST, source_path) AS rank FROM sess QUALIFY rank <= 4",
    "even_sampling": f"WITH {_LP}, r AS (SELECT source_path, count(*) OVER (PARTITION BY top_folder) AS n, row_number() OVER (PARTITION BY top_folder ORDER BY taken_ts ASC NULLS LAST, source_path) - 1 AS place FROM lp) SELECT source_path FROM r WHERE n <= 5 OR place IN (0, floor(n / 5), floor(2 * n / 5), floor(3 * n / 5), floor(4 * n / 5))",
    "plurality_vote": "WITH v AS (SELECT country_code, activity, count(*) AS votes, min(record_id) AS f FROM photo_analysis WHERE activity NOT IN ('unknown', 'none') AND activity <> '' AND country_code IS NOT NULL GROUP BY ALL) SELECT country_code, activity, votes FROM v QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY votes DESC, f) = 1",
    "activity_quorum": "WITH n AS (SELECT mountain_range, count(*) AS n FROM photo_analysis WHERE mountain_range IS NOT NULL GROUP BY 1), v AS (SELECT mountain_range, activity, count(*) AS votes, min(record_id) AS f FROM photo_analysis WHERE activity NOT IN ('unknown', 'none') AND activity <> '' AND mountain_range IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY mountain_range ORDER BY votes DESC, f) = 1) SELECT mountain_range, activity, votes FROM b JOIN n USING (mountain_range) WHERE votes >= greatest(3, 0.2 * n)",
    "name_collisions": f"WITH l AS (SELECT peak_id, country, {_label('peak_name', 8)} AS label FROM peaks), r AS (SELECT peak_id, label, row_number() OVER (PARTITION BY country, lower(label) ORDER BY peak_id) AS k FROM l WHERE label <> '') SELECT peak_id, CASE WHEN k = 1 THEN label ELSE regexp_extract(label, '^(.*?)(\\.[^.]*)?$', 1) || '_' || k || regexp_extract(label, '^(.*?)(\\.[^.]*)?$', 2) END AS folder FROM r",
    "dest_collisions": f"WITH {_LP}, b AS (SELECT source_path, top_folder, regexp_extract(source_path, '([^/]*)$', 1) AS file FROM lp), r AS (SELECT *, row_number() OVER (PARTITION BY top_folder, lower(file) ORDER BY source_path) AS k FROM b) SELECT source_path, CASE WHEN k = 1 THEN file ELSE regexp_extract(file, '^(.*?)(\\.[^.]*)?$', 1) || '_' || k || regexp_extract(file, '^(.*?)(\\.[^.]*)?$', 2) END AS dest_name FROM r",
    "merge_into_previous": f"WITH {_SUMMARY} SELECT top_folder, session_no, max(CASE WHEN session_no = 1 OR items >= 3 THEN session_no END) OVER (PARTITION BY top_folder ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS surviving FROM summary",
    "folder_names": f"WITH r AS (SELECT record_id, country_code, coalesce(region, CASE WHEN lower({_slug('mountain_range')}) NOT IN ({_list(fixed.VAGUE_REGIONS)}) THEN mountain_range END) AS area, verified_peak, CASE WHEN activity NOT IN ('unknown', 'none') THEN activity END AS act FROM photo_analysis), p AS (SELECT record_id, concat_ws('_', nullif({_slug('country_code')}, ''), nullif({_slug('area')}, ''), nullif({_slug('verified_peak')}, '')) AS parts, {_slug('act')} AS a FROM r) SELECT record_id, substring(CASE WHEN a <> '' AND NOT contains(lower(parts), lower(a)) THEN concat_ws('_', nullif(parts, ''), a) ELSE parts END, 1, 60) AS folder FROM p",
    "exact_dups": f"WITH {_ROLES} SELECT * FROM roles",
    "copy_routes": f"{_ROUTES} SELECT source_path, dest FROM routes",
    "copy_counters": f"{_ROUTES} SELECT route, count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM routes GROUP BY route",
    "near_dup_pairs": f"WITH {_HASHES}, c AS (SELECT h, h >> 48 AS band, cl, min(t) AS t0, max(t) AS t1 FROM us GROUP BY h, cl) SELECT a.cl AS item_a, b.cl AS item_b, bit_count(xor(a.h, b.h))::INT AS bits FROM c a JOIN c b ON a.band = b.band AND a.cl < b.cl WHERE bit_count(xor(a.h, b.h)) <= 4 AND (a.t0 IS NULL OR b.t0 IS NULL OR greatest(b.t0 - a.t1, a.t0 - b.t1) <= 86400000000)",
    "near_dup_classes": f"WITH {_HASHES} SELECT item, cl AS first FROM us",
    "keeper_election": f"WITH {_LP}, g AS (SELECT DISTINCT group_id, unnest(photos) AS source_path FROM dup_group), r AS (SELECT * FROM photo_analysis QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY record_id) = 1), m AS (SELECT g.group_id, g.source_path, r.*, count(*) OVER (PARTITION BY g.group_id) AS n_judged FROM g JOIN lp USING (source_path) JOIN r ON r.content_hash = lp.content_key) SELECT group_id, source_path, n_judged FROM m WHERE n_judged >= 2 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY CASE sharpness WHEN 'sharp' THEN 3 WHEN 'acceptable' THEN 2 WHEN 'blurry' THEN 0 ELSE 1 END DESC, CASE gaze WHEN 'all_facing' THEN 3 WHEN 'some_facing' THEN 2 WHEN 'none_facing' THEN 0 ELSE 1 END DESC, coalesce(eyes_closed_count, 0), CASE composition WHEN 'good' THEN 3 WHEN 'ordinary' THEN 2 WHEN 'poor' THEN 0 ELSE 1 END DESC, coalesce(aesthetic_score, 0) DESC, coalesce(exposure = 'good', false)::INT DESC, source_path) = 1",
    "keeper_reelection": f"WITH {_LP}, {_MEMBERS}, r AS (SELECT * FROM photo_analysis QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY record_id) = 1), m AS (SELECT m.group_id, lp.*, r.record_id, sharpness, gaze, eyes_closed_count, composition, aesthetic_score, exposure FROM members m JOIN lp USING (source_path) LEFT JOIN r ON r.content_hash = lp.content_key), k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_KEEP}) AS k FROM m), j AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE sharpness WHEN 'sharp' THEN 3 WHEN 'acceptable' THEN 2 WHEN 'blurry' THEN 0 ELSE 1 END DESC, CASE gaze WHEN 'all_facing' THEN 3 WHEN 'some_facing' THEN 2 WHEN 'none_facing' THEN 0 ELSE 1 END DESC, coalesce(eyes_closed_count, 0), CASE composition WHEN 'good' THEN 3 WHEN 'ordinary' THEN 2 WHEN 'poor' THEN 0 ELSE 1 END DESC, coalesce(aesthetic_score, 0) DESC, coalesce(exposure = 'good', false)::INT DESC, k) AS jr, row_number() OVER (PARTITION BY group_id ORDER BY scenic_score DESC NULLS LAST, k) AS mr FROM k), g AS (SELECT group_id, arg_min(source_path, k) AS before, arg_min(source_path, jr) FILTER (record_id IS NOT NULL) AS jp, arg_min(source_path, mr) FILTER (scenic_score IS NOT NULL) AS mp, count(record_id) AS nj, count(scenic_score) AS nm FROM j GROUP BY group_id), o AS (SELECT group_id, before, CASE WHEN nj >= 2 THEN jp WHEN nm >= 2 THEN mp ELSE before END AS keeper, CASE WHEN nj >= 2 THEN 'judged' WHEN nm >= 2 THEN 'measured' ELSE 'metadata' END AS reason FROM g) SELECT *, before <> keeper AS changed FROM o",
    "alias_exact_join": f"WITH {_SPELL} SELECT DISTINCT name, peak_id FROM (SELECT DISTINCT peak_name AS name, {_normal('peak_name')} AS normal FROM photo_analysis WHERE peak_name IS NOT NULL) JOIN spell USING (normal) WHERE normal <> ''",
    "fuzzy_resolve": f"""WITH {_SPELL}, asked AS (SELECT DISTINCT name, {_normal('name')} AS q FROM (SELECT substring(peak_name, 1, 2) || substring(peak_name, 4) AS name FROM photo_analysis WHERE peak_name IS NOT NULL) WHERE {_normal('name')} <> ''),
ex AS (SELECT name, peak_id, elevation, 1.0::DOUBLE AS score FROM asked JOIN spell ON q = normal), op AS (SELECT *, list_distinct({_tokens('q')}) AS qt FROM asked WHERE name NOT IN (SELECT name FROM ex)), sp AS (SELECT *, list_distinct({_tokens('normal')}) AS ct FROM spell),
w AS (SELECT name, peak_id, elevation, {_RATIO.format('q', 'normal')} AS whole, len(qt) AS nq, len(ct) AS nc, list_sum([list_max([{_RATIO.format('x', 'y')} FOR y IN ct]) FOR x IN qt]) / len(qt) AS mean FROM op, sp),
fz AS (SELECT name, peak_id, elevation, CASE WHEN nq = 0 OR nc = 0 THEN whole ELSE greatest(whole, mean * pow(least(1.0, nq / nc::DOUBLE), 0.25)) END AS score FROM w),
al AS (SELECT name, peak_id, max(score) AS score, max(coalesce(elevation, 0)) AS elevation FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz WHERE score >= 0.82) GROUP BY ALL)
SELECT name, peak_id, round(score, 9) AS score, row_number() OVER (PARTITION BY name ORDER BY score DESC, elevation DESC, peak_id) AS rank FROM al QUALIFY rank <= 5""",
    "ngram_in_text": f"""WITH {_SPELL}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^0-9A-Za-zÀ-ɏ]+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(1, 5)) AS n FROM w), p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS position FROM s WHERE len(ws) >= n),
g AS (SELECT doc_id, n, position, array_to_string(ws[position:position + n - 1], ' ') AS span FROM p), f AS (SELECT doc_id, n, position, {_normal('span')} AS normal FROM g), h AS (SELECT doc_id, normal, max(n) AS n_words, min(position) AS position FROM f WHERE (n > 1 OR len(normal) >= 8) AND normal IN (SELECT normal FROM spell) GROUP BY ALL)
SELECT doc_id, normal, n_words, position, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, position, normal) AS rank FROM h QUALIFY rank <= 5""",
    "spatial_near": "WITH p AS (SELECT record_id, latitude AS a, longitude AS o FROM photo_analysis WHERE NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180), n AS (SELECT record_id, peak_id, coalesce(elevation, 0) AS elevation FROM p JOIN peaks ON lat BETWEEN a - 0.15 AND a + 0.15 AND lon IS NOT NULL WHERE sqrt(pow(radians(lon - o) * cos(radians((a + lat) / 2)), 2) + pow(radians(lat - a), 2)) * 6371.0088 <= 15) SELECT record_id, peak_id, elevation, row_number() OVER (PARTITION BY record_id ORDER BY elevation DESC, peak_id) AS rank FROM n QUALIFY rank <= 12",
    "nearest_place": f"WITH n AS (SELECT scan_row_id, peak_id, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM photos a JOIN peaks b ON b.lat BETWEEN a.lat - 0.1 AND a.lat + 0.1 WHERE a.lon IS NOT NULL AND b.lon IS NOT NULL) SELECT scan_row_id, peak_id, round(d, 6) AS distance_km FROM n WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY scan_row_id ORDER BY d, peak_id) = 1",
    "bounds_filter": "SELECT country, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS dropped FROM (SELECT country, coalesce(lat BETWEEN 35 AND 81 AND lon BETWEEN -25 AND 45, true) AS k FROM peaks) GROUP BY country",
    "centroid_bbox": f"WITH p AS (SELECT top_folder, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z, min(lat) AS a, min(lon) AS b, max(lat) AS c, max(lon) AS d FROM photos WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY top_folder) SELECT top_folder, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon, round({_km('a', 'b', 'c', 'd')}, 4) AS span_km FROM p",
    "noisy_or": f"WITH {_CLAIMS}, s AS (SELECT session, peak, {_STRENGTH} AS s FROM claims WHERE peak IS NOT NULL AND peak <> ''), r AS (SELECT session, peak, s, row_number() OVER (PARTITION BY session, peak ORDER BY s DESC) - 1 AS k FROM s) SELECT session, peak, round(1 - product(1 - s * pow(0.6::DOUBLE, k)), 6) AS probability, count(*) AS n_claims FROM r GROUP BY session, peak",
    "contradiction_filter": f"WITH {_CLAIMS}, an AS (SELECT DISTINCT session, peak AS name, lat, lon FROM claims WHERE basis IN ('sign_in_scene', 'printed_page') AND peak IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL), m AS (SELECT record_id, min({_km('c.lat', 'c.lon', 'an.lat', 'an.lon')}) AS d, bool_or(c.peak = an.name) AS named FROM claims c JOIN an USING (session) WHERE c.peak IS NOT NULL AND c.lat IS NOT NULL AND c.lon IS NOT NULL AND NOT coalesce(basis IN ('sign_in_scene', 'printed_page'), false) GROUP BY record_id) SELECT record_id, round(d, 6) AS nearest_km FROM m WHERE d > 30 AND NOT named",
    "consensus_location": f"""WITH {_CLAIMS}, p AS (SELECT session, record_id, latitude AS a, longitude AS o FROM claims WHERE NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180), pr AS (SELECT x.session, x.record_id AS seed, y.record_id AS other, y.a, y.o FROM p x JOIN p y USING (session) WHERE {_km('x.a', 'x.o', 'y.a', 'y.o')} <= 25),
sz AS (SELECT session, seed, count(*) AS agreeing FROM pr GROUP BY ALL), tot AS (SELECT session, count(*) AS considered FROM p GROUP BY session), b AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY session ORDER BY agreeing DESC, seed) = 1), ch AS (SELECT * FROM b JOIN tot USING (session) WHERE agreeing >= 2 AND agreeing / considered >= 0.4),
mem AS (SELECT ch.session, agreeing, considered, other, a, o FROM ch JOIN pr ON pr.session = ch.session AND pr.seed = ch.seed), co AS (SELECT x.session, x.agreeing, x.considered, x.other, x.a, x.o, sum({_km('x.a', 'x.o', 'y.a', 'y.o')}) AS d FROM mem x JOIN mem y USING (session) GROUP BY ALL)
SELECT session, a AS lat, o AS lon, agreeing, considered FROM co QUALIFY row_number() OVER (PARTITION BY session ORDER BY CASE WHEN agreeing <= 2 THEN 0 ELSE round(d, 9) END, other) = 1""",
    "embed_tags": _tags(),
    "page_score": "WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 5), s AS (SELECT e.vec_id, k, 100 * list_dot_product(e.embedding::DOUBLE[], p.v) AS s FROM embeddings e, p), x AS (SELECT vec_id, k, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s) SELECT vec_id, round(sum(e) FILTER (k <= 2) / sum(e), 6) AS score FROM x GROUP BY vec_id",
    "upsert_latest": "SELECT content_hash, max(analysis_id) AS analysis_id, arg_min(size_bytes, analysis_id) AS size_bytes, arg_max(model, analysis_id) AS model, arg_max(len(raw_response), analysis_id) FILTER (raw_response IS NOT NULL) AS reply_chars FROM analysis WHERE content_hash IS NOT NULL GROUP BY content_hash",
    "pocket_shots": "SELECT record_id FROM photo_analysis WHERE coalesce(peak_name, '') = '' AND coalesce(crag_name, '') = '' AND coalesce(verified_peak, '') = '' AND coalesce(visible_text, '') = '' AND coalesce(len(landmarks), 0) = 0 AND coalesce(len(place_names_visible), 0) = 0 AND coalesce(len(caption), 0) <= 60 AND coalesce(people_count, 0) = 0 AND activity IN ('none', 'unknown') AND scene IN ('other', 'unknown') AND sharpness = 'blurry' AND aesthetic_score <= 1",
    "pocket_evidence": "SELECT record_id, (coalesce(peak_name, '') = '')::INT + (coalesce(crag_name, '') = '')::INT + (coalesce(verified_peak, '') = '')::INT + (coalesce(visible_text, '') = '')::INT + (coalesce(len(landmarks), 0) = 0)::INT + (coalesce(len(place_names_visible), 0) = 0)::INT + (coalesce(len(caption), 0) <= 60)::INT + (coalesce(people_count, 0) = 0)::INT + coalesce(activity IN ('none', 'unknown'), false)::INT + coalesce(scene IN ('other', 'unknown'), false)::INT + coalesce(sharpness = 'blurry' AND aesthetic_score <= 1, false)::INT AS signs FROM photo_analysis",
    "rating_fields": "SELECT record_id, least(5, greatest(1, aesthetic_score)) AS rating, CASE sharpness WHEN 'sharp' THEN 'keep' WHEN 'blurry' THEN 'check' END AS label FROM photo_analysis WHERE aesthetic_score IS NOT NULL",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 43200000000, false) AS s FROM events WHERE ts IS NOT NULL), n AS (SELECT user_id, ts, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM n GROUP BY user_id, k",
    "trip_merge": f"""WITH RECURSIVE {_SESSIONS}, ky AS (SELECT sess.top_folder, session_no, sess.taken_ts, record_id, verified_peak, mountain_range, evidence_basis FROM sess LEFT JOIN photo_analysis r ON r.content_hash = sess.content_key),
pl AS (SELECT top_folder, session_no, verified_peak AS place FROM (SELECT top_folder, session_no, verified_peak, count(*) AS n, min(record_id) AS f FROM ky WHERE verified_peak <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY n DESC, f) = 1),
ar AS (SELECT top_folder, session_no, mountain_range AS area FROM (SELECT top_folder, session_no, mountain_range, count(*) AS n, min(record_id) AS f FROM ky WHERE mountain_range <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY top_folder, session_no ORDER BY n DESC, f) = 1),
rd AS (SELECT top_folder, session_no, coalesce(bool_or(evidence_basis = 'sign_in_scene'), false) AS rd, min(taken_ts) AS a, max(taken_ts) AS b FROM ky GROUP BY ALL),
x AS (SELECT rd.*, place, area, row_number() OVER (PARTITION BY top_folder ORDER BY a ASC NULLS LAST, session_no) AS rn FROM rd LEFT JOIN pl USING (top_folder, session_no) LEFT JOIN ar USING (top_folder, session_no)),
tr AS (SELECT top_folder, session_no, rn, 1::BIGINT AS trip_no, a AS s, b AS e, place AS p, area AS r, rd AS read FROM x WHERE rn = 1
  UNION ALL SELECT top_folder, session_no, rn, CASE WHEN j THEN trip_no ELSE trip_no + 1 END, CASE WHEN j THEN s ELSE a END, CASE WHEN j THEN greatest(b, e) ELSE b END, CASE WHEN NOT j THEN place WHEN read THEN p WHEN rd THEN place END, CASE WHEN j THEN coalesce(r, area) ELSE area END, CASE WHEN j THEN read OR rd ELSE rd END
  FROM (SELECT x.*, trip_no, s, e, p, r, read, coalesce(epoch_us(a) - epoch_us(e) BETWEEN 0 AND 64800000000 AND epoch_us(greatest(b, e)) - epoch_us(s) <= 259200000000, false) AND NOT coalesce(p <> place, false) AND NOT coalesce(r <> area, false) AND coalesce(p, place, r, area) IS NOT NULL AS j FROM tr JOIN x ON x.top_folder = tr.top_folder AND x.rn = tr.rn + 1))
SELECT top_folder, session_no, trip_no FROM tr""",
    "chunk_packing": f"""WITH RECURSIVE {_LP}, x AS (SELECT top_folder, source_path, coalesce(size_bytes, 0) AS b, row_number() OVER (PARTITION BY top_folder ORDER BY source_path) AS rn FROM lp),
c AS (SELECT top_folder, source_path, rn, 1::BIGINT AS chunk_no, 1::BIGINT AS n, b::BIGINT AS total FROM x WHERE rn = 1 UNION ALL SELECT x.top_folder, x.source_path, x.rn, CASE WHEN total + b > 209715200 OR n + 1 > 50 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN total + b > 209715200 OR n + 1 > 50 THEN 1 ELSE n + 1 END, CASE WHEN total + b > 209715200 OR n + 1 > 50 THEN b ELSE total + b END FROM c JOIN x ON x.top_folder = c.top_folder AND x.rn = c.rn + 1)
SELECT source_path, chunk_no FROM c""",
    "verified_sink": "SELECT coalesce(year(taken_ts), 0)::INT AS year, count(*) AS n, count(*) AS n_read, true AS verified FROM photos GROUP BY 1",
    "manifest_json": f"""WITH {_SUMMARY} SELECT top_folder, '{{"session_no":' || session_no || coalesce(',"start_ts":"' || strftime(start_ts, '%Y-%m-%dT%H:%M:%S.%g') || '"', '') || coalesce(',"end_ts":"' || strftime(end_ts, '%Y-%m-%dT%H:%M:%S.%g') || '"', '') || ',"items":' || items || ',"cameras":' || to_json(cameras)::VARCHAR || '}}' AS json FROM summary""",
    "preflight": "SELECT 'paths are there' AS name, count(*) = 0 AS ok, count(*) AS broken FROM photos WHERE source_path IS NULL UNION ALL SELECT 'sizes are not negative', count(*) = 0, count(*) FROM photos WHERE size_bytes < 0 UNION ALL SELECT 'latitudes are possible', count(*) = 0, count(*) FROM photos WHERE abs(lat) > 90 UNION ALL SELECT 'row ids are unique', count(*) = count(DISTINCT scan_row_id), count(*) - count(DISTINCT scan_row_id) FROM photos",
}
