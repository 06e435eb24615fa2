"""Filters, facets and ranked full-text search over analysis records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.text import ascii_fold

#: Closed set of filters: name, column.
FILTERS = {"activity": "activity", "scene": "scene", "region": "region", "mountain_range": "mountain_range", "peak": "verified_peak", "country": "country_code", "rock_type": "rock_type", "season": "season", "time_of_day": "time_of_day", "sharpness": "sharpness", "crag": "crag_name", "locality": "locality", "evidence_basis": "evidence_basis"}
FACETS = ["activity", "scene", "region", "mountain_range", "verified_peak", "country_code", "season"]
K1, B = 1.2, 0.75


def public(records: DataFrame) -> DataFrame:
    """Without personal documents."""
    return records.filter(~F.coalesce("is_personal_document", F.lit(False)))


def matching(filters: dict) -> Column:
    """The conjunction of known filters with a value; ``min_score`` is a lower bound; unknown names, null, '' and 'any' are passed over."""
    parts = [F.col(FILTERS[k]) == v for k, v in filters.items() if k in FILTERS and v not in (None, "", "any")]
    if filters.get("min_score") not in (None, "", "any"):
        parts.append(F.col("aesthetic_score") >= int(filters["min_score"]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_grade(records: DataFrame, bridge: DataFrame, grade: str) -> DataFrame:
    """Records that have ``grade`` in the bridge (record_id, grade)."""
    return records.join(bridge.filter(F.col("grade") == grade), "record_id", "left_semi")


def grade_bridge(records: DataFrame) -> DataFrame:
    return records.select("record_id", F.explode("climbing_grades").alias("grade")).filter("grade is not null and grade <> ''").distinct()


def facets(records: DataFrame, fields: list[str] | None = None, top: int = 60) -> DataFrame:
    """field, value, n of the ``top`` values per field, in one pass over the records: each is unpivoted to its fields and counted with map-side combining."""
    fields = fields or FACETS
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    counts = records.select(each.alias("x")).select("x.*").filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def body(records: DataFrame) -> DataFrame:
    """record_id, body: what a search looks at."""
    scalars = ["caption", "notes", "visible_text", "route_name", "verified_peak", "peak_name", "mountain_range", "region"]
    arrays = ["keywords", "place_names_visible", "climbing_grades"]
    return records.select("record_id", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in scalars], *[F.coalesce(F.array_join(c, " "), F.lit("")) for c in arrays]).alias("body"))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without accents."""
    return F.filter(F.split(F.regexp_replace(ascii_fold(F.lower(text)), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def postings(bodies: DataFrame, key: str = "record_id") -> DataFrame:
    """key, token, tf, positions, length: the inverted index."""
    rows = bodies.select(key, tokens(F.col("body")).alias("t")).filter(F.size("t") > 0)
    places = rows.select(key, F.size("t").alias("length"), F.posexplode("t").alias("pos", "token"))
    return places.groupBy(key, "token", "length").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def query_terms(text: str) -> list[list[str]]:
    """Each blank-separated term as the words that a phrase search needs."""
    import re
    import unicodedata

    fold = lambda w: re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", w.lower()).encode("ascii", "ignore").decode()).split()
    return [t for t in map(fold, text.split()) if t]


def bm25(index: DataFrame, terms: list[str], n_docs: int, mean_length: float, key: str = "record_id") -> DataFrame:
    """key, score of the documents with all terms; a term in more than half of the documents counts next to nothing. Collection figures are aggregates of the bodies."""
    wanted = sorted(set(terms))
    hits = index.filter(F.col("token").isin(wanted))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    return hits.join(F.broadcast(df), "token").groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("_k")).filter(F.col("_k") == len(wanted)).drop("_k")


def phrase(index: DataFrame, words: list[str], key: str = "record_id") -> DataFrame:
    """key of documents in which the words stand next to each other."""
    out = index.filter(F.col("token") == words[0]).select(key, F.col("positions").alias("_p"))
    for i, w in enumerate(words[1:], 1):
        nxt = index.filter(F.col("token") == w).select(key, F.transform("positions", lambda p: p - i).alias("_q"))  # noqa: B023
        out = out.join(nxt, key).select(key, F.array_intersect("_p", "_q").alias("_p")).filter(F.size("_p") > 0)
    return out.select(key)
