"""Events: what the records of a session say together, where it was, and the
folder name that follows.

Votes over several columns are one aggregation: each record is unpivoted to its
values, values are counted with map-side combining, and the most frequent one
per column is picked from the counts. Nulls and empty texts have no vote; of
equally frequent values the one met first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed, text
from ridgeline.operators import fusion

#: Columns of a record that an event takes by vote.
VOTED = ["crag_name", "mountain_range", "region", "locality", "country", "country_code", "season", "activity"]
SAYS_NOTHING = ["unknown", "none"]


def voted(rows: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """The most frequent value of each of ``values`` per key."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("string").alias("value")) for v in values]))
    counts = rows.select(*keys, order, each.alias("x")).select(*keys, order, "x.*").filter("value <> ''").groupBy(*keys, "field", "value").agg(F.count("*").alias("n"), F.min(order).alias("f"))
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("field") == v, F.struct((-F.col("n")).alias("n"), "f", "value")))["value"].alias(v) for v in values])


def summaries(records: DataFrame, keys: list[str], order: str, *, least: float = fixed.MIN_PROBABILITY) -> DataFrame:
    """One row per event: its most probable summit (or, below ``least``, the summit that was rejected), runner-up, votes, and the first twelve keywords. ``records`` has the keys, ``order`` (unique) and the columns of an analysis."""
    session = F.struct(*keys)
    claims = records.select(session.alias("session"), *keys, order, F.col("verified_peak").alias("peak"), F.col("evidence_basis").alias("basis"), F.col("location_confidence").alias("confidence"), "verified_lat", "verified_lon", "verified_country")
    ranked = fusion.ranked_peaks(claims, "session").filter("rank <= 2")
    prior = F.lit(0.0)
    for basis, p in fixed.PEAK_PRIOR.items():
        prior = F.when(F.col("basis") == basis, p).otherwise(prior)
    source = claims.filter("peak <> ''").groupBy("session", "peak").agg(F.min(F.struct((-prior).alias("p"), order, "basis", "verified_lat", "verified_lon", "verified_country")).alias("s"))
    top = ranked.filter("rank = 1").join(source, ["session", "peak"]).join(ranked.filter("rank = 2").select("session", F.col("peak").alias("runner_up"), F.col("probability").alias("runner_up_probability")), "session", "left")
    sure = F.col("probability") >= least
    only = lambda c: F.when(sure, F.col(c))
    top = top.select("session.*", only("peak").alias("verified_peak"), F.when(~sure, F.col("peak")).alias("rejected_peak"), only("s.verified_lat").alias("verified_lat"), only("s.verified_lon").alias("verified_lon"), F.col("s.verified_country").alias("verified_country"), F.col("s.basis").alias("evidence_basis"), "probability", F.col("n_claims").alias("agreement"), "runner_up", "runner_up_probability")
    telling = records.withColumn("activity", F.when(~F.col("activity").isin(SAYS_NOTHING), F.col("activity")))
    votes = voted(telling, keys, VOTED, order)
    # distinct words of an event are few beside its records
    words = records.select(*keys, F.explode("keywords").alias("w")).filter("w <> ''").distinct().groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("w")), 1, 12).alias("keywords"))
    n = records.groupBy(*keys).agg(F.count("*").alias("considered"))
    out = n.join(votes, keys, "left").join(top, keys, "left").join(words, keys, "left")
    return out.withColumn("season", F.coalesce("season", F.lit("unknown"))).withColumn("activity", F.coalesce("activity", F.lit("unknown")))


def folder_parts(country: Column, region: Column, mountain_range: Column, place: Column, activity: Column) -> Column:
    """Country, region (or range, neither if vague), place and activity as one name of at most sixty characters; the activity only if it repeats nothing."""
    clear = lambda c: F.when(~F.lower(text.slug(c)).isin(fixed.VAGUE_REGIONS), c)
    parts = F.concat_ws("_", *[F.when(text.slug(c) != "", text.slug(c)) for c in (country, F.coalesce(clear(region), clear(mountain_range)), place)])
    a = text.slug(F.when(~activity.isin(SAYS_NOTHING), activity))
    return F.substring(F.when((a != "") & ~F.contains(F.lower(parts), F.lower(a)), F.concat_ws("_", F.when(parts != "", parts), a)).otherwise(parts), 1, 60)


def event_folders(events: DataFrame, library: str, number: str) -> DataFrame:
    """Adds year, folder: the name with its day and month, again cut at sixty, or the event's number if nothing is known; equal names of a year of a library are numbered from 2 in the order of the events."""
    year = F.coalesce(F.date_format("start_ts", "yyyy"), F.lit("0000"))
    dated = F.substring(F.concat(F.col("_name"), F.coalesce(F.date_format("start_ts", "'_'dd_MM"), F.lit(""))), 1, 60)
    place = F.coalesce("verified_peak", "crag_name")
    numbered = F.concat(F.lit("Event"), F.lpad(F.col(number).cast("string"), F.greatest(F.lit(3), F.length(F.col(number).cast("string"))), F.lit("0")))
    df = events.withColumn("_name", folder_parts(F.coalesce("verified_country", "country_code"), F.col("region"), F.col("mountain_range"), place, F.col("activity")))
    df = df.withColumn("year", year).withColumn("_name", F.when(F.col("_name") != "", dated).otherwise(numbered))
    k = F.row_number().over(Window.partitionBy(library, "year", F.lower("_name")).orderBy(number))
    return df.withColumn("folder", F.concat(F.col("_name"), F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""))).drop("_name")


def locations(records: DataFrame, summary: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, lat, lon, source: the position of an event. That of its summit if this is sure and has one, else the estimates' consensus, if there is one."""
    gazetteer = summary.filter("verified_lat is not null and verified_lon is not null").select(*keys, F.col("verified_lat").alias("lat"), F.col("verified_lon").alias("lon"), F.lit("gazetteer").alias("source"))
    points = records.join(gazetteer.select(*keys), keys, "left_anti").select(F.struct(*keys).alias("session"), order, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    agreed = fusion.consensus(points, "session", order)
    return gazetteer.unionByName(agreed.select("session.*", "lat", "lon", F.lit("consensus").alias("source")))


def promoted(records: DataFrame, hits: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, peak_id, evidence_basis: records without a verified summit whose text names one take the first name found (of several summits of that name the smallest id); it was read, from a page if the record is of one."""
    first = hits.filter("rank = 1").select(key, "normal").join(known.groupBy("normal").agg(F.min("peak_id").alias("peak_id")), "normal")
    open_ = records.filter(F.coalesce(F.col("verified_peak"), F.lit("")) == "")
    read = F.col("evidence_basis").isin("sign_in_scene", "printed_page")
    basis = F.when(read, F.col("evidence_basis")).when(F.coalesce("is_guidebook_page", F.lit(False)), "printed_page").otherwise("sign_in_scene")
    return open_.join(first, key).select(key, "peak_id", basis.alias("evidence_basis"))


def explained() -> Column:
    """Why a frame was kept, in words."""
    words = [
        F.coalesce("sharpness", F.lit("unknown")),
        F.when(~F.col("gaze").isin("no_people", "unknown"), F.translate("gaze", "_", " ")),
        F.when(F.col("eyes_closed_count") > 0, F.concat(F.col("eyes_closed_count").cast("string"), F.lit(" blinking"))),
        F.when(F.col("composition") != "unknown", F.concat("composition", F.lit(" composition"))),
        F.when(F.col("aesthetic_score") > 0, F.concat(F.lit("rated "), F.col("aesthetic_score").cast("string"), F.lit("/5"))),
    ]
    return F.concat_ws(", ", *words)
