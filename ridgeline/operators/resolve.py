"""Names against a gazetteer: exact, fuzzy, in running text, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.functions.geo import rough_km
from ridgeline.functions.text import edit_ratio, name_similarity, name_tokens, normalise_name
from ridgeline.operators.spatial import near
from ridgeline.session import cut

MIN_SCORE = 0.82


def spellings(peaks: DataFrame) -> DataFrame:
    """peak_id, normal of every name and alias; the gazetteer's bounds hold for peaks with a position."""
    low, high, west, east = fixed.GAZETTEER_BOUNDS
    inside = F.coalesce(F.col("lat").between(low, high) & F.col("lon").between(west, east), F.lit(True))
    names = F.explode(F.concat(F.array("peak_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return peaks.filter(inside).select("peak_id", "country", "elevation", "lat", "lon", names.alias("name")).select("*", normalise_name(F.col("name")).alias("normal")).filter("normal <> ''").drop("name").distinct()


def exact_matches(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, peak_id of names that equal a spelling once folded."""
    asked = names.select("name", normalise_name(F.col("name")).alias("normal")).filter("normal <> ''").distinct()
    return asked.join(known.select("peak_id", "normal"), "normal").select("name", "peak_id").distinct()


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit("#"), text, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def _prefix(text: Column, least: float, rank: Column) -> Column:
    """The bigrams of which two texts of edit ratio ``least`` share at least one: every edit spoils two, so of the bigrams in one fixed order the first 2 * edits + 1 of each side meet. Rare bigrams come first."""
    edits = F.floor((1 - least) / least * F.length(text) + 1e-9)
    ordered = F.sort_array(F.transform(_grams(text), lambda g: F.struct(F.coalesce(F.try_element_at(rank, g), F.lit(0)).alias("n"), g.alias("g"))))
    return F.transform(F.slice(ordered, F.lit(1), (2 * edits + 1).cast("int")), lambda x: x["g"])


def similar_words(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b of all distinct words (columns ``w``) with edit ratio ``least`` or more, by prefix filtering: an equi join on rare bigrams, then the exact ratio. Words are normalised, so there are at most some 1,500 bigrams; their counts order them."""
    right = right.select("w").distinct()
    counts = right.select(F.explode(_grams(F.col("w"))).alias("g")).groupBy("g").count().limit(5000).collect()
    rank = F.create_map(*[F.lit(x) for r in counts for x in (r["g"], r["count"])]) if counts else F.create_map(F.lit(""), F.lit(0).cast("bigint"))
    a = left.select(F.col("w").alias("a")).distinct().select("a", F.explode(_prefix(F.col("a"), least, rank)).alias("g"))
    b = right.select(F.col("w").alias("b")).select("b", F.explode(_prefix(F.col("b"), least, rank)).alias("g"))
    close = F.abs(F.length("a") - F.length("b")) <= F.greatest(F.length("a"), F.length("b")) * (1 - least) + 1e-9
    return a.join(b, "g").filter(close).select("a", "b").distinct().filter(edit_ratio(F.col("a"), F.col("b")) >= least)


def fuzzy_matches(names: DataFrame, known: DataFrame, *, min_score: float = MIN_SCORE, limit: int = 5) -> DataFrame:
    """name, peak_id, score, rank: exact spellings alone if there are any, else the ``limit`` best of at least ``min_score``; higher peaks first among equals, then the smaller id.

    A pair can only reach the score if the whole names or two of their words do, so only such pairs are formed.
    """
    asked = names.select("name", normalise_name(F.col("name")).alias("q")).filter("q <> ''").distinct()
    spelt = cut(known.select("peak_id", "elevation", F.col("normal").alias("c")))  # read several times below
    exact = asked.join(spelt, F.col("q") == F.col("c")).select("name", "q", "peak_id", "elevation", F.lit(1.0).alias("score"))
    open_names = cut(asked.join(exact.select("name").distinct(), "name", "left_anti"))
    whole = similar_words(open_names.select(F.col("q").alias("w")), spelt.select(F.col("c").alias("w")), min_score).select(F.col("a").alias("q"), F.col("b").alias("c"))
    q_words = open_names.select("q", F.explode(name_tokens(F.col("q"))).alias("w")).distinct()
    c_words = spelt.select("c", F.explode(name_tokens(F.col("c"))).alias("w")).distinct()
    words = similar_words(q_words.select("w"), c_words.select("w"), min_score)
    by_word = words.join(q_words.withColumnRenamed("w", "a"), "a").join(c_words.withColumnRenamed("w", "b"), "b").select("q", "c")
    pairs = cut(whole.unionByName(by_word).distinct()).withColumn("score", name_similarity(F.col("q"), F.col("c"))).filter(F.col("score") >= min_score)
    fuzzy = open_names.join(pairs, "q").join(spelt, "c").select("name", "q", "peak_id", "elevation", "score")
    best = exact.unionByName(fuzzy).groupBy("name", "peak_id").agg(F.max("score").alias("score"), F.max(F.coalesce("elevation", F.lit(0))).alias("elevation"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("elevation"), "peak_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("name", "peak_id", "score", "rank")


def names_in_text(texts: DataFrame, known: DataFrame, *, key: str, text: str, single: int = 8, limit: int = 5) -> DataFrame:
    """key, normal, n_words, position, rank of gazetteer names of one to four words in running text; single words need ``single`` letters; longer names first, then the earlier."""
    words = F.filter(F.split(F.col(text), "[^0-9A-Za-zÀ-ɏ]+"), lambda w: w != "")
    # each word is folded once; a span of words is looked at only where a known name's first word stands
    rows = texts.select(key, F.transform(words, normalise_name).alias("words")).filter(F.size("words") > 0)
    spans = F.transform("words", lambda w, i: F.struct((i + 1).alias("position"), F.slice(F.col("words"), i + 1, 4).alias("span")))
    joined = lambda c: F.array_join(F.filter(c, lambda w: w != ""), " ")
    at = rows.select(key, F.explode(spans).alias("s")).select(key, "s.*").withColumn("head", F.split_part(joined(F.col("span")), F.lit(" "), F.lit(1)))
    at = at.join(known.select(F.split_part("normal", F.lit(" "), F.lit(1)).alias("head")).distinct(), "head", "left_semi")
    grams = at.select(key, "position", "span", F.explode(F.sequence(F.lit(1), F.size("span"))).alias("n")).withColumn("normal", joined(F.slice("span", F.lit(1), F.col("n"))))
    grams = grams.filter((F.col("n") > 1) | (F.length("normal") >= single))
    found = grams.join(known.select("normal").distinct(), "normal").groupBy(key, "normal").agg(F.max("n").alias("n_words"), F.min("position").alias("position"))
    w = Window.partitionBy(key).orderBy(F.desc("n_words"), "position", "normal")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def highest_near(points: DataFrame, peaks: DataFrame, *, point: tuple[str, str, str], radius_km: float = 15.0, limit: int = 12) -> DataFrame:
    """point id, peak_id, elevation, rank of the highest peaks within the radius on the scaled plane; unknown heights count as 0."""
    pairs = near(points, peaks, radius_km * 1.05, point=point, target=("peak_id", "lat", "lon")).select(point[0], "peak_id")
    both = pairs.join(points.select(*point), point[0]).join(peaks.select("peak_id", "lat", "lon", F.coalesce("elevation", F.lit(0)).alias("elevation")), "peak_id")
    both = both.filter(rough_km(F.col(point[1]), F.col(point[2]), F.col("lat"), F.col("lon")) <= radius_km)
    w = Window.partitionBy(point[0]).orderBy(F.desc("elevation"), "peak_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(point[0], "peak_id", "elevation", "rank")


def nearest(points: DataFrame, places: DataFrame, *, point: tuple[str, str, str], place: tuple[str, str, str], max_km: float = 50.0) -> DataFrame:
    """point id, place id, distance_km of the nearest place within ``max_km``; of equals the smaller id. One aggregation of the pairs of a grid join."""
    pairs = near(points, places, max_km, point=point, target=place)
    best = pairs.groupBy(point[0]).agg(F.min(F.struct("distance_km", place[0])).alias("b"))
    return best.select(point[0], F.col(f"b.{place[0]}").alias(place[0]), F.col("b.distance_km").alias("distance_km"))
