"""Keyed record store on Parquet: merges, versioned parsing, verified sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import fixed


def enum(value: Column, allowed: list[str], default: str, aliases: dict[str, str] | None = None) -> Column:
    """A value of a closed set: lower case, blanks as underscores, older spellings mapped, anything else the default."""
    v = F.regexp_replace(F.lower(F.trim(value)), "\\s+", "_")
    for old, new in (aliases or {}).items():
        v = F.when(v == old, new).otherwise(v)
    return F.when(v.isin(allowed), v).otherwise(default)


def clean_text(value: Column) -> Column:
    """Trimmed; null if blank."""
    t = F.trim(F.translate(value, "\x00", ""))
    return F.when(t != "", t)


def clean_list(values: Column, most: int = 20) -> Column:
    """Trimmed entries without blanks, at most ``most``."""
    return F.slice(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, most)


def merge_latest(base: DataFrame, changes: DataFrame, key: str, seq: str, *, keep_first: list[str] = (), keep_known: list[str] = ()) -> DataFrame:
    """The store after ``changes``: per key the row of the highest ``seq``; columns of ``keep_first`` stay as first written, those of ``keep_known`` are never overwritten by null. One aggregation with map-side combining."""
    rows = base.unionByName(changes)
    others = [c for c in rows.columns if c != key and c not in keep_first and c not in keep_known]
    last = F.max(F.struct(seq, *[c for c in others if c != seq])).alias("_l")
    first = [F.min(F.struct(seq, c)).alias(f"_f_{c}") for c in keep_first]
    known = [F.max(F.when(F.col(c).isNotNull(), F.struct(seq, c))).alias(f"_k_{c}") for c in keep_known]
    m = rows.groupBy(key).agg(last, *first, *known)
    return m.select(key, *[F.col(f"_l.{c}").alias(c) for c in others], *[F.col(f"_f_{c}.{c}").alias(c) for c in keep_first], *[F.col(f"_k_{c}.{c}").alias(c) for c in keep_known])


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the highest ``seq`` of every key."""
    others = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max(F.struct(seq, *others)).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in (seq, *others)])


def missing(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the store does not hold."""
    return keys.select(key).filter(F.col(key).isNotNull()).distinct().join(store.select(key), key, "left_anti")


def keywords(order: list[Column], most: int = 40) -> Column:
    """Distinct words in the given order, trimmed; 'unknown' and 'none' tell nothing."""
    parts = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in order])
    good = F.filter(F.transform(F.filter(parts, lambda x: ~x.isin("unknown", "none")), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_distinct(good), 1, most)


def pocket_signs() -> list[Column]:
    """What tells a frame taken by accident: nothing in it has a name, nobody is in it, and it is blurred and rated 1 at most."""
    none_of = lambda *cs: [F.coalesce(F.col(c) == "", F.lit(True)) for c in cs]
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True)) | F.col(c).isNull()
    parts = [*none_of("peak_name", "crag_name", "verified_peak", "visible_text"), empty("landmarks"), empty("place_names_visible"), F.coalesce(F.length("caption") <= 60, F.lit(True)), F.coalesce(F.col("people_count") == 0, F.lit(True))]
    parts += [F.coalesce(F.col("activity").isin("none", "unknown"), F.lit(False)), F.coalesce(F.col("scene").isin("other", "unknown"), F.lit(False)), F.coalesce((F.col("sharpness") == "blurry") & (F.col("aesthetic_score") <= 1), F.lit(False))]
    return parts


def pocket_shot() -> Column:
    """A frame with all signs of :func:`pocket_signs`."""
    return reduce(lambda a, b: a & b, pocket_signs())


#: Fields of a reply and what they hold.
RECORD = {
    "text": ["country", "region", "mountain_range", "locality", "peak_name", "crag_name", "route_name", "visible_text", "caption", "reasoning", "weather", "rock_type", "notes"],
    "number": ["latitude", "longitude", "elevation_m", "people_count", "aesthetic_score", "eyes_closed_count"],
    "truth": ["is_indoor", "is_guidebook_page", "is_personal_document"],
    "list": ["climbing_grades", "keywords", "place_names_visible", "landmarks", "gear_visible"],
}
CLOSED = {
    "location_confidence": (fixed.CONFIDENCE, "low", None), "evidence_basis": (fixed.EVIDENCE_BASIS, "none", fixed.EVIDENCE_ALIASES), "activity": (fixed.ACTIVITIES, "unknown", None), "scene": (fixed.SCENES, "unknown", None),
    "season": (fixed.SEASONS, "unknown", None), "time_of_day": (fixed.TIMES_OF_DAY, "unknown", None), "composition": (fixed.COMPOSITIONS, "unknown", None), "gaze": (fixed.GAZES, "unknown", None),
}


def typed_record(fields: Column) -> list[Column]:
    """Columns of a record from a map of variants: texts trimmed and null if blank, numbers or null, truths or false, lists of at most 20 as one text, closed sets with their defaults, the country code in two capitals."""
    value = lambda k, kind: F.try_variant_get(F.try_element_at(fields, F.lit(k)), "$", kind)
    out = [clean_text(value(k, "string")).alias(k) for k in RECORD["text"]]
    out += [value(k, "double").alias(k) for k in RECORD["number"]]
    out += [F.coalesce(value(k, "boolean"), F.lit(False)).alias(k) for k in RECORD["truth"]]
    out += [F.array_join(clean_list(F.coalesce(value(k, "array<string>"), F.array().cast("array<string>"))), ";").alias(k) for k in RECORD["list"]]
    out += [enum(value(k, "string"), *args).alias(k) for k, args in CLOSED.items()]
    return [*out, F.substring(F.upper(clean_text(value("country_code", "string"))), 1, 2).alias("country_code")]


def edit_line(index: Column, name: Column, merge: Column) -> Column:
    """One edit of an event as a line of key = value pairs; quotes in the name are escaped."""
    from ridgeline.functions.text import toml_escape

    named = F.when(name.isNotNull(), F.concat(F.lit(', name = "'), toml_escape(name), F.lit('"')))
    return F.concat(F.lit("index = "), index.cast("string"), F.coalesce(named, F.lit("")), F.when(merge, ", merge_into_previous = true").otherwise(""))


def read_edits(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, index, name, merge of every line with an index; a name that is unusable as a folder name is null."""
    from ridgeline.functions.text import safe_label

    raw = F.regexp_extract(line, r'name = "((?:[^"\\]|\\.)*)"', 1)
    label = safe_label(F.regexp_replace(raw, r"\\(.)", "$1"))
    return lines.select(key, F.regexp_extract(line, r"^index = (\d+)", 1).try_cast("bigint").alias("index"), F.when(label != "", label).alias("name"), F.col(line).contains("merge_into_previous = true").alias("merge")).filter("index is not null")


def rating(score: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), score))


def verified_write(df: DataFrame, path: str, *, partition: list[str] = ()) -> DataFrame:
    """Writes, reads back and compares row count and an order-free hash per partition value; returns the comparison. Partitions already there with equal content are passed over, so a run can be resumed."""
    from pyspark.errors import AnalysisException

    def digest(rows: DataFrame) -> DataFrame:
        # columns by name: a partitioned table gives its partition columns last
        row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
        return rows.groupBy(*partition).agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("h"))

    spark = df.sparkSession
    try:
        there = digest(spark.read.schema(df.schema).parquet(path))
    except AnalysisException:
        there = None
    todo = df
    if there is not None and partition:
        same = digest(df).join(there, [*partition, "n", "h"], "left_semi").select(*partition)
        todo = df.join(same, list(partition), "left_anti")
    (todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition) if partition else todo.write.mode("overwrite")).parquet(path)
    want, got = digest(df), digest(spark.read.schema(df.schema).parquet(path))
    on = [*partition, "_one"]
    want, got = want.withColumn("_one", F.lit(1)), got.withColumn("_one", F.lit(1))
    both = want.join(got.select(*on, F.col("n").alias("n_read"), F.col("h").alias("h_read")), on, "left")
    return both.select(*partition, "n", "n_read", (F.col("n").eqNullSafe(F.col("n_read")) & F.col("h").eqNullSafe(F.col("h_read"))).alias("verified"))


def with_free_names(rows: DataFrame, keys: list[str], name: str, out: str, *order: Column | str) -> DataFrame:
    """Adds ``out``, a name unique within ``keys`` without regard to case: the first keeps ``name``, the others get the smallest numbers from 2 on, before the extension, that no other name of ``keys`` has already. Names that are numbered so never meet each other, as they differ before the number."""
    from pyspark.sql import Window

    low = F.lower(name)
    cut_name = r"^(.*?)(\.[^.]*)?$"
    stem, ext = F.regexp_extract(low, cut_name, 1), F.regexp_extract(low, cut_name, 2)
    numbered = r"^(.*)_([1-9][0-9]{0,8})$"
    taken = rows.select(*keys, F.regexp_extract(stem, numbered, 1).alias("_stem"), ext.alias("_ext"), F.regexp_extract(stem, numbered, 2).try_cast("bigint").alias("_t")).filter("_t >= 2")
    taken = taken.groupBy(*keys, "_stem", "_ext").agg(F.array_sort(F.collect_set("_t")).alias("_t"))
    df = rows.withColumn("_stem", stem).withColumn("_ext", ext).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, low).orderBy(*order)).cast("bigint"))
    df = df.join(taken, [*keys, "_stem", "_ext"], "left")
    free = F.aggregate(F.coalesce("_t", F.array().cast("array<bigint>")), F.col("_n"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    kept = F.concat(F.regexp_extract(name, cut_name, 1), F.lit("_"), free.cast("string"), F.regexp_extract(name, cut_name, 2))
    return df.withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(kept)).drop("_stem", "_ext", "_n", "_t")


def unique_names(rows: DataFrame, keys: list[str], name: str, *order: Column | str) -> Column:
    """A name unique within ``keys`` without regard to case: the first keeps it, others get _2, _3 and so on before the extension."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, F.lower(name)).orderBy(*order)
    n = F.row_number().over(w)
    stem, ext = F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 2)
    return F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))

