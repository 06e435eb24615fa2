"""Best representative of each duplicate group, field by field.

One aggregation takes, for every field, the maximum of a composite struct
(has the field, rank of its source, rank of the member, value). Strings cannot
be negated, so the last key, which prefers the smaller path, is taken by a
minimum over structs whose other keys are negated: the same choice.

Groups are exploded to members before anything is joined and aggregated with
map-side combining, so neither a group nor a path with a third of all rows
gathers in one task's memory.

Defined cases: of several rows of one group the latest counts, of rows written
at one moment that with the smaller member list; null and repeated members are
ignored; members without a scan supply nothing; a group without members or
without a member that has a field has no row for it; of several scans of a path
the latest counts, then the larger id; null times rank before all others; null
size and null pixels rank as the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust in the origin of a timestamp, best first.
TIME_SOURCES = ["exif", "filename", "mtime", "none"]


def latest_groups(groups: DataFrame) -> DataFrame:
    """group_id, source_path: the members of the latest row of each group, each once."""
    moment = F.coalesce(F.unix_micros(F.col("found_at").cast("timestamp")), F.lit(-(2**62)))
    members = F.array_sort(F.array_distinct(F.filter(F.coalesce("photos", F.array().cast("array<string>")), lambda p: p.isNotNull())))
    last = groups.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct((-moment).alias("m"), members.alias("photos"))).alias("g"))
    return last.select("group_id", F.explode("g.photos").alias("source_path"))


def latest_scans(photos: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The scan that counts of each path; only of ``paths`` if given."""
    rows = photos.select("source_path", "scan_row_id", "scanned_at", "size_bytes", "taken_ts", "timestamp_source", "lat", "lon", "width", "height", "camera_model").filter("source_path is not null")
    if paths is not None:
        rows = rows.join(paths.select("source_path").distinct(), "source_path", "left_semi")
    fields = [c for c in rows.columns if c not in ("source_path", "scan_row_id", "scanned_at")]
    last = rows.groupBy("source_path").agg(F.max(F.struct("scanned_at", "scan_row_id", *fields)).alias("s"))
    return last.select("source_path", *[F.col(f"s.{c}").alias(c) for c in fields])


def _first(has: Column, before: list[Column], rank: list[Column], *carried: str) -> Column:
    """Path of the first member that has the field, and what it carries: paths differ, so the values decide nothing."""
    keys = [c.alias(f"k{i}") for i, c in enumerate([*before, *rank])]
    return F.min(F.when(has, F.struct(*keys, F.col("source_path").alias("path"), *carried)))


#: Fields of a record and what each supplies.
FIELDS = {"record": ["size_bytes", "width", "height"], "position": ["lat", "lon"], "camera_model": ["camera_model"], "taken_ts": ["taken_ts"]}


def _best(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """group_id and, for the record and each field, a struct of the member's path and the values of FIELDS: one aggregation."""
    members = latest_groups(groups)
    rows = members.join(latest_scans(photos, members), "source_path")
    flag = lambda c: F.when(c, 0).otherwise(1)
    pixels = F.coalesce(F.col("width").cast("bigint") * F.col("height").cast("bigint"), F.lit(0))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rank = [-pixels, -F.coalesce(F.col("size_bytes"), F.lit(-1)), flag(F.coalesce(F.col("timestamp_source") == "exif", F.lit(False))), flag(placed)]
    origin = F.lit(len(TIME_SOURCES))
    for i, s in reversed(list(enumerate(TIME_SOURCES))):
        origin = F.when(F.col("timestamp_source") == s, i).otherwise(origin)
    named = F.coalesce(F.length(F.trim("camera_model")) > 0, F.lit(False))
    has = {"record": (F.lit(True), []), "position": (placed, []), "camera_model": (named, []), "taken_ts": (F.col("taken_ts").isNotNull(), [origin])}
    return rows.groupBy("group_id").agg(*[_first(when, before, rank, *FIELDS[f]).alias(f"_{f}") for f, (when, before) in has.items()])


def survivors(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """group_id, field_name, source_path: for the record and each of its fields the member that supplies it."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_{f}.path").alias("source_path")) for f in FIELDS]))
    return _best(groups, photos).select("group_id", each.alias("f")).select("group_id", "f.*").filter("source_path is not null")


def golden_records(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """One built record per group: every field from the member that supplies it, carried through the one aggregation."""
    best = _best(groups, photos).filter("_record is not null")
    return best.select("group_id", *[F.col(f"_{f}.path").alias(f"{f}_from") for f in FIELDS], *[F.col(f"_{f}.{c}").alias(c) for f, columns in FIELDS.items() for c in columns])
