"""Sessions by time gap and location jump, trips, samples and rollups.

A library may hold a third of all items, so session windows run over spans of
``bucket_days`` of a library and are stitched through one row per span: the last
time, the number of splits and the last position before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.functions.geo import haversine_km
from ridgeline.functions.time import gap_label, seconds_between
from ridgeline.session import cut


def _before(rows: DataFrame, keys: list[str], bucket: str, value) -> DataFrame:
    """keys, bucket, _before: the sum of ``value`` in the buckets before, from one row per bucket."""
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def sessions(items: DataFrame, *, library: str, item: str, ts: str = "taken_ts", lat: str = "lat", lon: str = "lon", gap_hours: float = fixed.GAP_HOURS, jump_km: float = fixed.JUMP_KM, jump_minutes: float = fixed.JUMP_MINUTES, bucket_days: int = 30) -> DataFrame:
    """Adds session_no and split_reason. ``item`` is unique within a library.

    An item opens a session after a gap of more than ``gap_hours``, or more than
    ``jump_km`` from the last position of the session if ``jump_minutes`` passed.
    Undated items come last; each opens one if the library has any dated item.
    Only a jump resets the last position besides a gap, and a jump happens on an
    item with a position, so two passes of windows give the sequential result.
    A null library is a library.
    """
    columns = items.columns
    df = items.withColumn("_l", F.coalesce(F.col(library).cast("string"), F.lit("\x00")))
    # undated items follow the last span
    df = df.withColumn("_b", F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (86_400_000_000 * bucket_days)), F.lit(1 << 40)))
    span = ["_l", "_b"]
    order = [F.col(ts).asc_nulls_last(), F.col(item)]
    w = Window.partitionBy(*span).orderBy(*order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    by_span = Window.partitionBy("_l").orderBy("_b")
    ends = df.groupBy(*span).agg(F.max(ts).alias("_max"))
    ends = ends.select(*span, F.lag("_max").over(by_span).alias("_pmax"), (F.row_number().over(by_span) == 1).alias("_head"), F.max(F.col("_max").isNotNull()).over(Window.partitionBy("_l")).alias("_dated"))
    df = df.withColumn("_prev", F.lag(ts).over(w)).withColumn("_rn", F.row_number().over(w)).join(ends, span)
    df = df.withColumn("_gap", seconds_between(F.when(F.col("_rn") == 1, F.col("_pmax")).otherwise(F.col("_prev")), F.col(ts)))
    undated = F.col(ts).isNull() & ~(F.col("_head") & (F.col("_rn") == 1)) & F.col("_dated")
    df = df.withColumn("_ts", (F.coalesce(F.col("_gap") > gap_hours * 3600, F.lit(False)) | undated).cast("int"))
    df = cut(df.drop("_prev", "_rn", "_pmax", "_head", "_dated"))  # read several times from here on
    df = df.join(_before(df, ["_l"], "_b", "_ts"), span).withColumn("_seg", F.sum("_ts").over(sofar) + F.col("_before")).drop("_before")
    fix = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    df = df.withColumn("_fix", fix)
    inside = Window.partitionBy(*span, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy("_l", "_seg", "_b").agg(F.max(F.when(F.col("_fix").isNotNull(), F.struct(F.col(ts).isNull(), ts, item, "_fix")))["_fix"].alias("_f"))
    carried = carried.select("_l", "_seg", "_b", F.last("_f", ignorenulls=True).over(Window.partitionBy("_l", "_seg").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    df = df.withColumn("_in", F.last("_fix", ignorenulls=True).over(inside)).join(carried, ["_l", "_seg", "_b"]).withColumn("_last", F.coalesce("_in", "_carry"))
    km = haversine_km(F.col("_last.lat"), F.col("_last.lon"), F.col("_fix.lat"), F.col("_fix.lon"))
    df = df.withColumn("_js", F.coalesce((F.col("_ts") == 0) & (km > jump_km) & (F.col("_gap") >= jump_minutes * 60), F.lit(False)))
    gap = F.col("_ts") == 1
    reason = F.when(gap & F.col(ts).isNull(), "no timestamp").when(gap, F.concat(F.lit("time gap "), gap_label(F.col("_gap")))).when(F.col("_js"), F.concat(F.lit("location jump "), F.round(km).cast("bigint").cast("string"), F.lit("km")))
    df = cut(df.withColumn("_new", (gap | F.col("_js")).cast("int")).withColumn("split_reason", reason).select(*columns, *span, "_new", "split_reason"))
    df = df.join(_before(df, ["_l"], "_b", "_new"), span).withColumn("session_no", F.sum("_new").over(sofar) + F.col("_before") + 1)
    return df.select(*columns, "session_no", "split_reason")


def summaries(sessioned: DataFrame, *, library: str, item: str) -> DataFrame:
    """One row per session: start, end, items, missing positions and times, cameras in order of first use, bytes."""
    camera = F.when(F.length(F.trim("camera_model")) > 0, F.trim("camera_model"))
    first_use = sessioned.withColumn("_cam", camera).groupBy(library, "session_no", "_cam").agg(F.min(F.struct(F.col("taken_ts").isNull(), "taken_ts", item)).alias("_at"), F.count("*").alias("n"), F.min("taken_ts").alias("start"), F.max("taken_ts").alias("end"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_position"), F.count_if(F.coalesce(F.col("timestamp_source") != "exif", F.lit(True))).alias("no_exif_time"), F.sum("size_bytes").alias("bytes"))
    cameras = F.transform(F.array_sort(F.collect_list(F.when(F.col("_cam").isNotNull(), F.struct("_at", "_cam")))), lambda x: x["_cam"])
    return first_use.groupBy(library, "session_no").agg(F.min("start").alias("start_ts"), F.max("end").alias("end_ts"), F.sum("n").alias("items"), F.sum("no_position").alias("no_position"), F.sum("no_exif_time").alias("no_exif_time"), F.sum("bytes").alias("bytes"), F.array_join(cameras, ", ").alias("cameras"))


def plurality(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent non-empty value per key; of equals the one met first by ``order``."""
    counts = rows.filter(F.length(F.col(value)) > 0).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), "_first", F.col(value).alias("value"))).alias("b"))
    return best.select(*keys, F.col("b.value").alias(value), (-F.col("b.v")).alias("votes"))


def top_k(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows per key; the window's limit is pushed before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def even_sample(rows: DataFrame, key: str, k: int, ts: str, item: str, *, bucket_days: int = 30) -> DataFrame:
    """``k`` rows per key at even steps of time, then item (undated ones last): of n rows those at floor(i * n / k), all of k or less.

    Rows are counted per span of ``bucket_days``; only spans that hold a place of the sample are ordered, so no key is one window. A null key is a key.
    """
    columns = rows.columns
    df = rows.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit("\x00"))).withColumn("_b", F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (86_400_000_000 * bucket_days)), F.lit(1 << 40)))
    sizes = df.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_k")
    ends = sizes.select("_k", "_b", "_n", F.sum("_n").over(w).alias("_all"), F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    at = F.when(F.col("_all") > k, F.transform(steps, lambda i: F.floor(i * F.col("_all") / k)))
    places = F.transform(F.filter(at, lambda x: (x >= F.col("_from")) & (x < F.col("_from") + F.col("_n"))), lambda x: x - F.col("_from"))
    spans = ends.select("_k", "_b", places.alias("_at")).filter("_at is null or size(_at) > 0")
    place = F.row_number().over(Window.partitionBy("_k", "_b").orderBy(F.col(ts).asc_nulls_last(), item)) - 1
    picked = df.join(spans, ["_k", "_b"]).withColumn("_p", place.cast("bigint"))
    return picked.filter(F.col("_at").isNull() | F.array_contains("_at", F.col("_p"))).select(*columns)


def merge_flags(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """surviving: the ``order`` of the last row before, or itself, that is not to be merged into the one before; the first row's flag is ignored."""
    w = Window.partitionBy(*keys).orderBy(order)
    keeps = (F.row_number().over(w) == 1) | ~F.coalesce(F.col(flag), F.lit(False))
    return rows.withColumn("_k", keeps).withColumn("surviving", F.last(F.when(F.col("_k"), F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_k")


def merge_trips(sessions_of: DataFrame, *, library: str, gap_hours: float = fixed.TRIP_GAP_HOURS, max_days: float = fixed.TRIP_MAX_DAYS) -> DataFrame:
    """library, session_no, trip_no: neighbouring sessions rejoined.

    Columns: start_ts, end_ts, place, mountain_range, read_name (the place was
    read, not guessed). A session joins the trip before it if it begins within
    ``gap_hours`` of its end, the whole stays within ``max_days``, and places and
    ranges do not disagree while at least one is known. A joined trip keeps its
    place only if a session's was read. Rows of a library arrive in order, so one
    trip and one row are held at a time.
    """
    ordered = sessions_of.repartition(library).sortWithinPartitions(library, F.col("start_ts").asc_nulls_last(), "session_no")
    ordered = ordered.select(F.col(library).alias("library"), "session_no", "start_ts", "end_ts", "place", "mountain_range", "read_name")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip: dict | None = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                place = row.place if isinstance(row.place, str) and row.place else None
                area = row.mountain_range if isinstance(row.mountain_range, str) and row.mountain_range else None
                known = pd.notna(row.start_ts) and pd.notna(row.end_ts)
                joins = False
                if trip is not None and trip["library"] == row.library and known and trip["start"] is not None:
                    gap = (row.start_ts - trip["end"]).total_seconds()
                    span = (max(row.end_ts, trip["end"]) - trip["start"]).total_seconds()
                    places, areas = {trip["place"], place} - {None}, {trip["area"], area} - {None}
                    joins = 0 <= gap <= gap_hours * 3600 and span <= max_days * 86400 and len(places) <= 1 and len(areas) <= 1 and bool(places or areas)
                if joins:
                    read = trip["read"] or bool(row.read_name)
                    kept = trip["place"] if trip["read"] else place if row.read_name else None
                    trip |= {"end": max(row.end_ts, trip["end"]), "place": kept if read else None, "area": trip["area"] or area, "read": read}
                else:
                    new = trip is None or trip["library"] != row.library
                    trip = {"library": row.library, "no": 1 if new else trip["no"] + 1, "start": row.start_ts if known else None, "end": row.end_ts if known else None, "place": place, "area": area, "read": bool(row.read_name)}
                out.append((row.library, row.session_no, trip["no"]))
            yield pd.DataFrame(out, columns=["library", "session_no", "trip_no"])

    return ordered.mapInPandas(fold, "library string, session_no long, trip_no long").withColumnRenamed("library", library)


def chunks(items: DataFrame, *, partition: str, order: str, size: str, max_bytes: int = fixed.CHUNK_BYTES, max_rows: int = fixed.CHUNK_ROWS) -> DataFrame:
    """Adds chunk_no: a new chunk begins before either limit would be crossed. The running sum resets, so rows stream through one fold per partition value."""
    ordered = items.repartition(partition).sortWithinPartitions(partition, order)
    schema = ordered.schema.simpleString()[7:-1] + ",chunk_no:bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, no, rows, total = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for k, n in zip(batch[partition], batch[size]):
                n = 0 if n is None or n != n else int(n)
                if k != key:
                    key, no, rows, total = k, 1, 0, 0
                elif rows and (total + n > max_bytes or rows + 1 > max_rows):
                    no, rows, total = no + 1, 0, 0
                rows, total = rows + 1, total + n
                numbers.append(no)
            yield batch.assign(chunk_no=numbers)

    return ordered.mapInPandas(fold, schema.replace(":", " "))
