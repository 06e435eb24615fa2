"""Exact and near duplicates of photos, and their keepers."""

from __future__ import annotations

from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.functions.time import seconds_between


def _rank(column: str, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, n in ranks.items():
        out = F.when(F.col(column) == value, n).otherwise(out)
    return out


def exact_roles(photos: DataFrame, key: str = "content_key", path: str = "source_path") -> DataFrame:
    """path, role (keep or exact), duplicate_of of photos that share a key. Keepers by aggregation, so a key of a third of all photos is no hot group."""
    pixels = F.coalesce(F.col("width").cast("bigint") * F.col("height").cast("bigint"), F.lit(0))
    score = F.struct((-pixels).alias("a"), (-F.coalesce("size_bytes", F.lit(-1))).alias("b"), F.when(F.col("timestamp_source") == "exif", 0).otherwise(1).alias("c"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 0).otherwise(1).alias("d"), F.col(path).alias("path"))
    best = photos.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(score).alias("_b"), F.count("*").alias("_n")).filter("_n > 1").select(key, F.col("_b.path").alias("keeper"))
    members = photos.join(best, key)
    keeps = F.col(path) == F.col("keeper")
    return members.select(F.col(path).alias("source_path"), F.when(keeps, "keep").otherwise("exact").alias("role"), F.when(~keeps, F.col("keeper")).alias("duplicate_of"))


def sign_bits(vector: Column) -> Column:
    """The signs of the first 64 numbers of a vector as the bits of a long, first number highest."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("bigint"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))


def usable_hash(h: Column) -> Column:
    """Flat pictures have too few or too many bits."""
    return F.bit_count(h).between(fixed.NEAR_MIN_BITS, fixed.NEAR_MAX_BITS)


def near_classes(items: DataFrame, *, item: str, phash: str, ts: str, hours: float = fixed.NEAR_WINDOW_HOURS, band_bits: int = 16) -> DataFrame:
    """band, h, cell, first, t0, t1: items of one hash in one span of ``hours`` are all near each other and so are one class, named by its first item; items of unknown time, which are near any, are a class of their own."""
    rows = items.select(F.col(item).alias("item"), F.col(phash).alias("h"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter(F.col("h").isNotNull() & usable_hash(F.col("h")))
    rows = rows.withColumn("cell", F.floor(F.col("t") / (hours * 3.6e9)))
    return rows.groupBy(F.shiftrightunsigned("h", 64 - band_bits).alias("band"), "h", "cell").agg(F.min("item").alias("first"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def near_members(items: DataFrame, *, item: str, phash: str, ts: str, hours: float = fixed.NEAR_WINDOW_HOURS) -> DataFrame:
    """item, first: the class of every item with a usable hash."""
    cell = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (hours * 3.6e9))
    rows = items.select(F.col(item).alias("item"), F.col(phash).alias("h"), cell.alias("cell"))
    classes = near_classes(items, item=item, phash=phash, ts=ts, hours=hours).select(F.col("h").alias("_h"), F.col("cell").alias("_cell"), "first")
    return rows.join(classes, (F.col("h") == F.col("_h")) & F.col("cell").eqNullSafe(F.col("_cell"))).select("item", "first")


def near_pairs(items: DataFrame, *, item: str, phash: str, ts: str, bits: int = fixed.NEAR_BITS, hours: float = fixed.NEAR_WINDOW_HOURS, band_bits: int = 16) -> DataFrame:
    """item_a < item_b, bits: pairs of classes (:func:`near_classes`) of one band, the hash's top bits, at most ``bits`` apart, of which some members are not more than ``hours`` apart in time.

    Every link between items of different classes is one of a pair of classes; links inside a class follow from its members, so no hash is written out pair by pair. The closest members of two classes are the last of the earlier and the first of the later, so the pair is decided by the classes' first and last times.
    """
    classes = near_classes(items, item=item, phash=phash, ts=ts, hours=hours, band_bits=band_bits)
    side = lambda df, x: df.select("band", "cell", F.col("h").alias(f"h{x}"), F.col("first").alias(f"item_{x}"), F.col("t0").alias(f"from_{x}"), F.col("t1").alias(f"to_{x}"))
    timed, untimed = classes.filter("cell is not null"), classes.filter("cell is null")
    # classes near in time lie in one span or in two that touch
    beside = timed.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    apart = F.greatest(F.col("from_b") - F.col("to_a"), F.col("from_a") - F.col("to_b"), F.lit(0))
    near = side(timed, "a").join(side(beside, "b"), ["band", "cell"]).filter((F.col("item_a") < F.col("item_b")) & (apart <= hours * 3.6e9))
    any_time = side(untimed, "a").drop("cell").join(side(classes, "b"), "band").filter((F.col("item_a") < F.col("item_b")) | (F.col("cell").isNotNull() & (F.col("item_a") != F.col("item_b"))))
    both = near.select("ha", "hb", "item_a", "item_b").unionByName(any_time.select("ha", "hb", "item_a", "item_b"))
    both = both.withColumn("bits", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))).filter(F.col("bits") <= bits)
    return both.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "bits")


def near_pieces(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` (band, t) with ``piece``: runs of a band's rows that can share no group, being more than ``window`` apart in time. A band with a row of unknown time, which passes with any, is one piece, null."""
    rows = rows.withColumn("_s", F.expr(f"t div {window}L"))
    w = Window.partitionBy("band").orderBy("_s")
    # two spans with an empty one between them are more than the window apart
    spans = rows.filter("t is not null").select("band", "_s").distinct().withColumn("_from", F.when(F.coalesce(F.col("_s") - F.lag("_s").over(w) >= 2, F.lit(True)), F.col("_s")))
    spans = spans.select("band", "_s", F.max("_from").over(w).alias("piece"))
    untimed = rows.filter("t is null").select("band").distinct().withColumn("_u", F.lit(True))
    rows = rows.join(spans, ["band", "_s"], "left").join(untimed, "band", "left")
    return rows.withColumn("piece", F.when(F.col("_u").isNull(), F.col("piece"))).drop("_s", "_u")


def near_groups(items: DataFrame, *, item: str, phash: str, ts: str, bits: int = fixed.NEAR_BITS, hours: float = fixed.NEAR_WINDOW_HOURS) -> DataFrame:
    """item, seed: greedy complete linkage within a band, in order of ``item``: a member is within the limits of every member before it.

    A band is split where no two rows are near in time; a piece's rows are folded one at a time, against the groups whose seed is near in time. The order decides, so a piece is one task: one hash at every time of a library, or rows of unknown time, make it large.
    """
    window = max(1, int(hours * 3.6e9))
    rows = items.select(F.col(item).alias("item"), F.col(phash).alias("h"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter(F.col("h").isNotNull() & usable_hash(F.col("h"))).withColumn("band", F.shiftrightunsigned("h", 48))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        groups: list[list[tuple]] = []
        by_span: dict[int | None, list[int]] = {}
        for r in rows.itertuples(index=False):
            span = None if pd.isna(r.t) else int(r.t // window)
            near = range(len(groups)) if span is None else merge(*[by_span.get(x, ()) for x in (None, span - 1, span, span + 1)])
            for g in (groups[i] for i in near):
                if all(bin((r.h ^ h) & (2**64 - 1)).count("1") <= bits and (pd.isna(r.t) or pd.isna(t) or abs(r.t - t) <= hours * 3.6e9) for _, h, t in g):
                    g.append((r.item, r.h, r.t))
                    break
            else:
                by_span.setdefault(span, []).append(len(groups))
                groups.append([(r.item, r.h, r.t)])
        return pd.DataFrame([(m[0], g[0][0]) for g in groups if len(g) > 1 for m in g], columns=["item", "seed"])

    kind = dict(rows.dtypes)["item"]
    return near_pieces(rows, window).groupBy("band", "piece").applyInPandas(fold, f"item {kind}, seed {kind}")


def photographic_order() -> list[Column]:
    """By sharpness, gaze, fewer closed eyes, composition, rating, exposure."""
    return [
        F.desc(_rank("sharpness", fixed.SHARPNESS_RANK, 1)), F.desc(_rank("gaze", fixed.GAZE_RANK, 1)), F.asc(F.coalesce("eyes_closed_count", F.lit(0))),
        F.desc(_rank("composition", fixed.COMPOSITION_RANK, 1)), F.desc(F.coalesce("aesthetic_score", F.lit(0))), F.desc(F.coalesce(F.col("exposure") == "good", F.lit(False))),
    ]


def elect(members: DataFrame, group: str, *tie: str) -> DataFrame:
    """group, keeper row and judged members of groups with two or more judged members (``judged`` true)."""
    judged = members.filter("judged")
    w = Window.partitionBy(group).orderBy(*photographic_order(), *tie)
    return judged.withColumn("n_judged", F.count("*").over(Window.partitionBy(group))).withColumn("_r", F.row_number().over(w)).filter("_r = 1 and n_judged >= 2").drop("_r")


def _best(when: Column, *keys: Column) -> Column:
    """The last of ``keys`` of the member that has the least of them, among those with ``when``."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return F.min(F.when(when, F.struct(*named)))[f"k{len(keys) - 1}"]


def metadata_keys(path: str) -> list[Column]:
    """Keys whose least is the member with most pixels, most bytes, an EXIF time and a position; of equals the first path."""
    pixels = F.coalesce(F.col("width").cast("bigint") * F.col("height").cast("bigint"), F.lit(0))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    return [-pixels, -F.coalesce(F.col("size_bytes"), F.lit(-1)), flag(F.col("timestamp_source") == "exif"), flag(F.col("lat").isNotNull() & F.col("lon").isNotNull()), F.col(path)]


def reelect(members: DataFrame, group: str, path: str, *, measure: str) -> DataFrame:
    """group, before, keeper, reason: the keeper of every group. If two or more members are judged, the best judged one; else, if two or more have a ``measure`` of sharpness, the one with the largest; else the one by metadata, which is ``before``. Ties go to the keeper by metadata keys. One aggregation with map-side combining."""
    keys = metadata_keys(path)
    photographic = [-_rank("sharpness", fixed.SHARPNESS_RANK, 1), -_rank("gaze", fixed.GAZE_RANK, 1), F.coalesce("eyes_closed_count", F.lit(0)), -_rank("composition", fixed.COMPOSITION_RANK, 1), -F.coalesce("aesthetic_score", F.lit(0)), F.when(F.coalesce(F.col("exposure") == "good", F.lit(False)), 0).otherwise(1)]
    judged, measured = F.coalesce("judged", F.lit(False)), F.col(measure).isNotNull()
    best = members.groupBy(group).agg(_best(F.lit(True), *keys).alias("before"), _best(judged, *photographic, *keys).alias("_j"), _best(measured, -F.col(measure), *keys).alias("_m"), F.count_if(judged).alias("_nj"), F.count_if(measured).alias("_nm"))
    by = lambda j, m, other: F.when(F.col("_nj") >= 2, j).when(F.col("_nm") >= 2, m).otherwise(other)
    return best.select(group, "before", by(F.col("_j"), F.col("_m"), F.col("before")).alias("keeper"), by(F.lit("judged"), F.lit("measured"), F.lit("metadata")).alias("reason"))
