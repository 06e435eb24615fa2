"""Many weak claims about one session into one defensible answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.functions.geo import haversine_km, valid_position
from ridgeline.operators.spatial import near


def _choice(column: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for value, x in table.items():
        out = F.when(column == value, x).otherwise(out)
    return out


def strength(basis: Column, confidence: Column) -> Column:
    """How far one claim can be trusted. A claim without a basis is taken for a recognition of terrain."""
    counted = F.when(basis.isNull() | basis.isin("none", "generic_inference", ""), "landmark_recognition").otherwise(basis)
    return F.least(F.lit(fixed.MAX_SINGLE_CLAIM), _choice(counted, fixed.PEAK_PRIOR, 0.0) * _choice(confidence, fixed.CONFIDENCE_NUDGE, 1.0))


def combined(strengths: Column) -> Column:
    """Noisy or of an array of strengths, each further claim discounted by its rank."""
    ranked = F.transform(F.sort_array(strengths, asc=False), lambda s, i: 1 - s * F.pow(F.lit(fixed.CORROBORATION_DECAY), i))
    return 1 - F.aggregate(ranked, F.lit(1.0), lambda acc, x: acc * x)


def ranked_peaks(claims: DataFrame, session: str, *, keep: int = 64) -> DataFrame:
    """session, peak, probability, n_claims, rank. Claims are counted by strength first (few values exist), and claims beyond ``keep`` of one strength are worth less than 1e-13 together, so a session of any size aggregates to a bounded array."""
    rows = claims.filter("peak is not null and peak <> ''").withColumn("s", strength(F.col("basis"), F.col("confidence")))
    counts = rows.groupBy(session, "peak", "s").agg(F.count("*").alias("n"))
    arrays = counts.groupBy(session, "peak").agg(F.flatten(F.collect_list(F.array_repeat("s", F.least("n", F.lit(keep)).cast("int")))).alias("a"), F.sum("n").alias("n_claims"))
    scored = arrays.select(session, "peak", F.round(combined(F.col("a")), 12).alias("probability"), "n_claims")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("probability"), "peak")))


def contradicted(claims: DataFrame, anchors: DataFrame, session: str, claim: str, max_km: float = fixed.CONTRADICTION_KM) -> DataFrame:
    """Claim ids that were recognised, not read, name none of the session's anchors and lie further than ``max_km`` from all of them. ``anchors``: session, name, lat, lon (distinct names read in a session: few)."""
    open_claims = claims.filter(F.col("peak").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.coalesce(F.col("basis").isin("sign_in_scene", "printed_page"), F.lit(False)))
    met = open_claims.join(anchors.select(session, F.col("name").alias("_n"), F.col("lat").alias("_la"), F.col("lon").alias("_lo")), session)
    per = met.groupBy(claim).agg(F.min(haversine_km(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))).alias("nearest_km"), F.max(F.col("peak") == F.col("_n")).alias("_named"))
    return per.filter((F.col("nearest_km") > max_km) & ~F.col("_named")).select(claim, "nearest_km")


def consensus(points: DataFrame, session: str, order: str, *, agreement_km: float = fixed.AGREEMENT_KM, least: int = fixed.MIN_AGREEING, share: float = fixed.MIN_FRACTION) -> DataFrame:
    """session, lat, lon, agreeing, considered: the medoid of the largest neighbourhood of estimates, if enough of them agree; of equal ones the first by ``order``.

    Equal positions are one point with a weight. Neighbours are met within cells of a grid, not all against all; only the largest neighbourhood's own distances are summed.
    """
    p = points.filter(valid_position(F.col("lat"), F.col("lon"))).groupBy(session, "lat", "lon").agg(F.count("*").alias("w"), F.min(order).alias("first"))
    weights = p.select(session, F.col("first").alias("other"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), F.col("w").alias("wb"))
    pairs = near(p, p.withColumnRenamed("first", "other"), agreement_km, point=("first", "lat", "lon"), target=("other", "lat", "lon"), by=session).select(session, "first", "other")
    size = pairs.join(weights.select(session, "other", "wb"), [session, "other"]).groupBy(session, "first").agg(F.sum("wb").alias("n"))
    best = size.groupBy(session).agg(F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("s"))
    total = p.groupBy(session).agg(F.sum("w").alias("considered"))
    chosen = best.join(total, session).filter((-F.col("s.n") >= least) & (-F.col("s.n") / F.col("considered") >= share)).select(session, F.col("s.first").alias("first"), (-F.col("s.n")).alias("agreeing"), "considered")
    members = chosen.join(pairs, [session, "first"]).drop("first").join(weights, [session, "other"]).select(session, "lb", "ob", "wb", F.col("other").alias("fb"), "agreeing", "considered")
    # the medoid: distances within one neighbourhood, of distinct positions
    x = members.select(session, F.col("lb").alias("x1"), F.col("ob").alias("y1"), F.col("fb").alias("f1"), "agreeing", "considered")
    y = members.select(session, F.col("lb").alias("x2"), F.col("ob").alias("y2"), F.col("wb").alias("w2"))
    cost = x.join(y, session).groupBy(session, "x1", "y1", "f1", "agreeing", "considered").agg(F.sum(haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) * F.col("w2")).alias("d"))
    by = F.struct(F.when(F.col("agreeing") <= 2, 0.0).otherwise(F.round("d", 9)).alias("d"), "f1", "x1", "y1")
    return cost.groupBy(session, "agreeing", "considered").agg(F.min(by).alias("m")).select(session, F.col("m.x1").alias("lat"), F.col("m.y1").alias("lon"), "agreeing", "considered")
