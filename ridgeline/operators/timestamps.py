"""Mixed timestamp formats and time zones, to one UTC moment per value.

Each value is written in one of a few *formats* (the mixture's components). A
value contributes likelihood to every component under which it is a valid
moment; most have one, slash dates with two small numbers have two. Per source
(one export file and field) the mixture weights are fitted by
expectation-maximisation over the counts of each set of valid components, with
a Dirichlet prior that carries what is known of the source's zone. A known zone
fixes the order of its slash dates, so the prior is decisive there; a source of
unknown zone, whose values may still name an offset, is fitted from its own
certain dates. Posteriors choose the reading; a reading whose posterior stays
below ``sure`` is marked ``ambiguous`` and still reported with its probability.

All parsing is built-in expressions (one regular expression per component, in
code generation); only the weights of each source are fitted in an Arrow UDF,
over one small row per source, so a source with a third of all rows is counted
map-side first and costs no more than any other.

Defined cases: null, empty, blank and unknown words are ``none``; a date
without hour and minute is ``date_only``; impossible calendar or clock values
are ``none``; a wall time without any zone is ``no_zone``. None of these has a
moment. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\u0001"
#: Zone of a value: letter, offset or abbreviation, then a bracketed zone.
_ZONE = r"\s*(Z|z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?\s*(?:\[([A-Za-z0-9_+\-/]+)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: component, pattern, groups in the order year month day hour minute second fraction half zone bracket; 0: none.
COMPONENTS: list[tuple[str, str, list[int]]] = [
    ("year_first", rf"^(\d{{4}})[-:/.](\d{{1,2}})[-:/.](\d{{1,2}})[Tt ]\s*{_CLOCK}{_ZONE}$", [1, 2, 3, 4, 5, 6, 7, 0, 8, 9]),
    ("compact", rf"^([12]\d{{3}})([01]\d)([0-3]\d)[Tt_ -]?([0-2]\d)([0-5]\d)(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", [1, 2, 3, 4, 5, 6, 7, 0, 8, 9]),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})[, ]\s*{_CLOCK}(?: Uhr)?{_ZONE}$", [3, 2, 1, 4, 5, 6, 7, 0, 8, 9]),
    ("slash_day_first", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[, ]\s*{_CLOCK}\s*([AaPp][Mm])?{_ZONE}$", [3, 2, 1, 4, 5, 6, 7, 8, 9, 10]),
    ("slash_month_first", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[, ]\s*{_CLOCK}\s*([AaPp][Mm])?{_ZONE}$", [3, 1, 2, 4, 5, 6, 7, 8, 9, 10]),
    ("month_name", rf"^(?:[\p{{L}}]{{2,9}}\.?,?\s+)?(\d{{1,2}})\.?[ -]([\p{{L}}]{{3,10}})\.?[ -](\d{{4}})(?:,| à| at| um)?\s+(\d{{1,2}})[h:](\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?: Uhr)?\s*([AaPp][Mm])?{_ZONE}$", [3, 2, 1, 4, 5, 6, 7, 8, 9, 10]),
]
EPOCHS = [("epoch_s", r"^-?\d{9,10}(?:[.,]\d+)?$", 1_000_000), ("epoch_ms", r"^-?\d{12,13}$", 1_000), ("epoch_us", r"^-?\d{15,16}$", 1), ("epoch_ns", r"^-?\d{18,19}$", -1_000)]
NAMES = [n for n, _, _ in COMPONENTS] + [n for n, _, _ in EPOCHS]
#: First letters of month names in the six languages, longest match wins.
MONTHS = {
    1: ("jan", "janv", "ene", "gen"), 2: ("feb", "févr", "fev", "fevr"), 3: ("mar", "mär", "mars", "märz", "mrz"), 4: ("apr", "avr", "abr"), 5: ("may", "mai", "mag"), 6: ("jun", "juin", "giu"),
    7: ("jul", "juil", "lug"), 8: ("aug", "août", "aou", "ago"), 9: ("sep", "sept", "set"), 10: ("oct", "okt", "ott"), 11: ("nov",), 12: ("dec", "dez", "déc", "des", "dic"),
}
#: Fixed offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "NPT": 345,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "JST": 540,
}
DAY, MICROS = 86_400_000_000, 1_000_000


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _lookup(entries: dict[str, int], key: Column) -> Column:
    """The entry of a small literal map, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in entries.items() for x in pair]), key)


def _month(c: Column) -> Column:
    """Month number of a name or of digits; names are told apart by three letters without accents, juin and juillet by four."""
    plain = F.translate(F.lower(c), "éûä", "eua")
    fold = str.maketrans("éûä", "eua")
    heads = {h.translate(fold)[:3]: n for n, names in MONTHS.items() for h in names if not h.startswith("jui")}
    return F.coalesce(_int(c), _lookup({"juin": 6, "juil": 7}, F.substring(plain, 1, 4)), _lookup(heads, F.substring(plain, 1, 3)))


def _offset(zone: Column) -> Column:
    """Minutes east of UTC that a zone text fixes; null if it fixes none."""
    digits = F.regexp_replace(zone, r"^(?:UTC|GMT)?[+-]|:", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    return F.when(zone.rlike("[+-]"), F.when(zone.contains("-"), -minutes).otherwise(minutes)).otherwise(_lookup(ABBREVIATIONS | {"Z": 0}, F.upper(zone)))


def clean(value: Column) -> Column:
    """Without NULs and white space at either end."""
    return F.regexp_replace(value, r"^[\s\x00 ]+|[\s\x00 ]+$", "")


def with_readings(df: DataFrame, value: str) -> DataFrame:
    """Adds ``mask`` (bit i set if component i of NAMES reads the value) and its readings: ``_wall`` and, of a slash date, ``_wall_month`` with the month first, each in micros, with ``_offset`` and ``_zone``.

    The patterns exclude each other but for the two slash orders, so the parts are cut out once and resolved once.
    """
    v = F.col("_v")
    df = df.withColumn("_v", clean(F.col(value)))
    slash, slash_month = NAMES.index("slash_day_first"), NAMES.index("slash_month_first")
    which = None
    for i, pattern in [(i, p) for i, (_, p, _) in enumerate(COMPONENTS) if i != slash_month] + [(len(COMPONENTS) + i, p) for i, (_, p, _) in enumerate(EPOCHS)]:
        which = (which if which is not None else F).when(v.rlike(pattern), i)
    df = df.withColumn("_c", which)
    parts = None
    for i, (_, pattern, order) in enumerate(COMPONENTS):
        if i != slash_month:
            parts = (parts if parts is not None else F).when(F.col("_c") == i, F.split(F.regexp_replace(v, pattern, SEP.join(f"${g}" if g else "" for g in order)), SEP))
    df = df.withColumn("_p", parts)
    get = lambda i: F.col("_p").getItem(i)
    df = df.select("*", _month(get(1)).alias("_mo"), _int(get(2)).alias("_d"), _int(get(3)).alias("_h"), _int(get(4)).alias("_mi"), F.coalesce(_int(get(5)), F.lit(0)).alias("_se"), F.upper(get(7)).alias("_half"), _offset(get(8)).alias("_offset"), F.when(get(9) != "", get(9)).alias("_zone"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = lambda m, d: F.unix_date(F.concat_ws("-", get(0), two(m), two(d)).try_cast("date")).cast("bigint") * DAY
    hour = F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "PM", 12).otherwise(0))
    fraction = F.when(get(6) != "", F.rpad(F.substring(get(6), 1, 6), 6, "0").try_cast("bigint")).otherwise(0)
    clock = F.when((hour <= 23) & (F.col("_mi") <= 59) & (F.col("_se") <= 59) & ((get(8) == "") | F.col("_offset").isNotNull()), (hour * 3600 + F.col("_mi") * 60 + F.col("_se")).cast("bigint") * MICROS + fraction)
    month_known = lambda m, d: F.when(m.isNotNull() & d.isNotNull(), date(m, d))
    df = df.select("*", clock.alias("_clock"), month_known(F.col("_mo"), F.col("_d")).alias("_date"), F.when(F.col("_c") == slash, month_known(F.col("_d"), F.col("_mo"))).alias("_date_month"))
    whole, frac = F.regexp_extract(v, r"^(-?\d+)", 1).try_cast("bigint"), F.regexp_extract(v, r"[.,](\d+)$", 1)
    epoch = None
    for i, (_, _, scale) in enumerate(EPOCHS):
        micros = F.floor(whole / F.lit(-scale)) if scale < 0 else whole * F.lit(scale)
        epoch = (epoch if epoch is not None else F).when(F.col("_c") == len(COMPONENTS) + i, micros.cast("bigint"))
    epoch = epoch + F.when(frac != "", F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("bigint")).otherwise(0)
    is_epoch = F.col("_c") >= len(COMPONENTS)
    df = df.select("*", F.when(is_epoch, epoch).otherwise(F.col("_date") + F.col("_clock")).alias("_wall"), (F.col("_date_month") + F.col("_clock")).alias("_wall_month"))
    df = df.withColumn("_offset", F.when(is_epoch, 0).otherwise(F.col("_offset")))
    mask = F.when(F.col("_wall").isNotNull(), F.expr("shiftleft(1, _c)")).otherwise(0) + F.when(F.col("_wall_month").isNotNull(), 1 << slash_month).otherwise(0)
    return df.withColumn("mask", mask).drop("_p", "_mo", "_d", "_h", "_mi", "_se", "_half", "_clock", "_date", "_date_month")


def fit_weights(masks: np.ndarray, counts: np.ndarray, prior: np.ndarray, rounds: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Mixture weights by EM: the E-step shares each mask's count among its valid components in proportion to the weights, the M-step renormalises with the prior's pseudo-counts."""
    valid = (masks[:, None] >> np.arange(len(prior))) & 1 if len(masks) else np.zeros((0, len(prior)))
    weights = prior / prior.sum()
    for _ in range(rounds):
        like = valid * weights
        total = like.sum(1, keepdims=True)
        share = np.divide(like, total, out=np.zeros_like(like, dtype=float), where=total > 0)
        new = (counts[:, None] * share).sum(0) + prior
        new = new / new.sum()
        if np.abs(new - weights).max() < tol:
            return new
        weights = new
    return weights


def source_weights(readings: DataFrame, sources: DataFrame, keys: list[str], strength: float = 1e6, rounds: int = 50) -> DataFrame:
    """Mixture weights per source. ``sources`` has the keys' first column and ``home_zone``; the prior puts ``strength`` pseudo-counts on the slash order that the zone uses, as a whole file shares one."""
    day, month = NAMES.index("slash_day_first"), NAMES.index("slash_month_first")

    @F.pandas_udf("array<double>")
    def weights(stats: pd.Series, zone: pd.Series) -> pd.Series:
        out = []
        for rows, z in zip(stats, zone):
            prior = np.ones(len(NAMES))
            if z is not None:
                prior[month if str(z).startswith("America/") else day] += strength
            out.append(fit_weights(np.array([r["mask"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=float), prior, rounds))
        return pd.Series(out)

    # one row per source holds at most 2 ** len(NAMES) masks, whatever the number of its values
    # (no filter on mask: it would be pushed down and evaluate the whole parse twice; the UDF passes over mask 0)
    stats = readings.groupBy(*keys, "mask").agg(F.count("*").alias("n"))
    stats = stats.groupBy(*keys).agg(F.collect_list(F.struct("mask", "n")).alias("stats"))
    return stats.join(sources.select(keys[0], "home_zone"), keys[0], "left").select(*keys, weights("stats", "home_zone").alias("weights"))


def normalise(values: DataFrame, sources: DataFrame, *, source: str = "export_file", field: str = "field_name", value: str = "value", sure: float = 0.99, rounds: int = 50) -> DataFrame:
    """Adds status, component, posterior and utc_micros to ``values``.

    ``sources`` maps ``source`` to ``home_zone``. status is ``resolved``, ``ambiguous`` (resolved to the likelier reading, posterior below ``sure``), ``no_zone``, ``date_only`` or ``none``.
    """
    spark = values.sparkSession
    zones = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    sources = sources.select(source, "home_zone").dropDuplicates([source])
    readings = with_readings(values, value)
    fitted = source_weights(readings.select(source, field, "mask"), sources, [source, field], rounds=rounds)
    # sources and weights are far smaller than the values: they meet first, the values are shuffled once
    side = fitted.groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct(F.col(field), F.col("weights")))).alias("_w"))
    side = sources.join(side, source, "left")
    df = readings.join(side, source, "left")
    slash, slash_month = NAMES.index("slash_day_first"), NAMES.index("slash_month_first")
    df = df.withColumn("_w", F.element_at(F.col("_w"), F.col(field)))
    weight = lambda i: F.coalesce(F.col("_w").getItem(i), F.lit(1.0 / len(NAMES)))
    day_p = F.when(F.col("_wall").isNotNull(), weight(slash)).otherwise(0.0)
    month_p = F.when(F.col("_wall_month").isNotNull(), weight(slash_month)).otherwise(0.0)
    df = df.withColumn("_pm", F.when(F.col("_c") == slash, month_p / (day_p + month_p)).otherwise(0.0))
    by_month = F.col("_pm") > 0.5
    df = df.select("*", F.when(by_month, F.col("_wall_month")).otherwise(F.col("_wall")).alias("_r"), F.when(F.col("mask") > 0, F.when(by_month, F.col("_pm")).otherwise(1 - F.col("_pm"))).alias("posterior"))
    df = df.withColumn("component", F.when(F.col("mask") > 0, F.element_at(F.array(*map(F.lit, NAMES)), F.when(by_month, slash_month).otherwise(F.col("_c")) + 1)))
    zone = F.coalesce(F.col("_zone"), F.col("home_zone"))
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_r"), F.when(zone.isin(zones), zone)))
    utc = F.when(F.col("_offset").isNotNull(), F.col("_r") - F.col("_offset").cast("bigint") * 60 * MICROS).otherwise(local)
    df = df.withColumn("utc_micros", utc)
    dated = F.col("_v").rlike(r"^(\d{4}[-:/.]\d{1,2}[-:/.]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{8})$")
    status = F.when(F.col("mask") == 0, F.when(dated, "date_only").otherwise("none")).when(F.col("utc_micros").isNull(), "no_zone").when(F.col("posterior") < sure, "ambiguous").otherwise("resolved")
    return df.withColumn("status", F.coalesce(status, F.lit("none"))).select(*values.columns, "status", "component", "posterior", "utc_micros")


def stacked(analysis: DataFrame) -> DataFrame:
    """analysis_id, export_file, field_name, value of both time fields."""
    return analysis.select("analysis_id", "export_file", F.explode(F.map_from_arrays(F.array(F.lit("taken_at"), F.lit("analysed_at")), F.array("taken_at", "analysed_at"))).alias("field_name", "value"))
