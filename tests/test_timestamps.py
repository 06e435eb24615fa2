from datetime import UTC, datetime

import numpy as np

from ridgeline.operators import timestamps as T

FILES = [("z", "Europe/Zurich"), ("d", "America/Denver"), ("n", None)]
CASES = [
    ("z", "2020-07-01T12:00:00Z", "2020-07-01T12:00:00"),
    ("z", "2020-07-01T12:00:00.123456789z", "2020-07-01T12:00:00.123456"),
    ("z", "2020-07-01T12:00:00,5", "2020-07-01T10:00:00.5"),
    ("z", "2020:07:01 12:00:00\x00", "2020-07-01T10:00:00"),
    ("n", "2020-07-01T12:00:00+0545", "2020-07-01T06:15:00"),
    ("n", "2020-07-01T12:00:00-04", "2020-07-01T16:00:00"),
    ("z", "2022-02-27T23:12:45+01:00[Europe/Paris]", "2022-02-27T22:12:45"),
    ("n", "2022-02-27T23:12:45[Europe/Paris]", "2022-02-27T22:12:45"),
    ("z", "2016-03-01 13:35:33 CET", "2016-03-01T12:35:33"),
    ("n", "2016-07-01 13:35:33 CEST", "2016-07-01T11:35:33"),
    ("d", "03/04/2021 01:02:03 PM", "2021-03-04T20:02:03"),
    ("d", "12/25/2021 12:00:00 AM", "2021-12-25T07:00:00"),
    ("z", "03/04/2021 01:02:03", "2021-04-02T23:02:03"),
    ("z", "17. April 2020, 01:58 Uhr", "2020-04-16T23:58:00"),
    ("z", "3. März 2020, 01:58 Uhr", "2020-03-03T00:58:00"),
    ("z", "23 sept. 2024 à 09h54:43", "2024-09-23T07:54:43"),
    ("z", "7 juil. 2013 à 07h29:34", "2013-07-07T05:29:34"),
    ("z", "10 juin 2022 à 13h26:46", "2022-06-10T11:26:46"),
    ("z", "12 août 2024 à 22h59:08", "2024-08-12T20:59:08"),
    ("z", "Thu, 17 Oct 2024 09:16:17 +0100", "2024-10-17T08:16:17"),
    ("z", "05.02.2022, 00:46", "2022-02-04T23:46:00"),
    ("z", "20230602_212345", "2023-06-02T19:23:45"),
    ("z", "20200721T075928Z", "2020-07-21T07:59:28"),
    ("z", "1577836800", "2020-01-01T00:00:00"),
    ("z", "1577836800123", "2020-01-01T00:00:00.123"),
    ("n", "1577836800123456", "2020-01-01T00:00:00.123456"),
    ("z", "1577836800.5", "2020-01-01T00:00:00.5"),
    ("z", " 2021-10-31T02:30:00\n", "2021-10-31T00:30:00"),  # twice: the first
    ("z", "2021-03-28T02:30:00", "2021-03-28T01:30:00"),  # skipped: forward by the skip
    ("n", "2021-03-28T02:30:00", None),
    ("z", "2021-02-30T02:30:00", None),
    ("z", "0000:00:00 00:00:00", None),
    ("z", "    :  :     :  :  ", None),
    ("z", "2021-03-28", None),
    ("z", "2021-03-28T25:00:00", None),
    ("z", "unknown", None),
    ("z", "", None),
    ("z", None, None),
    ("z", "x" * 100_000, None),
    ("absent", "2021-03-28T02:30:00", None),
    ("absent", "2021-03-28T02:30:00Z", "2021-03-28T02:30:00"),
]


def micros(text):
    return None if text is None else round(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1e6)


def test_moments(spark):
    rows = [(i, f, "taken_at", v, "clash") for i, (f, v, _) in enumerate(CASES)]
    values = spark.createDataFrame(rows, "i int, export_file string, field_name string, value string, posterior_note string")
    files = spark.createDataFrame(FILES * 2, "export_file string, home_zone string")
    got = {r.i: r for r in T.normalise(values, files).collect()}
    assert len(got) == len(CASES)
    for i, (_, v, want) in enumerate(CASES):
        assert got[i].utc_micros == micros(want), (v, got[i])
    assert got[33].status == "date_only" and got[29].status == "no_zone" and got[35].status == "none"


def test_empty(spark):
    values = spark.createDataFrame([], "export_file string, field_name string, value string")
    files = spark.createDataFrame([], "export_file string, home_zone string")
    assert T.normalise(values, files).count() == 0


def test_weights_follow_certain_values():
    day, month = T.NAMES.index("slash_day_first"), T.NAMES.index("slash_month_first")
    both, only_month = (1 << day) | (1 << month), 1 << month
    w = T.fit_weights(np.array([both, only_month]), np.array([50.0, 50.0]), np.ones(len(T.NAMES)))
    assert w[month] > 0.85 > 0.1 > w[day]
    assert abs(w.sum() - 1) < 1e-9
    assert abs(T.fit_weights(np.array([], dtype=int), np.array([]), np.ones(3)).sum() - 1) < 1e-9


def test_sources_of_unknown_zone_are_fitted(spark):
    """Their values name offsets; certain dates of the same source decide the order of the others."""
    values = [("month", f"0{d % 9 + 1}/{d + 13}/2021 10:00 +00:00") for d in range(15)] + [("month", "03/04/2021 10:00 +00:00")]
    values += [("day", f"{d + 13}/0{d % 9 + 1}/2021 10:00 +00:00") for d in range(15)] + [("day", "03/04/2021 10:00 +00:00"), ("alone", "03/04/2021 10:00 +00:00"), ("zoned", "03/04/2021 10:00")]
    # a known zone settles the order, whatever the source's certain dates say
    values += [("zoned", f"{d + 13}/0{d % 9 + 1}/2021 10:00") for d in range(15)]
    df = spark.createDataFrame([(f, "taken_at", v) for f, v in values], "export_file string, field_name string, value string")
    files = spark.createDataFrame([("month", None), ("day", None), ("alone", None), ("zoned", "America/New_York")], "export_file string, home_zone string")
    read = lambda rounds: {r.export_file: r for r in T.normalise(df, files, rounds=rounds, sure=0.9).filter("value LIKE '03/04/2021 10:00%'").collect()}
    fitted, unfitted = read(50), read(0)
    april, march = micros("2021-04-03T10:00:00"), micros("2021-03-04T10:00:00")
    assert (fitted["month"].utc_micros, fitted["day"].utc_micros, fitted["alone"].utc_micros) == (march, april, april)
    assert [fitted[f].status for f in ("month", "day", "alone", "zoned")] == ["resolved", "resolved", "ambiguous", "resolved"]
    assert fitted["zoned"].component == "slash_month_first"
    assert unfitted["month"].utc_micros == april and unfitted["month"].status == "ambiguous"
