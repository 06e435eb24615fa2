from datetime import datetime

from ridgeline.llm import survivorship as S

T = datetime(2024, 1, 1)
PHOTOS = "scan_row_id long, source_path string, size_bytes long, taken_ts timestamp_ntz, timestamp_source string, lat double, lon double, width int, height int, camera_model string, scanned_at timestamp_ntz, group_id long"


def test_fields(spark):
    photos = spark.createDataFrame([
        (1, "a", 10, None, "none", None, 7.0, 10, 10, " ", T, 5),
        (2, "b", 10, T, "mtime", 46.0, 7.0, 10, 10, "V", T, 5),
        (3, "c", None, T, "filename", None, None, 100, None, None, T, 5),
        (4, "d", 1, T, "exif", None, None, 100, 100, None, datetime(2023, 1, 1), 5),
        (5, "d", 1, T, "exif", None, None, 1, 1, None, T, 5),
        (6, "d", 1, T, "exif", None, None, 2, 1, None, T, 5),
        (7, "e", 10, None, None, None, 7.0, 10, 10, None, T, 5),
        (8, None, 1, None, None, None, None, 1, 1, None, T, 5),
    ], PHOTOS)
    groups = spark.createDataFrame([
        (1, ["a", "b", "c", "d", "b", None, "absent"], T), (1, ["a"], datetime(2023, 1, 1)), (1, ["a", "b", "c", "d"], T),
        (2, ["e", "a"], T), (2, ["e", "a"], T), (3, None, T), (4, [None], T), (6, ["absent"], T), (None, ["a"], T), (7, ["a", "b"], None),
    ], "group_id long, photos array<string>, found_at timestamp_ntz")
    got = {(r.group_id, r.field_name): r.source_path for r in S.survivors(groups, photos).collect()}
    assert got == {(1, "record"): "b", (1, "position"): "b", (1, "camera_model"): "b", (1, "taken_ts"): "d", (2, "record"): "a", (7, "record"): "b", (7, "position"): "b", (7, "camera_model"): "b", (7, "taken_ts"): "b"}
    assert S.golden_records(groups, photos).count() == 3
    assert S.survivors(groups.limit(0), photos).count() == 0 and S.survivors(groups, photos.limit(0)).count() == 0
