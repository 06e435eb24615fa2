import struct

import pytest
from pyspark.sql import functions as F

from ridgeline.sources import files as S


def entry(tag, kind, count, value):
    return struct.pack("<HHI", tag, kind, count) + value


def jpeg(thumb=b""):
    """A JPEG header with camera, times, size and position, little endian."""
    blocks, base = b"", 8

    def later(data):
        nonlocal blocks
        at = base + 400 + len(blocks)
        blocks += data
        return struct.pack("<I", at)

    exif = [entry(0x9003, 2, 20, later(b"2025:07:12 08:31:45\x00")), entry(0xA002, 4, 1, struct.pack("<I", 4000)), entry(0xA003, 3, 1, struct.pack("<HH", 3000, 0))]
    dms = lambda *x: later(b"".join(struct.pack("<II", round(v * 100), 100) for v in x))
    gps = [entry(1, 2, 2, b"S\x00\x00\x00"), entry(2, 5, 3, dms(46, 30, 36)), entry(3, 2, 2, b"E\x00\x00\x00"), entry(4, 5, 3, dms(7, 15, 0))]
    folder = lambda es: struct.pack("<H", len(es)) + b"".join(es) + struct.pack("<I", 0)
    first = [entry(0x010F, 2, 4, b"Abc\x00"), entry(0x0110, 2, 8, later(b"Model 7\x00")), entry(0x8769, 4, 1, struct.pack("<I", base + 100)), entry(0x8825, 4, 1, struct.pack("<I", base + 200))]
    body = folder(first).ljust(100, b"\x00") + folder(exif).ljust(100, b"\x00") + folder(gps).ljust(200, b"\x00") + blocks
    return b"\xff\xd8\xff\xe1\x00\x00Exif\x00\x00II*\x00" + struct.pack("<I", 8) + body + thumb + b"\xff\xda rest"


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a/x.jpg": jpeg(), "a/IMG_20250712_083145.JPG": b"\xff\xd8 no header", "b/y.jpg": jpeg()[:300], ".hidden.jpg": b"x", "plain": b"", "notes.txt": b"text", "Skip/z.jpg": jpeg(), "b/empty.png": b""}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def test_walk_and_survey(spark, folder):
    rows = {r.path.split("/in/")[1]: (r.reason, r.size_bytes) for r in S.walk(spark, str(folder / "in"), ["skip"]).collect()}
    assert {k: v[0] for k, v in rows.items()} == {"a/x.jpg": None, "a/IMG_20250712_083145.JPG": None, "b/y.jpg": None, ".hidden.jpg": "hidden file", "plain": "no extension", "notes.txt": "not an image", "b/empty.png": None}
    got = {r.ext: r.n for r in S.survey(S.walk(spark, str(folder / "in"))).collect()}
    assert got == {".jpg": 4, "other": 3, ".png": 1}


def test_scan(spark, folder):
    got = {r.path.split("/in/")[1]: r for r in S.scan(spark, str(folder / "in"), ["skip"]).collect()}
    x = got["a/x.jpg"]
    assert (x.camera_make, x.camera_model, x.width, x.height, x.timestamp_source, str(x.taken_ts)) == ("Abc", "Model 7", 4000, 3000, "exif", "2025-07-12 08:31:45")
    assert abs(x.lat + 46.51) < 1e-9 and abs(x.lon - 7.25) < 1e-9
    assert got["a/IMG_20250712_083145.JPG"].timestamp_source == "filename" and got["b/y.jpg"].timestamp_source == "mtime" and got["b/y.jpg"].camera_make == "Abc"
    assert len({r.content_key for r in got.values()}) == 4 and all(r.error is None for r in got.values())
    assert S.scan(spark, str(folder / "in/Skip"), ["none"]).count() == 1


def test_keys_of_both_ends(spark):
    blobs = [b"", b"abc", bytes(200_000), bytes(262_144) + b"x", bytes(262_144) + b"y", bytes(131_072) + b"1" * 10 + bytes(131_072), bytes(131_072) + b"2" * 10 + bytes(131_072)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(blobs)], "i int, x binary")
    got = {r.i: r.k for r in df.select("i", S.content_key(F.col("x")).alias("k")).collect()}
    assert [got[i] for i in range(7)] == [S.key_of(len(x), x[: S.HEAD_BYTES], x[-S.END_BYTES :]) for x in blobs]
    assert len(set(got.values())) == 6  # the last two differ in the middle only


def test_thumbnails():
    small = b"\xff\xd8" + b"t" * 2000 + b"\xff\xd9"
    assert S.thumbnail(jpeg(small)) == small and S.thumbnail(jpeg(b"\xff\xd8tiny\xff\xd9")) is None and S.thumbnail(b"") is None


def test_copies_are_verified_and_resumed(spark, folder):
    routes = spark.createDataFrame([(str(folder / "in/a/x.jpg"), "2025/e/x.jpg"), (str(folder / "in/notes.txt"), "2025/e/notes.txt"), (str(folder / "in/gone.jpg"), "2025/e/gone.jpg")], "path string, dest string")
    run = lambda: {r.dest.split("/")[-1]: r.outcome for r in S.copy_files(routes, str(folder / "out")).collect()}
    assert run() == {"x.jpg": "copied", "notes.txt": "copied", "gone.jpg": "failed"}
    (folder / "out/2025/e/notes.txt").write_bytes(b"other")
    assert run() == {"x.jpg": "already there", "notes.txt": "differs", "gone.jpg": "failed"}
    assert (folder / "out/2025/e/x.jpg").read_bytes() == jpeg() and (folder / "out/2025/e/notes.txt").read_bytes() == b"other"


def test_guards():
    S.check_folders("/data/in", "/data/out")
    for bad in ("/data/in", "/data/in/below", "/data", "/", "file:/data/in/x"):
        with pytest.raises(ValueError):
            S.check_folders("/data/in", bad)
    assert S.unrecognised(["2024", "rejected", "_OURS", "notes", "20245"]) == ["20245", "notes"]
