"""Files of a folder: listing, identity, what a picture's header says, verified copies.

The driver lists the top of a folder only; what is below is listed by the
executors, one top entry at a time, and no content is read. Of a picture a
bounded number of bytes at either end are read; one bad file is a row with an
error and never fatal. All goes through the file systems of pyarrow, so folders
may be local, shared or remote.

Defined cases: hidden files, files without extension and other files have a
reason, in this order; an empty or truncated header has no fields; a copy that
is there already with equal size and content is passed over, one that differs is
never overwritten.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import fixed, text
from ridgeline.functions.geo import dms_to_degrees
from ridgeline.functions.time import exif_datetime, filename_datetime

# Bytes of either end that identify a file, bytes of a header, sizes of an embedded thumbnail.
END_BYTES, HEAD_BYTES, THUMB_BYTES = 128 * 1024, 256 * 1024, (1024, 200_000)
# Numbers of the tags of a picture's header.
TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "changed", 0x9003: "original", 0x9004: "digitised", 0xA002: "width", 0xA003: "height"}
POSITION_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SUB_DIRECTORIES = {0x8769: TAGS, 0x8825: POSITION_TAGS}
FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "B", 9: "i", 10: "ii"}


def skip_reason(path: Column) -> Column:
    ext = text.extension(path)
    return F.when(text.base_name(path).startswith("."), "hidden file").when(ext == "", "no extension").when(~ext.isin(fixed.STANDARD_IMAGES + fixed.RAW_IMAGES), "not an image")


def _open(uri: str):
    """File system and path of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else posixpath.abspath(uri))


def walk(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """path, size_bytes, modified, reason (null for a picture) of every file below a folder; folders named in ``excluded``, in any case, are left out."""
    from pyarrow import fs

    schema = "path string, size_bytes long, modified timestamp"
    system, top = _open(root)
    skip = {x.lower() for x in excluded}
    entries = [(e.path, e.type == fs.FileType.Directory) for e in system.get_file_info(fs.FileSelector(top)) if e.base_name.lower() not in skip]

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(root)
        for b in batches:
            for entry, is_folder in zip(b.entry, b.folder):
                found = system.get_file_info(fs.FileSelector(entry, recursive=True)) if is_folder else [system.get_file_info(entry)]
                files = [f for f in found if f.type == fs.FileType.File and not skip.intersection(posixpath.dirname(f.path[len(top) :]).lower().split("/"))]
                yield pd.DataFrame({"path": [f.path for f in files], "size_bytes": [f.size for f in files], "modified": pd.Series([f.mtime for f in files], dtype="datetime64[ns, UTC]")})

    tops = spark.createDataFrame(entries, "entry string, folder boolean") if entries else spark.createDataFrame([], "entry string, folder boolean")
    rows = tops.repartition(max(1, min(len(entries), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(below, schema)
    return rows.withColumn("reason", skip_reason(F.col("path")))


def survey(files: DataFrame) -> DataFrame:
    """ext, n, bytes of the pictures, and of all others under 'other'; most frequent first."""
    ext = F.when(F.col("reason").isNull(), text.extension(F.col("path"))).otherwise("other")
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("n"), "ext")


def content_key(content: Column) -> Column:
    """Identity of a file's bytes: a hash of its size, its first and, if it is longer than both, its last bytes."""
    size = F.octet_length(content)
    tail = F.when(size > 2 * END_BYTES, F.substring(content, -END_BYTES, END_BYTES)).otherwise(F.to_binary(F.lit("")))
    return F.sha2(F.concat(F.encode(size.cast("string"), "UTF-8"), F.substring(content, 1, END_BYTES), tail), 256)


def _values(data: bytes, order: str, at: int, kind: int, count: int):
    """The values of an entry whose data begin at ``at``."""
    form = FORMATS.get(kind)
    if form is None or count > 65_536:
        return None
    if form == "s":
        return data[at : at + count].split(b"\x00")[0].decode("utf-8", "replace")
    found = struct.unpack_from(order + form * count, data, at)
    if len(form) == 2:
        found = tuple(n / d if d else None for n, d in zip(found[::2], found[1::2]))
    return found[0] if count == 1 else list(found)


def _directory(data: bytes, order: str, at: int, names: dict[int, str], out: dict) -> None:
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if tag in SUB_DIRECTORIES and names is TAGS:
            _directory(data, order, struct.unpack_from(order + "I", data, entry + 8)[0], SUB_DIRECTORIES[tag], out)
        elif tag in names and kind in FORMATS:
            size = struct.calcsize("=" + FORMATS[kind]) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            out[names[tag]] = _values(data, order, place, kind, count)


def header_fields(head: bytes) -> dict:
    """Fields of the header of a JPEG, by name; none if there is no readable one."""
    at = head.find(b"Exif\x00\x00")
    if head[:2] != b"\xff\xd8" or at < 0:
        return {}
    data = head[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    out: dict = {}
    if order:
        try:
            _directory(data, order, struct.unpack_from(order + "I", data, 4)[0], TAGS, out)
        except struct.error:
            pass  # cut off: what was read stays
    return out


def thumbnail(head: bytes) -> bytes | None:
    """The picture embedded in a JPEG's header: from the second start of an image to its end."""
    start = head.find(b"\xff\xd8", 2)
    end = head.find(b"\xff\xd9", start + 2) if start > 0 else -1
    found = head[start : end + 2] if end > 0 else b""
    return found if THUMB_BYTES[0] <= len(found) <= THUMB_BYTES[1] else None


def key_of(size: int, head: bytes, tail: bytes) -> str:
    """As :func:`content_key`, of the first and the last bytes of a file; the last count only if it is longer than both."""
    return hashlib.sha256(str(size).encode() + head[:END_BYTES] + (tail if size > 2 * END_BYTES else b"")).hexdigest()


_HEADER = "path string, size_bytes long, modified timestamp, content_key string, make string, model string, raw_time string, width int, height int, lat_ref string, lat array<double>, lon_ref string, lon array<double>, error string"


def scan(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """path, size_bytes, camera_make, camera_model, width, height, lat, lon, taken_ts, timestamp_source, content_key, error of every picture below a folder. The time is that of the header, else of the file's name, else of its last change."""

    def one(system, path: str, size: int) -> tuple:
        try:
            with system.open_input_file(path) as f:
                head = f.read(HEAD_BYTES)
                tail = f.read_at(END_BYTES, size - END_BYTES) if size > 2 * END_BYTES else b""
            found, key, error = header_fields(head), key_of(size, head, tail), None
        except Exception as bad:  # one bad file is never fatal
            found, key, error = {}, None, str(bad)[:200]
        number = lambda k: found.get(k) if isinstance(found.get(k), int) else None
        words = lambda k: found.get(k) if isinstance(found.get(k), str) else None
        degrees = lambda k: [None if x is None else float(x) for x in found[k]] if isinstance(found.get(k), list) else None
        return key, words("make"), words("model"), words("original") or words("digitised") or words("changed"), number("width"), number("height"), words("lat_ref"), degrees("lat"), words("lon_ref"), degrees("lon"), error

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(root)
        names = [c.split()[0] for c in _HEADER.split(", ")][3:]
        for b in batches:
            out = pd.DataFrame([one(system, p, n) for p, n in zip(b.path, b.size_bytes)], columns=names, dtype=object)
            yield pd.concat([b.reset_index(drop=True), out], axis=1)

    df = walk(spark, root, excluded).filter("reason is null").drop("reason").mapInPandas(read, _HEADER)
    place = lambda c: dms_to_degrees(*[F.get(c, F.lit(i)) for i in range(3)], F.col(f"{c}_ref"))
    named, header = filename_datetime(text.base_name(F.col("path"))), exif_datetime(F.col("raw_time"))
    source = F.when(header.isNotNull(), "exif").when(named.isNotNull(), "filename").when(F.col("modified").isNotNull(), "mtime").otherwise("none")
    lat = place("lat")
    return df.select("path", "size_bytes", F.col("make").alias("camera_make"), F.col("model").alias("camera_model"), "width", "height", F.when(F.abs(lat) <= 90, lat).alias("lat"), place("lon").alias("lon"), F.coalesce(header, named, F.col("modified").cast("timestamp_ntz")).alias("taken_ts"), source.alias("timestamp_source"), "content_key", "error")


# --- guards ---------------------------------------------------------------------

MARKER = "_OURS"


def check_folders(source: str, output: str) -> None:
    """A folder is not written into itself, into one below it or into one above it, and never to a root."""
    a, b = (posixpath.normpath(x.split("://")[-1].split(":", 1)[-1]) for x in (source, output))
    if b in ("/", "."):
        raise ValueError("the output is a root")
    if a == b or b.startswith(a + "/") or a.startswith(b + "/"):
        raise ValueError("source and output lie in one another")


def unrecognised(names: list[str]) -> list[str]:
    """Top entries of an output folder that no copy makes: neither a year, a folder of rejected ones nor the marker."""
    return sorted(n for n in names if not (len(n) == 4 and n.isdigit()) and n not in ("rejected", MARKER))


# --- copies ----------------------------------------------------------------------


def copy_files(routes: DataFrame, output: str) -> DataFrame:
    """path, dest, outcome (copied, already there, differs, failed) of each file of ``routes`` (path, dest). A copy is read back and compared; one that fails is taken away again, one that differs from what is there is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def read(uri: str) -> bytes | None:
            system, path = _open(uri)
            if system.get_file_info(path).type != fs.FileType.File:
                return None
            with system.open_input_stream(path) as f:
                return f.read()

        def one(path: str, dest: str) -> str:
            try:
                data, target = read(path), f"{output}/{dest}"
                there = read(target)
                if data is None:
                    return "failed"
                if there is not None:
                    return "already there" if there == data else "differs"
                system, place = _open(target)
                system.create_dir(posixpath.dirname(place))
                with system.open_output_stream(place) as f:
                    f.write(data)
                if hashlib.sha256(read(target) or b"").digest() == hashlib.sha256(data).digest():
                    return "copied"
                system.delete_file(place)
            except OSError:
                pass
            return "failed"

        for b in batches:
            yield b.assign(outcome=[one(p, d) for p, d in zip(b.path, b.dest)])

    return routes.select("path", "dest").mapInPandas(run, "path string, dest string, outcome string")
