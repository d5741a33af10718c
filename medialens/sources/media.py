"""Headers of image files: size, orientation, time taken, camera and place, from the bytes alone.

Only headers are read: a kernel walks the segments of each file in an Arrow batch without copying its bytes and returns what the file
says (words and fractions as they stand); dates, camera names and degrees are DataFrame expressions over that. Pixels are not decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.functions.frames import ship
from medialens.functions.text import camera_model, dms_to_degrees, exif_datetime

#: Fixed values of the formats: bytes of one value of each EXIF type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 5: "II", 7: "B", 9: "i", 10: "ii"}
MAIN_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "changed", 0x8769: "more", 0x8825: "gps", 256: "width", 257: "height"}
MORE_TAGS = {0x9003: "taken"}
GPS_TAGS = {1: "latitude_ref", 2: "latitude", 3: "longitude_ref", 4: "longitude"}

FIELDS = pa.schema(
    [("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("orientation", pa.int32()), ("make", pa.string()), ("model", pa.string()), ("taken", pa.string())]
    + [("latitude", pa.list_(pa.float64())), ("latitude_ref", pa.string()), ("longitude", pa.list_(pa.float64())), ("longitude_ref", pa.string()), ("error", pa.string())]
)


class Damaged(ValueError):
    """The bytes are not those of an image header."""


def _take(data, at: int, code: str) -> tuple:
    if at < 0 or at + struct.calcsize(code) > len(data):
        raise Damaged("cut off")
    return struct.unpack_from(code, data, at)


def _value(tiff, order: str, kind: int, count: int, at: int):
    """An entry's value: text up to its first NUL, or numbers; fractions with no denominator are null."""
    size = TYPE_BYTES.get(kind, 0) * count
    if not size:
        return None
    if size > 4:
        (at,) = _take(tiff, at, order + "I")
    if at + size > len(tiff):
        raise Damaged("exif")
    if kind == 2:
        return bytes(tiff[at : at + size]).split(b"\0")[0].decode("utf-8", "replace")
    numbers = struct.unpack_from(order + TYPE_CODES[kind] * count if kind in (5, 10) else f"{order}{count}{TYPE_CODES[kind]}", tiff, at)
    return [n / d if d else None for n, d in zip(numbers[::2], numbers[1::2], strict=True)] if kind in (5, 10) else list(numbers)


def _entries(tiff, order: str, at: int, tags: dict[int, str]) -> dict:
    """The wanted entries of a directory."""
    found = {}
    for k in range(_take(tiff, at, order + "H")[0]):
        tag, kind, count = _take(tiff, at + 2 + 12 * k, order + "HHI")
        if tag in tags:
            found[tags[tag]] = _value(tiff, order, kind, count, at + 10 + 12 * k)
    return found


def _first(value) -> int | None:
    return value[0] if isinstance(value, list) and value and isinstance(value[0], int) else None


def _exif(tiff) -> dict:
    """What the directories of an EXIF block say."""
    mark = bytes(tiff[:4])
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(mark)
    if order is None:
        raise Damaged("exif")
    out = _entries(tiff, order, _take(tiff, 4, order + "I")[0], MAIN_TAGS)
    for pointer, tags in (("more", MORE_TAGS), ("gps", GPS_TAGS)):
        at = _first(out.pop(pointer, None))
        if at:
            out |= _entries(tiff, order, at, tags)
    text = lambda k: out[k] if isinstance(out.get(k), str) and out[k] else None
    place = lambda k: out[k][:3] if isinstance(out.get(k), list) and len(out[k]) >= 3 else None
    words = {k: text(k) for k in ("make", "model", "latitude_ref", "longitude_ref")} | {"taken": text("taken") or text("changed")}
    return words | {k: place(k) for k in ("latitude", "longitude")} | {k: _first(out.get(k)) for k in ("orientation", "width", "height")}


def _jpeg(data) -> tuple[tuple[int, int], object]:
    at, exif = 2, None
    while True:
        (mark,) = _take(data, at, "B")
        if mark != 0xFF:
            raise Damaged("cut off")
        while mark == 0xFF:
            at += 1
            (mark,) = _take(data, at, "B")
        at += 1
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            continue
        if mark in (0xD9, 0xDA):
            raise Damaged("no size")
        (size,) = _take(data, at, ">H")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = _take(data, at + 3, ">HH")
            return (width, height), exif
        if mark == 0xE1 and exif is None and bytes(data[at + 2 : at + 8]) == b"Exif\0\0":
            exif = data[at + 8 : at + size]
        at += max(size, 2)


def _png(data) -> tuple[tuple[int, int], object]:
    size, at = None, 8
    while at + 8 <= len(data):
        length, kind = _take(data, at, ">I4s")
        if kind == b"IHDR":
            size = _take(data, at + 8, ">II")
        elif kind == b"eXIf" and size:
            return size, data[at + 8 : at + 8 + length]
        elif kind == b"IEND":
            break
        at += 12 + length
    if size is None:
        raise Damaged("no size")
    return size, None


def _webp(data) -> tuple[tuple[int, int], object]:
    size, at, exif = None, 12, None
    while at + 8 <= len(data):
        kind, length = _take(data, at, "<4sI")
        if kind == b"VP8X":
            a, b, c, d = _take(data, at + 12, "<HBHB")
            size = (a + (b << 16) + 1, c + (d << 16) + 1)
        elif kind == b"VP8L" and size is None:
            _, bits = _take(data, at + 8, "<BI")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        elif kind == b"VP8 " and size is None:
            width, height = _take(data, at + 14, "<HH")
            size = (width & 0x3FFF, height & 0x3FFF)
        elif kind == b"EXIF":
            exif = data[at + 8 : at + 8 + length]
            exif = exif[6:] if bytes(exif[:6]) == b"Exif\0\0" else exif
        at += 8 + length + length % 2
    if size is None:
        raise Damaged("no size")
    return size, exif


def _bitmap(data) -> tuple[tuple[int, int], object]:
    (header,) = _take(data, 14, "<I")
    width, height = _take(data, 18, "<HH" if header == 12 else "<ii")
    return (abs(width), abs(height)), None


#: First bytes of each format, and what reads the size and the EXIF block behind them.
FORMATS = [(b"\xff\xd8", "jpeg", _jpeg), (b"\x89PNG\r\n\x1a\n", "png", _png), (b"GIF87a", "gif", lambda d: (_take(d, 6, "<HH"), None)), (b"GIF89a", "gif", lambda d: (_take(d, 6, "<HH"), None)), (b"BM", "bmp", _bitmap), (b"II*\0", "tiff", None), (b"MM\0*", "tiff", None)]


def read_header(data) -> dict:
    """The FIELDS of one file's bytes. A file without a readable size has only an error; a damaged EXIF block costs only what it says."""
    start = bytes(data[:12])
    kind, reader = next(((k, r) for mark, k, r in FORMATS if start.startswith(mark)), (None, None))
    if start[:4] == b"RIFF" and start[8:] == b"WEBP":
        kind, reader = "webp", _webp
    if kind is None:
        return {"error": "unknown format" if len(data) else "empty"}
    out, exif = {"format": kind}, data
    try:
        if reader:
            (out["width"], out["height"]), exif = reader(data)
            if not out["width"] or not out["height"]:
                raise Damaged("no size")
    except Damaged as e:
        return {"error": str(e)}
    try:
        said = _exif(exif) if exif is not None else {}
    except Damaged:
        said = {"error": "exif"}
    if reader is None and not (said.get("width") and said.get("height")):
        return {"error": "no size"}
    return said | out if reader else said | out | {"width": said["width"], "height": said["height"]}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key columns, content), the keys and FIELDS."""
    for batch in batches:
        content = batch.column(batch.num_columns - 1)
        found = [read_header(memoryview(x.as_buffer())) if x.is_valid else {"error": "empty"} for x in content]
        columns = [pa.array([f.get(name) for f in found], FIELDS.field(name).type) for name in FIELDS.names]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *FIELDS.names])


def image_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, with format, width, height, orientation, taken, camera, gps_latitude, gps_longitude and error.

    error says why nothing could be read (empty, unknown format, cut off, no size), or exif if only that block is damaged. A time in no known
    shape stays as it stands in the file. Both coordinates must have their three parts, else neither counts. Repeated files give a row each; columns of files with the
    added names are replaced.
    """
    added = [*FIELDS.names, "camera", "gps_latitude", "gps_longitude"]
    keys = [c for c in files.columns if c != content and c.lower() not in added]
    plain = files.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keys)], F.col(f"`{content}`").alias("content"))
    kinds = "format string, width bigint, height bigint, orientation int, make string, model string, taken string, latitude array<double>, latitude_ref string, longitude array<double>, longitude_ref string, error string"
    ship(files.sparkSession)
    rows = plain.mapInArrow(_read, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]], kinds]))
    part = lambda c, k: F.get(c, F.lit(k))
    degrees = lambda c: dms_to_degrees(part(c, 0), part(c, 1), part(c, 2), F.col(f"{c}_ref"))
    latitude, longitude = degrees("latitude"), degrees("longitude")
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keys)],
        *["format", "width", "height", "orientation"],
        exif_datetime(F.col("taken")).alias("taken"),
        camera_model(F.col("make"), F.col("model")).alias("camera"),
        F.when(longitude.isNotNull(), latitude).alias("gps_latitude"),
        F.when(latitude.isNotNull(), longitude).alias("gps_longitude"),
        "error",
    )


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size_bytes, mtime and headers of the files below a folder, in any store that Spark reads. Files without bytes, and files that vanish meanwhile, are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return image_headers(files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content"))


def metadata_payload(image_id: Column, path: Column, taken: Column, camera: Column, latitude: Column, longitude: Column) -> Column:
    """The metadata artifact of an image as JSON: its id and path, and of time, camera and place those that are known."""
    ref = lambda value, plus, minus: F.when(value >= 0, plus).otherwise(minus)
    place = F.struct(latitude.alias("latitude"), ref(latitude, "N", "S").alias("latitude_ref"), longitude.alias("longitude"), ref(longitude, "E", "W").alias("longitude_ref"))
    gps = F.when(latitude.isNotNull() & longitude.isNotNull(), place)
    return F.to_json(F.struct(image_id.alias("image_id"), path.alias("primary_path"), taken.alias("exif_datetime"), camera.alias("camera_model"), gps.alias("gps")))
