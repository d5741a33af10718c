"""Image headers from bytes: known files of all formats, and damaged ones."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from medialens.plans import media as plan
from medialens.sources import media


def exif(order="<", latitude=((52, 1), (30, 1), (1234, 100)), longitude=((13, 1), (0, 1), (0, 1)), refs=(b"N", b"W"), stamp=b"2024:01:31 10:20:30"):
    """An EXIF block, its directories written by struct."""
    data = {}

    def directory(at, entries, values_at):
        out, tail = struct.pack(order + "H", len(entries)), b""
        for tag, kind, value in entries:
            if kind == 2:
                raw, count = value + b"\0", len(value) + 1
            elif kind == 5:
                raw, count = b"".join(struct.pack(order + "II", *x) for x in value), len(value)
            else:
                raw, count = struct.pack(order + {3: "H", 4: "I"}[kind], value), 1
            if len(raw) > 4:
                out += struct.pack(order + "HHII", tag, kind, count, values_at + len(tail))
                tail += raw
            else:
                out += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        data[at], data[values_at] = out + b"\0\0\0\0", tail

    directory(8, [(0x10F, 2, b"Acme"), (0x110, 2, b"Zoom 5 "), (0x112, 3, 6), (0x8769, 4, 200), (0x8825, 4, 300)], 100)
    directory(200, [(0x9003, 2, stamp)], 240)
    directory(300, [(1, 2, refs[0]), (2, 5, latitude), (3, 2, refs[1]), (4, 5, longitude)], 380)
    block = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)).ljust(500, b"\0")
    for at, part in data.items():
        block[at : at + len(part)] = part
    return bytes(block)


def jpeg(block=None, size=(4000, 3000), between=b""):
    app = b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block if block else b""
    return b"\xff\xd8\xff\xe0\0\x04ab" + app + between + b"\xff\xff\xc2\0\x0b\x08" + struct.pack(">HH", size[1], size[0]) + b"\x01\x01\x11\0\xff\xda"


def png(block=None, size=(640, 480)):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", *size) + b"\x08\2\0\0\0") + chunk(b"IDAT", b"x" * 100) + (chunk(b"eXIf", block) if block else b"") + chunk(b"IEND", b"")


def webp(*chunks):
    return b"RIFF\0\0\0\0WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)


FILES = {
    "jpeg": (jpeg(exif()), ("jpeg", 4000, 3000, 6, "2024-01-31T10:20:30", "Acme Zoom 5", None)),
    "big endian, long segment before the size": (jpeg(exif(">"), between=b"\xff\xe2\xff\xff" + b"\xff" * 65533), ("jpeg", 4000, 3000, 6, "2024-01-31T10:20:30", "Acme Zoom 5", None)),
    "plain jpeg": (jpeg(), ("jpeg", 4000, 3000, None, None, None, None)),
    "odd time": (jpeg(exif(stamp=b"yesterday, at noon..")), ("jpeg", 4000, 3000, 6, "yesterday, at noon..", "Acme Zoom 5", None)),
    "png": (png(), ("png", 640, 480, None, None, None, None)),
    "png with exif": (png(exif(">")), ("png", 640, 480, 6, "2024-01-31T10:20:30", "Acme Zoom 5", None)),
    "gif": (b"GIF87a" + struct.pack("<HH", 7, 9), ("gif", 7, 9, None, None, None, None)),
    "webp, extended": (webp((b"VP8X", b"\x08\0\0\0" + struct.pack("<I", 69999)[:3] + struct.pack("<I", 299)[:3]), (b"odd ", b"abc"), (b"EXIF", b"Exif\0\0" + exif())), ("webp", 70000, 300, 6, "2024-01-31T10:20:30", "Acme Zoom 5", None)),
    "webp, lossless": (webp((b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14))), ("webp", 100, 50, None, None, None, None)),
    "webp, lossy": (webp((b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 200))), ("webp", 320, 200, None, None, None, None)),
    "bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 31, -17), ("bmp", 31, 17, None, None, None, None)),
    "damaged exif": (jpeg(b"II*\0\xff\xff\xff\x7f"), ("jpeg", 4000, 3000, None, None, None, "exif")),
    "empty": (b"", (None,) * 6 + ("empty",)),
    "text": (b"hello", (None,) * 6 + ("unknown format",)),
    "no size": (b"\xff\xd8\xff\xd9", (None,) * 6 + ("no size",)),
    "cut": (jpeg(exif())[:300], (None,) * 6 + ("cut off",)),
}
COLUMNS = ["format", "width", "height", "orientation", "taken", "camera", "error"]


def test_known_files_from_a_folder(spark, tmp_path):
    for name, (content, _) in FILES.items():
        (tmp_path / "deep").mkdir(exist_ok=True)
        (tmp_path / "deep" / f"{name}.img").write_bytes(content)
    rows = media.read_images(spark, str(tmp_path), "*.img").collect()
    got = {r.path.rsplit("/", 1)[1].removesuffix(".img").replace("%20", " "): tuple(r[c] for c in COLUMNS) for r in rows}
    # Spark's file scan has no row for a file without bytes
    assert got == {name: want for name, (content, want) in FILES.items() if content}
    place = next((r.gps_latitude, r.gps_longitude) for r in rows if r.path.endswith("/jpeg.img"))
    assert place == (pytest.approx(52.5 + 12.34 / 3600), -13.0)


def test_places_need_all_parts(spark):
    cases = [exif(latitude=((1, 0), (0, 1), (0, 1))), exif(latitude=((1, 1), (0, 1))), exif(refs=(b"s", b"e")), exif(longitude=())]
    rows = media.image_headers(spark.createDataFrame([(i, bytearray(jpeg(c))) for i, c in enumerate(cases)], "id int, content binary")).orderBy("id").collect()
    assert [(r.gps_latitude, r.gps_longitude) for r in rows] == [(None, None), (None, None), (pytest.approx(-52.5 - 12.34 / 3600), 13.0), (None, None)]


def test_damaged_bytes_give_error_rows_and_nothing_else():
    rng = random.Random(6)
    for content in (jpeg(exif()), png(exif(">")), FILES["webp, extended"][0], exif("<")):
        for cut in range(0, len(content), 3):
            assert set(media.read_header(content[:cut])) <= set(media.FIELDS.names)
        for _ in range(400):
            bad = bytearray(content)
            for _ in range(rng.randint(1, 12)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            found = media.read_header(memoryview(bytes(bad)))
            assert found.get("error") or found["width"] > 0


def test_edges(spark):
    rows = [(1, None, 7), (1, bytearray(b"GIF89a\1\0\2\0"), 7), (1, bytearray(b"GIF89a\1\0\2\0"), 7)]
    df = spark.createDataFrame(rows, "id int, content binary, WIDTH int").withColumn("a.b", F.lit(1)).withColumn("c0", F.lit(2))
    out = media.image_headers(df)
    assert sorted((r.width or 0, r.error or "", r["a.b"], r.c0) for r in out.collect()) == [(0, "empty", 1, 2), (1, "", 1, 2), (1, "", 1, 2)]
    assert media.image_headers(df.limit(0)).count() == 0


def test_payloads(spark, sf_dir):
    rows = {r.image_id: json.loads(r.payload) for r in plan.payloads(spark, sf_dir).collect()}
    assert set(rows["0" * 15 + "4"]) == {"image_id", "primary_path", "exif_datetime", "camera_model", "gps"}
    assert set(rows["0" * 15 + "1"]) == {"image_id", "primary_path"}
    assert rows["0" * 15 + "2"]["gps"]["latitude_ref"] == "S"
