"""Headers of image files. The files' bytes are made by Spark from the rows of `embeddings`: four formats, EXIF in both byte orders,
fractions of degrees, and damaged files."""

from pyspark.sql import functions as F

from medialens.plans import surrogates as s
from medialens.sources import media


def be(value, size):
    """A number as so many bytes, most significant first, in hexadecimal digits."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def le(value, size):
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])


def ascii_digits(text):
    return F.hex(text.cast("binary"))


def exif_block(n, order):
    """An EXIF block: maker, model, orientation, time taken, and a place for even n."""
    two, four = (lambda x: order(F.lit(x) if isinstance(x, int) else x, 2)), (lambda x: order(F.lit(x) if isinstance(x, int) else x, 4))
    entry = lambda tag, kind, count, value: F.concat(two(tag), two(kind), four(count), value)
    short = lambda x: F.concat(two(x), F.lit("0000"))
    start = F.lit("49492A00") if order is le else F.lit("4D4D002A")
    # main directory at 8 (5 entries: 66 bytes), its texts at 74 (8 bytes each), the next directory at 90 (18 bytes), its text at 108 (20), the place's at 128
    main = F.concat(two(5), entry(0x10F, 2, 8, four(74)), entry(0x110, 2, 8, four(82)), entry(0x112, 3, 1, short(n % 8 + 1)), entry(0x8769, 4, 1, four(90)), entry(0x8825, 4, 1, F.when(n % 2 == 0, four(128)).otherwise(four(0))), four(0))
    texts = F.concat(ascii_digits(F.lit("Maker ")), F.lit("0000"), ascii_digits(F.concat(F.lit("M-"), F.lpad((n % 100).cast("string"), 2, "0"))), F.lit("00000000"))
    stamp = F.concat(F.lit("2024:"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:20:"), F.lpad((n % 60).cast("string"), 2, "0"))
    more = F.concat(two(1), entry(0x9003, 2, 20, four(108)), four(0), ascii_digits(stamp), F.lit("00"))
    letter = lambda yes, no: F.concat(F.hex(F.when(n % 4 == 0, yes).otherwise(no).cast("binary")), F.lit("000000"))
    place = F.concat(two(4), entry(1, 2, 2, letter("N", "S")), entry(2, 5, 3, four(182)), entry(3, 2, 2, letter("E", "W")), entry(4, 5, 3, four(206)), four(0))
    parts = F.concat(four(n % 90), four(1), four(n % 60), four(1), four(n % 6000), four(100), four(n % 180), four(1), four(n % 60), four(1), four(n % 6000), four(100))
    return F.concat(start, four(8), main, texts, more, place, parts)


def files(spark, sf):
    """image_id, path, content: a file for each row of embeddings; each eleventh one is cut off."""
    n = F.col("vec_id")
    wide, high = n % 4000 + 1, n % 3000 + 1
    gif = F.concat(F.lit("474946383961"), le(wide, 2), le(high, 2), F.lit("000000"))
    little, big = exif_block(n, le), exif_block(n, be)
    head = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFE1"), be(F.length(little) / 2 + 8, 2), F.lit("457869660000"))
    jpeg = F.concat(head, little, F.lit("FFC0000B08"), be(high, 2), be(wide, 2), F.lit("01011100FFDA"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(wide, 4), be(high, 4), F.lit("080200000000000000"), be(F.length(big) / 2, 4), F.lit("65584966"), big, F.lit("000000000000000049454E4400000000"))
    vp8 = F.concat(F.lit("52494646000000005745425056503858"), F.lit("0A00000000000000"), le(wide - 1, 3), le(high - 1, 3))
    body = F.when(n % 4 == 0, jpeg).when(n % 4 == 1, gif).when(n % 4 == 2, png).otherwise(vp8)
    kept = F.when(n % 11 == 10, F.substring(body, 1, 16)).otherwise(body)
    return s.table(spark, sf, "embeddings").select(F.format_string("%016x", n).alias("image_id"), F.concat(F.lit("/media/"), n, F.lit(".bin")).alias("path"), F.unhex(kept).alias("content"))


def headers(spark, sf):
    out = media.image_headers(files(spark, sf)).drop("path")
    return out.withColumns({c: F.round(c, 6) for c in ("gps_latitude", "gps_longitude")})


def payloads(spark, sf):
    found = media.image_headers(files(spark, sf)).filter("error IS NULL")
    return found.select("image_id", media.metadata_payload(*map(F.col, ("image_id", "path", "taken", "camera", "gps_latitude", "gps_longitude"))).alias("payload"))


def payload_fields(spark, sf):
    """The payloads' fields, read back."""
    field = lambda path: F.get_json_object("payload", f"$.{path}")
    number = lambda path: F.round(field(path).cast("double"), 6)
    return payloads(spark, sf).select("image_id", field("primary_path").alias("path"), field("exif_datetime").alias("taken"), field("camera_model").alias("camera"), number("gps.latitude").alias("latitude"), field("gps.latitude_ref").alias("latitude_ref"), number("gps.longitude").alias("longitude"), field("gps.longitude_ref").alias("longitude_ref"))


#: What the files say, by the number of the row.
SAID = """h AS (SELECT vec_id AS n, format('{:016x}', vec_id) AS image_id, vec_id % 11 <> 10 AS whole, vec_id % 4 AS kind FROM embeddings),
e AS (SELECT *, whole AND kind IN (0, 2) AS exif, whole AND kind IN (0, 2) AND n % 2 = 0 AS placed FROM h),
said AS (SELECT n, image_id, CASE WHEN whole THEN ['jpeg', 'gif', 'png', 'webp'][kind + 1] END AS format, CASE WHEN whole THEN n % 4000 + 1 END AS width, CASE WHEN whole THEN n % 3000 + 1 END AS height,
  CASE WHEN exif THEN CAST(n % 8 + 1 AS INTEGER) END AS orientation, CASE WHEN exif THEN '2024-' || lpad(CAST(n % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') || 'T10:20:' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') END AS taken,
  CASE WHEN exif THEN 'Maker M-' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END AS camera,
  CASE WHEN placed THEN (n % 90 + (n % 60) / 60 + (n % 6000) / 100 / 3600) * CASE WHEN n % 4 = 0 THEN 1 ELSE -1 END END AS gps_latitude,
  CASE WHEN placed THEN (n % 180 + (n % 60) / 60 + (n % 6000) / 100 / 3600) * CASE WHEN n % 4 = 0 THEN 1 ELSE -1 END END AS gps_longitude,
  CASE WHEN NOT whole THEN CASE kind WHEN 0 THEN 'cut off' WHEN 1 THEN 'cut off' WHEN 2 THEN 'no size' ELSE 'unknown format' END END AS error FROM e)"""

QUERIES = {
    "image_headers": (headers, f"WITH {SAID} SELECT image_id, format, width, height, orientation, taken, camera, round(gps_latitude, 6) AS gps_latitude, round(gps_longitude, 6) AS gps_longitude, error FROM said"),
    "metadata_payloads": (payload_fields, f"WITH {SAID} SELECT image_id, '/media/' || n || '.bin' AS path, taken, camera, round(gps_latitude, 6) AS latitude, CASE WHEN gps_latitude >= 0 THEN 'N' WHEN gps_latitude < 0 THEN 'S' END AS latitude_ref, round(gps_longitude, 6) AS longitude, CASE WHEN gps_longitude >= 0 THEN 'E' WHEN gps_longitude < 0 THEN 'W' END AS longitude_ref FROM said WHERE error IS NULL"),
}
