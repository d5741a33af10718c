"""Text, date and place expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def exif_datetime(raw: Column) -> Column:
    """`2024:01:31 10:20:30` as ISO seconds; what can't be read stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(raw, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss"), raw)


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def camera_model(make: Column, model: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", F.trim(make), F.trim(model))), F.lit(""))


def singular(label: Column) -> Column:
    """Trimmed, in lower case, and singular by regular English endings."""
    x = F.lower(F.trim(label))
    return (
        F.when(x.rlike("[^aeiou]ies$"), F.regexp_replace(x, "ies$", "y"))
        .when(x.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(x, "es$", ""))
        .when(x.rlike("[^su]s$"), F.regexp_replace(x, "s$", ""))
        .otherwise(x)
    )


def is_true(param: Column) -> Column:
    """Whether a request parameter says yes."""
    return F.lower(F.trim(F.coalesce(param, F.lit("")))).isin("1", "true", "yes", "on")


def image_of(target: Column) -> Column:
    """The image of a region key `image#index`."""
    return F.substring_index(target, "#", 1)


def region_index(target: Column) -> Column:
    """The index of a region key; 0 if it can't be read."""
    return F.coalesce(F.substring_index(target, "#", -1).try_cast("int"), F.lit(0))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stripped(text: Column) -> Column:
    """A text without white space around it."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def relative_to(path: Column, root: str) -> Column:
    """A path below a root, else the path as it is."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


# Media types of image files; all others count as JPEG.
MEDIA_TYPES = {".png": "image/png", ".webp": "image/webp", ".bmp": "image/bmp", ".dib": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".gif": "image/gif"}


def media_type(path: Column) -> Column:
    return F.coalesce(*[F.when(suffix(path) == k, F.lit(v)) for k, v in MEDIA_TYPES.items()], F.lit("image/jpeg"))


def data_url(path: Column, content: Column) -> Column:
    """An image file as a data URL for a remote annotator; turning and scaling pixels is a hook of the caller."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))
