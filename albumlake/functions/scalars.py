"""Scalar functions as column expressions, all evaluated by the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c) -> Column:
    """Case-insensitive form for comparing: lower case, null as ''. Differs from full case folding
    for a few characters such as sharp s; ``exact_fold`` covers those at the price of Python."""
    return F.coalesce(F.lower(_col(c)), F.lit(""))


@F.pandas_udf(StringType())
def exact_fold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, batch by batch."""
    return s.fillna("").map(str.casefold)


def nocase(c) -> Column:
    """A-Z only in lower case, for orders that ignore ASCII case."""
    return F.translate(_col(c), _UPPER, _LOWER)


# A folder that holds other versions of its files, and extensions at the end of a name.
VERSION_FOLDER = r"(?i)/(?:\[?developed\]?|web|raw|jpe?g|originals?)$"
VERSION_EXTENSIONS = r"(?:\.[a-z0-9]{2,5})+$"


def version_folder(c) -> Column:
    """Folder without one trailing folder that holds other versions of its files, folded."""
    return fold(F.regexp_replace(_col(c), VERSION_FOLDER, ""))


def version_name(c) -> Column:
    """Folded file name without all its trailing extensions."""
    return F.regexp_replace(fold(c), VERSION_EXTENSIONS, "")


def timestamp_text(ms) -> Column:
    """m:ss, with hours where there are any; null or negative as 0:00."""
    s = F.greatest(F.coalesce(_col(ms), F.lit(0)), F.lit(0)).cast("long")
    s = F.floor(s / 1000)
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds)).otherwise(F.format_string("%d:%02d", minutes, seconds))


def sample_times(duration_ms, step: int = 10_000) -> Column:
    """Times 0, step, 2 step, ... below the duration (at least one)."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.coalesce(_col(duration_ms), F.lit(0))).cast("long") - 1, F.lit(step).cast("long"))


def ancestors(path) -> Column:
    """Every prefix of a path that ends at a '/', and the path itself."""
    parts = F.split(_col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def coordinate(value, reference=None, latitude: bool = True) -> Column:
    """Degrees from "D", "D M" or "D M S" (space, comma or colon between, hemisphere letter at the
    end or given apart); null where a part, the hemisphere or the range is wrong."""
    sides, most = ("NS", 90) if latitude else ("EW", 180)
    text = F.trim(_col(value).cast("string"))
    tail = F.upper(F.right(text, F.lit(1)))
    lettered = tail.isin("N", "S", "E", "W")
    given = F.upper(F.trim(F.coalesce(_col(reference), F.lit("")))) if reference is not None else F.lit("")
    side = F.when(lettered, tail).otherwise(given)
    body = F.when(lettered, F.regexp_replace(text, "[A-Za-z]$", "")).otherwise(text)
    parts = F.filter(F.split(body, "[, :]+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    whole = F.abs(F.get(numbers, 0)) + F.coalesce(F.get(numbers, 1), F.lit(0.0)) / 60 + F.coalesce(F.get(numbers, 2), F.lit(0.0)) / 3600
    signed = F.when(side.isin("S", "W") | (F.get(numbers, 0) < 0), -whole).otherwise(whole)
    right_side = (side == "") | side.isin(*sides)
    if reference is not None:  # a reference given apart must suit the axis too
        right_side = right_side & ((given == "") | given.isin(*sides))
    fine = F.size(parts).between(1, 3) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x)) & F.forall(F.slice(numbers, 2, 3), lambda x: (x >= 0) & (x < 60))
    return F.when(right_side & fine & (F.abs(signed) <= most), signed)


def parse_iso6709(c) -> Column:
    """(latitude, longitude, altitude) of a string like +55.7558+037.6173+151.0/ or null."""
    pattern = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?/?$"
    part = lambda i: F.regexp_extract(_col(c), pattern, i)
    # The pattern leaves plain signed numbers, which a variable of a lambda holds so that each is extracted once.
    numbers = F.array(*[part(i).try_cast("double") + 0.0 for i in (1, 2)], part(3).try_cast("double"))
    fine = lambda n: (F.abs(n[0]) <= 90) & (F.abs(n[1]) <= 180)
    return F.get(F.transform(F.array(numbers), lambda n: F.when(fine(n), F.struct(n[0].alias("latitude"), n[1].alias("longitude"), n[2].alias("altitude")))), 0)


def capture_time(raw) -> Column:
    """Camera time "YYYY:MM:DD HH:MM:SS" as an ISO string without zone; null for anything else."""
    text = F.trim(F.translate(_col(raw), "\x00", ""))
    exact = F.when(text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), text)
    return F.date_format(F.try_to_timestamp(exact, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")


def video_time(raw) -> Column:
    """Container time in ISO form, with Z as +00:00; only years 1900 to 2200."""
    text = F.regexp_replace(F.trim(_col(raw)), "Z$", "+00:00")
    fine = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}") & F.try_to_timestamp(text).isNotNull()
    return F.when(fine & F.substring(text, 1, 4).try_cast("int").between(1900, 2200), text)


def normalise_metadata(tags, width, height) -> Column:
    """Struct of width, height, pixels, camera, orientation, captured_at from a map of camera tags.

    Tags are named Orientation, Make, Model and DateTimeOriginal; turned pictures swap their sides.
    """
    t = _col(tags)
    turned = F.coalesce(F.try_element_at(t, F.lit("Orientation")).try_cast("int").between(5, 8), F.lit(False))
    w, h = F.when(turned, _col(height)).otherwise(_col(width)), F.when(turned, _col(width)).otherwise(_col(height))
    name = lambda k: F.trim(F.translate(F.coalesce(F.try_element_at(t, F.lit(k)), F.lit("")), "\x00", ""))
    shape = F.when(w > h, "landscape").when(h > w, "portrait").otherwise("square")
    return F.struct(
        w.alias("width"),
        h.alias("height"),
        (w * h).alias("pixels"),
        F.trim(F.concat_ws(" ", name("Make"), name("Model"))).alias("camera"),
        shape.alias("orientation"),
        capture_time(F.try_element_at(t, F.lit("DateTimeOriginal"))).alias("captured_at"),
    )


#: Place tags in the order in which they make a label, and the label's start.
PLACE_TAGS = ("Location", "City", "State", "Country", "CountryName")
IPTC_TAGS = ("Sub-location", "City", "State", "Country")
PLACE_LABEL = "Место съёмки: "


def gps_from_tags(exif, xmp, iptc, sidecar) -> Column:
    """Struct latitude, longitude, altitude, geo_text, geo_source from maps of tags.

    Coordinates come from EXIF, else XMP, else the sidecar; altitude only with EXIF ones, negative
    below sea level; the label from the distinct place names of XMP and IPTC, else of the sidecar.
    """
    get = lambda m, k: F.try_element_at(_col(m), F.lit(k))
    pairs = {
        "EXIF GPS": (coordinate(get(exif, "GPSLatitude"), get(exif, "GPSLatitudeRef")), coordinate(get(exif, "GPSLongitude"), get(exif, "GPSLongitudeRef"), False)),
        "XMP GPS": (coordinate(get(xmp, "GPSLatitude")), coordinate(get(xmp, "GPSLongitude"), None, False)),
        "sidecar": (coordinate(get(sidecar, "GPSLatitude")), coordinate(get(sidecar, "GPSLongitude"), None, False)),
    }
    both = {k: a.isNotNull() & b.isNotNull() for k, (a, b) in pairs.items()}
    lat = F.coalesce(*[F.when(both[k], pairs[k][0]) for k in pairs])
    lon = F.coalesce(*[F.when(both[k], pairs[k][1]) for k in pairs])
    source = F.coalesce(*[F.when(both[k], F.lit("XMP GPS" if k == "sidecar" else k)) for k in pairs], F.lit(""))
    below = get(exif, "GPSAltitudeRef") == "1"
    altitude = get(exif, "GPSAltitude").try_cast("double")
    altitude = F.when(both["EXIF GPS"], F.when(below, -altitude).otherwise(altitude))
    names = lambda m, keys: F.array_distinct(F.filter(F.array(*[F.trim(get(m, k)) for k in keys]), lambda x: x.isNotNull() & (x != "")))
    own = F.array_distinct(F.concat(F.coalesce(names(xmp, PLACE_TAGS), F.array().cast("array<string>")), F.coalesce(names(iptc, IPTC_TAGS), F.array().cast("array<string>"))))
    beside = F.coalesce(names(sidecar, PLACE_TAGS), F.array().cast("array<string>"))
    label = lambda x: F.concat(F.lit(PLACE_LABEL), F.array_join(x, ", "))
    text = F.when(F.size(own) > 0, label(own)).when(F.size(beside) > 0, label(beside)).otherwise("")
    described = F.when(F.size(own) > 0, F.concat(source, F.when(source != "", "; ").otherwise(""), F.lit("XMP/IPTC"))).otherwise(source)
    return F.struct(lat.alias("latitude"), lon.alias("longitude"), altitude.alias("altitude"), text.alias("geo_text"), described.alias("geo_source"))


def effective_latitude() -> Column:
    return F.coalesce("user_latitude", "latitude")


def effective_longitude() -> Column:
    return F.coalesce("user_longitude", "longitude")


def effective_place() -> Column:
    return F.when(F.coalesce("user_place", F.lit("")) != "", F.col("user_place")).otherwise(F.col("geo_text"))


def valid_place(latitude, longitude, name) -> Column:
    """Both coordinates or neither, finite and in range, and a name of at most 500 characters."""
    lat, lon = _col(latitude), _col(longitude)
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return ((lat.isNull() & lon.isNull()) | F.coalesce(inside, F.lit(False))) & (F.char_length(F.coalesce(_col(name), F.lit(""))) <= 500)


def search_text(*plain, arrays=()) -> Column:
    """Searchable text of an asset: names and texts, then lists of names, joined by spaces."""
    return F.concat_ws(" ", *[_col(c) for c in plain], *[F.array_join(_col(a), " ") for a in arrays])


#: Fixed value: a word of a search, for engines whose \\w covers all scripts.
TERM = r"[\p{L}\p{N}_]+"


def query_terms(q, most: int = 32) -> Column:
    return F.slice(F.regexp_extract_all(_col(q), F.lit(TERM), F.lit(0)), 1, most)


def canonical_key(*cols) -> Column:
    """SHA-256 of the columns as JSON: a deterministic key of a piece of work."""
    return F.sha2(F.to_json(F.struct(*[_col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def frame_id(asset, ms) -> Column:
    return F.concat_ws(":", _col(asset).cast("string"), F.lit("frame"), _col(ms).cast("string"))


def face_id(asset, version, digest, n, ms=None) -> Column:
    base = F.concat_ws(":", *[_col(c).cast("string") for c in (asset, version, digest, n)])
    return base if ms is None else F.concat(base, F.coalesce(F.concat(F.lit(":frame"), _col(ms).cast("string")), F.lit("")))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def period_bounds(c) -> Column:
    """First and last day of 'YYYY' or 'YYYY-MM'; null for other strings."""
    text = _col(c)
    year = F.when(text.rlike(r"^\d{4}(-(0[1-9]|1[0-2]))?$"), F.substring(text, 1, 4).cast("int"))
    month = F.regexp_extract(text, r"^\d{4}-(\d\d)$", 1).try_cast("int")
    first = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    last = F.when(month.isNotNull(), F.last_day(first)).otherwise(F.make_date(year, F.lit(12), F.lit(31)))
    return F.when(year.isNotNull(), F.struct(first.alias("first_day"), last.alias("last_day")))


def folder_key(c) -> Column:
    """Folder with '/' only, none at the ends, folded; '.' for the root."""
    key = fold(F.regexp_replace(F.regexp_replace(_col(c), r"\\", "/"), "^/+|/+$", ""))
    return F.when(key == "", ".").otherwise(key)


#: EXIF orientation after a quarter turn clockwise.
CLOCKWISE = {1: 6, 2: 7, 3: 8, 4: 5, 5: 2, 6: 3, 7: 4, 8: 1}


def compose_orientation(exif, angle) -> Column:
    """EXIF orientation after turning by 90, 180 or 270 degrees; an unknown one counts as upright.
    Null for other angles."""
    turn = F.create_map(*[F.lit(x) for pair in CLOCKWISE.items() for x in pair])
    at = F.when(_col(exif).between(1, 8), _col(exif).cast("int")).otherwise(F.lit(1))
    once = F.element_at(turn, at)
    twice = F.element_at(turn, once)
    return F.when(_col(angle) == 90, once).when(_col(angle) == 180, twice).when(_col(angle) == 270, F.element_at(turn, twice))


def decide_orientation(view, basis, certain, best_rotation, best_strength, runner_strength) -> Column:
    """Struct rotation, certain from a model's view letter and the face evidence.

    A view is certain if the model is, on the basis of people or scene, unless clearly stronger face
    evidence points elsewhere; without a view, faces at a turned angle suggest it.
    """
    angle = F.when(_col(view) == "A", 0).when(_col(view) == "B", 90).when(_col(view) == "C", 180).when(_col(view) == "D", 270)
    sure = F.coalesce(_col(certain), F.lit(False)) & F.coalesce(_col(basis).isin("people", "scene"), F.lit(False)) & angle.isNotNull()
    against = (_col(best_strength) >= 0.06) & (_col(best_strength) > _col(runner_strength) * 1.8) & (angle != _col(best_rotation))
    by_faces = F.when((_col(best_rotation) != 0) & (_col(best_strength) >= 0.025), _col(best_rotation))
    return F.struct(F.coalesce(angle, by_faces).cast("int").alias("rotation"), (sure & ~F.coalesce(against, F.lit(False))).alias("certain"))
