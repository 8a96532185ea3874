"""Names, dates, words and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_KEY = r"^\d{4}-\d{2}-\d{2}$"
# Name fields of a geocoder's answer, best first, and the towns after them.
NAME_FIELDS = ("tourism", "natural", "amenity", "leisure", "historic", "mountain_pass", "peak", "water", "waterway", "suburb", "neighbourhood", "quarter")
TOWN_FIELDS = ("city", "town", "village", "hamlet", "county")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def month_day(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d")


def day_title(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, MMMM d")


def date_range(low: Column, high: Column) -> Column:
    """One day, days of a month, days of a year, or days of two years."""
    same_year, same_month = F.year(low) == F.year(high), F.month(low) == F.month(high)
    return (
        F.when(F.to_date(low) == F.to_date(high), F.date_format(low, "MMMM d, yyyy"))
        .when(same_year & same_month, F.concat(month_day(low), F.lit("–"), F.date_format(high, "d, yyyy")))
        .when(same_year, F.concat(month_day(low), F.lit(" – "), F.date_format(high, "MMMM d, yyyy")))
        .otherwise(F.concat(F.date_format(low, "MMMM d, yyyy"), F.lit(" – "), F.date_format(high, "MMMM d, yyyy")))
    )


def query_words(q: Column) -> Column:
    """The words of a query that are longer than two."""
    return F.filter(F.regexp_extract_all(F.lower(q), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 2)


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def strip_number(name: Column) -> Column:
    """A name without its trailing "(2)"."""
    return F.regexp_replace(name, r"\s*\(\d+\)$", "")


def strip_counts(title: Column) -> Column:
    """A story title up to its photo count."""
    return F.trim(F.split(title, r"\s*[·—]\s*\d+\s+photos")[0])


def clean_name(name: Column, *, most: int = 120, empty: str = "untitled") -> Column:
    """Letters, digits, "-", "_" and blanks stay."""
    out = F.substring(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}\-_ ]", "_")), 1, most)
    return F.when(F.length(out) > 0, out).otherwise(empty)


def ranked_name(rank: Column, name: Column, digits: int = 3) -> Column:
    return F.when(rank.isNotNull(), F.format_string(f"%0{digits}d_%s", rank, name)).otherwise(name)


def breadcrumb(visits: Column) -> Column:
    """Names of visits (structs of name and elevation_m) with their heights."""
    label = lambda v: F.when(F.coalesce(v["elevation_m"], F.lit(0)) != 0, F.concat(v["name"], F.lit(" ("), F.format_number(v["elevation_m"], 0), F.lit("m)"))).otherwise(v["name"])
    return F.array_join(F.transform(visits, label), " › ")


def route_title(day_: Column, photos: Column, names: Column) -> Column:
    """The title of a day from the places it visits, in order."""
    u = F.array_distinct(names)
    n = F.size(u)
    first, last = F.get(u, F.lit(0)), F.get(u, n - 1)
    middle = F.array_join(F.slice(u, 2, F.greatest(n - 2, F.lit(0))), ", ")
    route = F.when(n == 1, F.concat(F.lit("Exploring "), first)).when(n == 2, F.concat(first, F.lit(" to "), last)).otherwise(F.concat(first, F.lit(" to "), last, F.lit(" via "), middle))
    tail = F.concat(F.lit(" · "), photos.cast("string"), F.lit(" photos"))
    return F.when(F.coalesce(n, F.lit(0)) < 1, F.concat(day_, tail)).otherwise(F.concat(day_, F.lit(" · "), route, tail))


def canonical(text: Column) -> Column:
    """Lower case without ASCII punctuation, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\s+", " "))


def keyword_bucket(tags: Column, keywords: dict[str, list[str]]) -> Column:
    """The first bucket of which a keyword stands in the joined tags, across two tags too; null without."""
    text = F.array_join(F.transform(tags, F.lower), " ")
    out = F.lit(None).cast("string")
    for label, words in reversed(keywords.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def is_generic(name: Column, words: list[str]) -> Column:
    """A name too common to look up."""
    return F.arrays_overlap(F.split(F.lower(name), r"\s+"), F.array(*[F.lit(w) for w in words])) | (F.length(name) < 4)


def trim_summary(text: Column, most: int = 480) -> Column:
    """Whole sentences up to ``most`` characters; the first characters where the first sentence is longer."""
    sentences = F.split(F.trim(text), r"(?<=[.!?])\s+")
    step = lambda s, x: F.when(s["over"] | (F.length(s["out"]) + F.length(x) + 1 > most), F.struct(s["out"].alias("out"), F.lit(True).alias("over"))).otherwise(F.struct(F.trim(F.concat(s["out"], F.lit(" "), x)).alias("out"), F.lit(False).alias("over")))
    kept = F.aggregate(sentences, F.struct(F.lit("").alias("out"), F.lit(False).alias("over")), step)["out"]
    return F.when(F.length(kept) > 0, kept).otherwise(F.substring(text, 1, most))


def exif_time(*raw: Column) -> Column:
    """The first of the raw times that reads as one, with colons or dashes in its date."""
    tries = [F.expr("null").cast("timestamp_ntz")]
    for r in raw:
        t = F.trim(r)
        iso_ = F.regexp_replace(t, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
        tries.append(F.when(iso_.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(iso_, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")))
    return F.coalesce(*tries)


def dms_degrees(dms: Column, ref: Column) -> Column:
    """Three rationals to signed degrees; null for anything else."""
    p = F.split(F.trim(dms), r"\s+")
    part = lambda k: F.try_divide(F.expr("cast(null as double)") if k is None else F.split(F.get(p, F.lit(k)), "/")[0].cast("double"), F.get(F.split(F.get(p, F.lit(k)), "/"), F.lit(1)).cast("double"))
    value = part(0) + part(1) / 60 + part(2) / 3600
    return F.when((F.size(p) == 3) & dms.rlike(r"^\s*\d+/\d+\s+\d+/\d+\s+\d+/\d+\s*$"), F.when(ref.isin("S", "W"), -value).otherwise(value))


def place_name(payload: Column) -> Column:
    """The best name in a geocoder's JSON answer."""
    field = lambda path: F.nullif(F.trim(F.get_json_object(payload, path)), F.lit(""))
    own = F.when(~F.coalesce(F.get_json_object(payload, "$.type") == "administrative", F.lit(False)), F.nullif(F.get_json_object(payload, "$.name"), F.lit("")))
    rest = [field("$.extratags.name"), *(field(f"$.address.{f}") for f in (*NAME_FIELDS, *TOWN_FIELDS))]
    return F.coalesce(own, *rest, F.nullif(F.trim(F.split(F.get_json_object(payload, "$.display_name"), ",")[0]), F.lit("")), F.lit("Unknown location"))


def geo_key(degrees: Column) -> Column:
    """The cache's key, three digits, half to even."""
    return F.bround(degrees, 3)
