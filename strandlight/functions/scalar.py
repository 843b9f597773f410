"""Row-local functions: arithmetic, angles, grids, text, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def lerp(score: Column, low: float, high: float) -> Column:
    """low at score 0, high at 1; a null score counts as 0.5's middle."""
    return F.lit(low) + (F.lit(high) - F.lit(low)) * F.coalesce(score, F.lit(0.5))


def even(x: Column) -> Column:
    """The even integer at or below round(x), 2 at least."""
    whole = F.bround(x).cast("long")
    return F.greatest(whole - F.pmod(whole, F.lit(2)), F.lit(2))


def fit_inside(width: Column, height: Column, most_w: float, most_h: float) -> tuple[Column, Column]:
    """(width, height) scaled down into a frame, never up, both even."""
    scale = F.least(F.lit(most_w) / width, F.lit(most_h) / height, F.lit(1.0))
    return even(width * scale), even(height * scale)


def fit_long_side(width: Column, height: Column, side: int) -> tuple[Column, Column]:
    """(width, height) with the longer side as given and the other rounded, then floored to even."""
    wide = width >= height
    other = F.bround(F.when(wide, height / width).otherwise(width / height) * side).cast("long")
    other = F.greatest(other - F.pmod(other, F.lit(2)), F.lit(2))
    return F.when(wide, F.lit(side).cast("long")).otherwise(other), F.when(wide, other).otherwise(F.lit(side).cast("long"))


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Sides swap at quarter turns, whichever way."""
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def is_vertical(width: Column, height: Column, rotation: Column) -> Column:
    w, h = display_size(width, height, rotation)
    return h > w


def normal_angle(x: Column) -> Column:
    """An angle in (-180, 180]."""
    turned = F.pmod(x, F.lit(360))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))  # least() passes over nulls


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(a.cast("array<double>"))


def snap(x: Column, grid: Column) -> Column:
    """``x`` on a grid of ``grid`` steps a unit, halves to even, to six places; a grid of 0 or less leaves it."""
    return F.when(grid > 0, F.round(F.rint(x * grid) / grid, 6)).otherwise(x)


def snap_down(x: Column, grid: Column) -> Column:
    return F.when(grid > 0, F.round(F.floor(x * grid + 1e-9) / grid, 6)).otherwise(x)


def snap_up(x: Column, grid: Column) -> Column:
    return F.when(grid > 0, F.round(F.ceil(x * grid - 1e-9) / grid, 6)).otherwise(x)


def reaches(rate: Column, target: Column) -> Column:
    """``rate`` is a whole multiple of ``target``, one at least, within a hundredth."""
    ratio = F.try_divide(rate, target)
    return F.coalesce((F.rint(ratio) >= 1) & (F.abs(ratio - F.rint(ratio)) <= 0.01), F.lit(False))


def slow_motion_ratio(enabled: Column, rate: Column, target: Column) -> Column:
    """Whole slow-down of a clip shot at twice the target rate or more, else 1."""
    return F.when(enabled & (target > 0) & (rate >= 2 * target), F.greatest(F.lit(1).cast("long"), F.bround(rate / target).cast("long"))).otherwise(F.lit(1).cast("long"))


def finite_in(x: Column, low: float, high: float) -> Column:
    """``x`` where it is a finite number in [low, high], else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & x.between(low, high), x)


def safe_name(x: Column, default: str = "clip") -> Column:
    """Letters and digits in lower case, anything else as one underscore."""
    bare = F.lower(F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(bare == "", F.lit(default)).otherwise(bare)


def clip_name(order: Column, taken: Column, source_class: Column, tag: Column, seconds: Column) -> Column:
    """003_20250714_drone_beach_3.5s.mp4; zeros where no date is known."""
    day = F.coalesce(F.date_format(taken, "yyyyMMdd"), F.lit("00000000"))
    return F.concat(F.lpad(order.cast("string"), 3, "0"), F.lit("_"), day, F.lit("_"), safe_name(source_class), F.lit("_"), safe_name(tag), F.lit("_"), F.format_string("%.1f", seconds), F.lit("s.mp4"))


def two_places(x: Column) -> Column:
    """Text of a number of 0 or more to two places, rounded as its binary value demands and halves to even, as C and Python print it.

    format_string() rounds the shortest decimal text of a number instead: it makes 0.24 of 0.235, which lies below the half.
    """
    low = F.floor(x * 100)
    odd = (2 * low + 1).cast("double")
    half = odd / 200
    # where x is the double nearest the half: which side of it that lies on, from half * 200 in two exact parts
    split = half * 134217729.0
    high = split - (split - half)
    product = half * 200.0
    over = (product - odd) + ((high * 200.0 - product) + (half - high) * 200.0)
    up = (x > half) | ((x == half) & ((over > 0) | ((over == 0) & (F.pmod(low, F.lit(2)) == 1))))
    hundredths = low + up.cast("long")
    return F.format_string("%d.%02d", F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100)))


def timecode(seconds: Column) -> Column:
    """m:ss.s"""
    tenths = F.bround(seconds * 10).cast("long")
    return F.format_string("%d:%04.1f", F.floor(tenths / 600), (F.pmod(tenths, F.lit(600)) / 10).cast("double"))


def timecode_seconds(text: Column) -> Column:
    """Seconds of hh:mm:ss,mmm or hh:mm:ss.mmm, else null."""
    at = lambda k: F.regexp_extract(text, r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})", k)
    return F.when(at(1) != "", at(1).cast("double") * 3600 + at(2).cast("double") * 60 + at(3).cast("double") + F.rpad(at(4), 3, "0").cast("double") / 1000)


def rational(text: Column) -> Column:
    """num/den as a double; null where it is no positive rate."""
    top, bottom = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)", 1), F.regexp_extract(text, r"^[^/]*/(\d+(?:\.\d+)?)$", 1)
    value = F.try_divide(F.expr("1.0D") * F.nullif(top, F.lit("")).cast("double"), F.coalesce(F.nullif(bottom, F.lit("")), F.lit("1")).cast("double"))
    return F.when(value > 0, value)


def iso6709(text: Column) -> tuple[Column, Column, Column]:
    """(lat, lon, alt) of +DD.D+DDD.D[+AAA]/, nulls where there is none."""
    pattern = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?"
    return tuple(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double") for k in (1, 2, 3))


def bit_depth(pix_fmt: Column) -> Column:
    """Bits of a pixel format's name, 8 where it names none."""
    return F.coalesce(F.nullif(F.regexp_extract(pix_fmt, r"p(\d{2})(?:le|be)?$", 1), F.lit("")).cast("int"), F.lit(8))


def bare_json(text: Column) -> Column:
    """An answer's JSON object without code fences around it, null where none is."""
    inner = F.btrim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))
    return F.when(F.startswith(inner, F.lit("{")) & F.endswith(inner, F.lit("}")), inner)


def short_digest(struct: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a struct's JSON."""
    return F.substring(F.sha2(F.to_json(struct), 256), 1, length)


def glob_pattern(glob: str) -> str:
    """The regular expression of a shell pattern."""
    import fnmatch

    return fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")


def even_picks(n: Column, most: int) -> Column:
    """Indexes of up to ``most`` of ``n`` items, evenly spread with both ends."""
    count = F.least(n, F.lit(most))
    return F.when(n <= 0, F.array().cast("array<long>")).when(count == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.rint(i * (n - 1) / (count - 1)).cast("long")))
