"""Scalar expressions: rounding modes, medians of arrays, clipping, angles, geodesy, identifiers."""

from __future__ import annotations

import re
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest integer, halves up."""
    return F.floor(x + 0.5).cast("long")


def half_even(x: Column) -> Column:
    """The nearest integer, halves to the even one."""
    return F.rint(x).cast("long")


def micro(x: Column) -> Column:
    """x in millionths, halves up: a value that engines agree on.

    Billionths come first, so that sums of binary fractions that differ in the last bit don't fall on either side of a half.
    """
    return F.floor(F.floor(x * 1e9 + 0.5) / 1000 + 0.5).cast("long")


def milli(x: Column) -> Column:
    """x in thousandths, halves up: for lengths in metres from positions on the globe."""
    return F.floor(x * 1e3 + 0.5).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def array_median(a: Column) -> Column:
    """The median of an array without nulls; null if it is empty."""
    s = F.array_sort(a)
    n = F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def axis_difference(a: Column, b: Column) -> Column:
    """The angle between two undirected axes, in degrees from 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def angular_difference(a: Column, b: Column) -> Column:
    """The angle between two directions, in degrees from 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres in one degree of latitude and of longitude (series of the WGS 84 ellipsoid; fixed values)."""
    p = F.radians(lat)
    north = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    east = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    return north, east


def longitude_wrap(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def safe_id(x: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay; runs of others become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def fixed4(x: Column) -> Column:
    """Four decimals as text; NA for what isn't a finite number."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.format_string("%.4f", x)).otherwise("NA")


def zero_padded(x: Column, width: int) -> Column:
    """Digits of a text or number, filled with zeros from the left; longer ones stay whole."""
    t = x.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def thousands(x: Column) -> Column:
    """500000 as 500k; numbers that aren't whole thousands stay."""
    return F.when((x != 0) & (x % 1000 == 0), F.concat((x / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(x.cast("string"))


def rendered(template: str, **fields: Column) -> Column:
    """A template with {name} and {name:k} (thousands) filled in; unknown names are an error."""
    parts, at = [], 0
    for m in re.finditer(r"\{([a-z_][a-z0-9_]*)(:k)?\}", template):
        if m[1] not in fields:
            raise ValueError(f"unknown field in template: {m[1]}")
        parts += [F.lit(template[at : m.start()]), thousands(fields[m[1]]) if m[2] else fields[m[1]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def exif_time(x: Column) -> Column:
    """A capture time as cameras write it, 2024:05:01 10:20:30 (the first 19 characters), as a timestamp; else null."""
    return F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def failures(**rules: Column) -> Column:
    """The names of the rules that don't hold, as an array; a rule without an answer doesn't hold."""
    return F.filter(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(None)).otherwise(F.lit(k)) for k, r in rules.items())), lambda x: x.isNotNull())


def threshold_label(x: Column) -> Column:
    """15 for 15.0 and 2p5 for 2.5."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(x.cast("string"), r"\.", "p"))


def equivalent_radius(area: Column) -> Column:
    return F.sqrt(area / pi)


def missing_to_null(x: Column) -> Column:
    """Blank and the usual marks of missing text become null."""
    t = F.trim(x)
    return F.when(F.lower(t).isin("", "null", "none", "na", "nan"), F.lit(None)).otherwise(t)


def first_positive(*columns: Column) -> Column:
    """The first of the values that is finite and above 0; null if none is."""
    good = [F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c) for c in columns]
    return F.coalesce(*good)


def radius_m(radius: Column, area: Column, spatialr: Column, pixel: Column) -> Column:
    """A scale's radius: as given, else from its area, else from pixels; reading it fails if none is usable."""
    found = first_positive(radius, F.sqrt(area / pi), spatialr * pixel)
    return F.coalesce(found, F.raise_error(F.lit("no usable radius")).cast("double"))


def first_filled(*columns: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def screening_status(return_code: Column, ortho: Column, log: Column) -> Column:
    """SUCCESS with an output, FAILED with a log but none, CRITICAL without both."""
    return F.when((return_code == 0) & (F.length(F.trim(ortho)) > 0), "SUCCESS").when(F.length(F.trim(log)) > 0, "FAILED").otherwise("CRITICAL")


def adaptive_widths(ranger: Column, minsize: Column, spatialr: Column) -> Column:
    """Widths of perturbations: struct<dr, dm, ds>."""
    return F.struct(F.greatest(F.lit(0.005), 0.1 * ranger).alias("dr"), F.greatest(F.lit(5.0), 0.2 * minsize).alias("dm"), F.when(spatialr <= 3, 0).otherwise(1).alias("ds"))


def padded(values: Column, size: Column) -> Column:
    """An array stretched to a size with its last value, or cut to it."""
    n = F.size(values)
    return F.when(n >= size, F.slice(values, 1, size)).otherwise(F.concat(values, F.array_repeat(F.element_at(values, -1), (size - n).cast("int"))))


def legacy_score(edge: Column, jump: Column, flutter: Column, spatial: Column, central: Column, spread: Column) -> Column:
    """The older stability score, kept as a diagnostic: fixed weights, not clipped."""
    return 1 - 0.35 * edge - 0.35 * jump - 0.2 * flutter - 0.2 * spatial + 0.5 * central - 0.1 * spread
