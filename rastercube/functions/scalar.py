"""Scalar expressions: names, times, identifiers, chunks, nodata, pixel types. Built-in functions only."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark type, least and greatest value, and bytes of each pixel type.
DTYPES: dict[str, tuple[str, float | None, float | None, int]] = {
    "int8": ("tinyint", -(2**7), 2**7 - 1, 1),
    "uint8": ("smallint", 0, 2**8 - 1, 1),
    "int16": ("smallint", -(2**15), 2**15 - 1, 2),
    "uint16": ("int", 0, 2**16 - 1, 2),
    "int32": ("int", -(2**31), 2**31 - 1, 4),
    "uint32": ("bigint", 0, 2**32 - 1, 4),
    "int64": ("bigint", -(2**63), 2**63 - 1, 8),
    "uint64": ("decimal(20,0)", 0, 2**64 - 1, 8),
    "float32": ("float", None, None, 4),
    "float64": ("double", None, None, 8),
}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_float(dtype: str) -> bool:
    return dtype.startswith("float")


def short_number(x: Column | str) -> Column:
    """Six significant digits without trailing zeros, as C's ``%g`` prints them: 10, 0.5, 1e+06."""
    s = F.format_string("%.6g", col(x).cast("double"))
    s = F.regexp_replace(s, r"(\.\d*?)0+(?=e|$)", "$1")
    return F.when(col(x) == 0, F.lit("0")).otherwise(F.regexp_replace(s, r"\.(?=e|$)", ""))


def nominal_time(datetime: Column | str, start: Column | str, end: Column | str) -> Column:
    """The first known of three stamps; fails if there is none."""
    return F.coalesce(col(datetime), col(start), col(end), F.raise_error(F.lit("Item has no timestamp")))


def solar_hours(lon: Column | str) -> Column:
    """Whole hours of solar time ahead of UTC, toward zero: 15 degrees an hour."""
    return (col(lon).cast("double") / 15).cast("int")


def solar_time(ts: Column | str, lon: Column | str) -> Column:
    """Approximate local solar time; the time itself where the longitude is not known."""
    h = F.coalesce(solar_hours(lon), F.lit(0))
    return col(ts) + F.make_dt_interval(F.lit(0), h, F.lit(0), F.lit(0).cast("decimal(18,6)"))


def solar_day(ts: Column | str, lon: Column | str) -> Column:
    return solar_time(ts, lon).cast("date")


def band_of(name: Column | str) -> Column:
    """``asset`` or ``asset.n`` as (asset, idx). Only a numeric suffix is an index, so dotted asset names are whole."""
    n = col(name)
    numbered = n.rlike(r"^.+\.[0-9]+$")
    return F.struct(
        F.when(numbered, F.regexp_extract(n, r"^(.+)\.([0-9]+)$", 1)).otherwise(n).alias("asset"),
        F.when(numbered, F.regexp_extract(n, r"^(.+)\.([0-9]+)$", 2).cast("int")).otherwise(F.lit(1)).alias("idx"),
    )


NAMESPACE = uuid.UUID("55d26088-a6d0-5c77-bf9a-3a7f3c6a6dab")


def uuid5(name: Column | str, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def is_uuid(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"(?i)^\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$"), F.lit(False))


def uuid_text(x: Column | str) -> Column:
    """A UUID in any of its forms, as lower case in five groups."""
    h = F.lower(F.regexp_replace(col(x), "[^0-9a-fA-F]", ""))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def chunk_sizes(n: Column | str, size: Column | str) -> Column:
    """A length in chunks: 11 by 4 is 4, 4, 3; a size below one or beyond the length is one chunk."""
    n, c = col(n).cast("int"), col(size).cast("int")
    c = F.when((c < 1) | (c >= n), F.greatest(n, F.lit(1))).otherwise(c)
    return F.when(n == 0, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), c), lambda o: F.least(c, n - o)))


def chunks_of(n: int, size: int) -> tuple[int, ...]:
    if size < 1 or size >= n:
        return (n,)
    return tuple(min(size, n - i) for i in range(0, n, size))


# --- nodata


def source_nodata(file: Column, fallback: Column, override: Column) -> Column:
    return F.coalesce(override, file, fallback)


def output_nodata(dtype: str, fill: Column, source: Column) -> Column:
    """Fill value, else NaN for floating point, else the source's."""
    return F.coalesce(fill, F.lit(math.nan), source) if is_float(dtype) else F.coalesce(fill, source)


def fill_of(dtype: str, nodata: float | None) -> float:
    return nodata if nodata is not None else (math.nan if is_float(dtype) else 0)


def missing(v: Column | str, nodata: Column | float | None, dtype: str) -> Column:
    """Where a pixel has no value: NaN or nodata in floating point, nodata in integers, nowhere if that is not set."""
    nd = nodata if isinstance(nodata, Column) else F.lit(nodata)
    equal = F.coalesce(col(v) == nd, F.lit(False))
    return (F.isnan(col(v)) | equal) if is_float(dtype) else equal


def same_nodata(a: Column | str, b: Column | str) -> Column:
    """Null is null, NaN is NaN, else by value."""
    return col(a).eqNullSafe(col(b))


def to_dtype(v: Column | str, dtype: str) -> Column:
    """Values in a pixel type: integers are cut to whole numbers and held to the type's range; NaN becomes 0."""
    spark, lo, hi, _ = DTYPES[dtype]
    if lo is None:
        return col(v).cast(spark)
    x = F.when(F.isnan(col(v).cast("double")), F.lit(0.0)).otherwise(col(v).cast("double"))
    if hi >= 2**53:  # beyond what a double can hold exactly
        whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
        d = F.when(F.isnan(col(v).cast("double")), F.lit(0)).otherwise(col(v)).try_cast("decimal(38,6)")
        d = F.when(d >= 0, F.floor(d)).when(d < 0, F.ceil(d)).when(col(v) > 0, whole(hi)).otherwise(whole(lo))
        return F.greatest(F.least(d, whole(hi)), whole(lo)).cast(spark)
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))).cast(spark)


def pick_overview(shrink: Column | str, overviews: Column | str) -> Column:
    """Index of the coarsest overview that does not shrink more than asked; null for none. The last of equals."""
    s = col(shrink)
    fit = F.transform(col(overviews), lambda o, i: F.when(o <= s, F.struct(o.alias("o"), i.alias("i"))))
    return F.array_max(F.filter(fit, lambda x: x.isNotNull()))["i"]


# --- band math


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b), null where the sum is zero."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.try_divide(a - b, a + b)


def color_of(v: Column | str, lo: float, hi: float, colors: list[str]) -> Column:
    """The entry of a color table for a value scaled from lo..hi; ends are held."""
    i = F.floor((col(v).cast("double") - lo) / (hi - lo) * len(colors)).cast("int")
    i = F.greatest(F.lit(0), F.least(F.lit(len(colors) - 1), i))
    return F.element_at(F.array(*map(F.lit, colors)), i + 1)
