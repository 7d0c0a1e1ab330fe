"""Coordinates written in many ways: decimal degrees, commas, degrees-minutes-seconds, marks, lost points, swapped axes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Region(NamedTuple):
    """The span in which positions are expected; it decides only where a pair can be read in several ways."""

    south: float
    north: float
    west: float
    east: float


def degrees_of(text: Column) -> Column:
    """Number of degrees in ``text``, null where there is none. S, W and O (ovest) make it negative.

    "42.1", "42,1", "+42.1", "N 42.1", "lat 42.1", "42.1°", "42°06'00.0"N" are read; a value without a decimal point is
    returned as it stands, so that its lost point can be put back later.
    """
    t = F.upper(F.trim(F.regexp_replace(text.cast("string"), r"[\s ]+", " ")))
    sign = F.when(t.rlike(r"(^|[^A-Z])[SWO]([^A-Z]|$)") | t.rlike(r"^\D*-\s*\d"), -1.0).otherwise(1.0)
    dms = r"^[^\d]*(\d{1,3})\s*[°º]\s*(\d{1,2})\s*['’′]\s*(\d{1,2}(?:[.,]\d+)?)?"
    d, m, s = (F.regexp_extract(t, dms, i) for i in (1, 2, 3))
    from_dms = d.cast("double") + m.cast("double") / 60 + F.coalesce(F.when(s != "", F.replace(s, F.lit(","), F.lit(".")).cast("double")), F.lit(0.0)) / 3600
    number = F.regexp_extract(t, r"^(?:LAT|LON|LONG|LNG|[NSEWO])?[.:]?\s*[+-]?\s*(\d+(?:[.,]\d+)?(?:E[+-]?\d+)?)\s*°?\s*[NSEWO]?$", 1)
    plain = F.when(number != "", F.replace(number, F.lit(","), F.lit(".")).cast("double"))
    return F.when(d != "", from_dms).otherwise(plain) * sign


def usual_region(df: DataFrame, lat: Column, lon: Column, margin: float = 1.0) -> Region | None:
    """Where the plainly readable positions of ``df`` lie: quartiles of all rows widened by their distance and ``margin``.

    One aggregation over all rows; null where no row has a usable pair.
    """
    usable = (lat.between(-90, 90)) & (lon.between(-180, 180)) & ~((lat == 0) & (lon == 0))
    q = df.where(usable).agg(F.percentile_approx(lat, F.array(F.lit(0.25), F.lit(0.75)), 1000).alias("a"), F.percentile_approx(lon, F.array(F.lit(0.25), F.lit(0.75)), 1000).alias("o")).first()
    if q is None or q["a"] is None:
        return None
    (s, n), (w, e) = q["a"], q["o"]
    dy, dx = 3 * (n - s) + margin, 3 * (e - w) + margin
    return Region(s - dy, n + dy, w - dx, e + dx)


def _inside(lat: Column, lon: Column, region: Region) -> Column:
    return lat.between(region.south, region.north) & lon.between(region.west, region.east)


def _pointed(value: Column, low: float, high: float) -> Column:
    """``value`` with its decimal point put back so that it falls into [low, high]; null where no place fits."""
    most = max(abs(low), abs(high))
    k = F.greatest(F.lit(1.0), F.ceil(F.log10(F.abs(value) / most)))
    once, more = value / F.pow(F.lit(10.0), k), value / F.pow(F.lit(10.0), k + 1)
    return F.when(once.between(low, high), once).when(more.between(low, high), more)


def position_of(lat: Column, lon: Column, region: Region | None) -> Column:
    """Struct (lat, lon) that a pair of degrees evidently means, or null.

    As written where both are degrees and inside the usual region; else swapped, else with lost decimal points put back,
    where that brings the pair into the region; else as written. (0, 0), NaN and anything beyond the globe are unusable.
    """
    both = F.struct(F.nanvl(lat.cast("double"), F.lit(None).cast("double")).alias("a"), F.nanvl(lon.cast("double"), F.lit(None).cast("double")).alias("o"))
    # A lambda's variable holds the pair, so the expressions that read it are not repeated in every branch.
    return F.get(F.transform(F.array(both), lambda p: _meant(p["a"], p["o"], region)), F.lit(0))


def _meant(a: Column, o: Column, region: Region | None) -> Column:
    pair = lambda x, y: F.struct(x.alias("lat"), y.alias("lon"))
    on_globe = a.between(-90, 90) & o.between(-180, 180) & ~((a == 0) & (o == 0))
    out = F.when(a.isNull() | o.isNull(), F.lit(None))
    if region is not None:
        pa, po = _pointed(a, region.south, region.north), _pointed(o, region.west, region.east)
        sa, so = _pointed(o, region.south, region.north), _pointed(a, region.west, region.east)
        whole = (F.abs(a) > 90) | (F.abs(o) > 180)
        out = (
            out.when(_inside(a, o, region), pair(a, o))
            .when(_inside(o, a, region), pair(o, a))
            .when(whole & pa.isNotNull() & po.isNotNull(), pair(pa, po))
            .when(whole & sa.isNotNull() & so.isNotNull(), pair(sa, so))
        )
    return out.when(on_globe, pair(a, o))
