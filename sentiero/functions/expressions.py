"""Column expressions: null-safe arithmetic, bins, clocks, text normalisation, terrain and walking speed.

All are JVM-side and stay inside code generation. Null in gives null out unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """``c`` held within bounds; null stays null."""
    out = c
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient, null for a null or zero divisor."""
    return F.when(b != 0, a / b)


def plausible(c: Column, low: float, high: float) -> Column:
    """Value within [low, high], else null."""
    return F.when(c.between(low, high), c)


def italian_number(text: Column) -> Column:
    """"1.234,5" and "1234.5" as numbers: dots are separators of thousands only where a comma is present."""
    t = F.trim(text.cast("string"))
    return finite(F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t).try_cast("double"))


def truth_score(text: Column, missing: float = 50.0) -> Column:
    """true/1 as 100, false/0 as 0, anything else as ``missing``."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1"), 100.0).when(t.isin("false", "0"), 0.0).otherwise(missing)


def first_number(*cs: Column) -> Column:
    """First of the columns that holds a number."""
    return F.coalesce(*[finite(c.try_cast("double")) for c in cs])


def first_text(*cs: Column) -> Column:
    """First of the columns that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def bins(c: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """Label of the interval of ``c``: one label more than edges; an edge belongs to the interval below if right-closed."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c <= edge if right_closed else c < edge, label)
    return out.otherwise(labels[-1])


#: Edges and labels of the classes used for scores, walking times and slopes.
SCORE_EDGES, SCORE_LABELS = (25, 50, 75), ("bassa", "medio-bassa", "medio-alta", "alta")
TIME_EDGES, TIME_LABELS = (5, 10, 15, 20), ("0-5", "5-10", "10-15", "15-20", ">20")
SLOPE_EDGES, SLOPE_LABELS = (5, 10, 20, 30), ("<5", "5-10", "10-20", "20-30", ">30")
SLOPE6_EDGES, SLOPE6_LABELS = (3, 8, 15, 25, 35), ("pianeggiante", "lieve", "moderata", "marcata", "forte", "molto forte")


def time_band(minutes: Column) -> Column:
    """Walking-time band; 0 and negative times have none."""
    return F.when(minutes > 0, bins(minutes, TIME_EDGES, TIME_LABELS))


def within_flag(minutes: Column, limit: float) -> Column:
    """1 within the limit, 0 beyond it or where no time is known."""
    return F.coalesce((minutes <= limit).cast("int"), F.lit(0))


def clock_seconds(text: Column) -> Column:
    """"HH:MM:SS" as seconds; hours may pass 24, minutes and seconds not 59; anything else is null."""
    p = F.split(F.trim(text), ":")
    h, m, s = (F.when(F.trim(F.get(p, F.lit(i))).rlike(r"^\d+$"), F.trim(F.get(p, F.lit(i))).try_cast("int")) for i in range(3))
    return F.when((F.size(p) == 3) & m.between(0, 59) & s.between(0, 59), (h * 3600 + m * 60 + s).cast("double"))


def clock_text(seconds: Column) -> Column:
    """Seconds as "HH:MM", minutes rounded half-even."""
    minutes = F.bround(seconds / 60).cast("int")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), minutes % 60))


def plain_ascii(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüý", "aaaaaaceeeeiiiinooooouuuuy")


def snake_name(c: Column, longest: int = 140, default: str = "") -> Column:
    """Lower case, other characters than letters and digits as one "_", none at the ends, cut at ``longest``."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, longest), F.lit("")), F.lit(default))


def slug(c: Column, longest: int = 140) -> Column:
    """Accent-free words joined by "-"."""
    return F.substring(F.regexp_replace(F.regexp_replace(plain_ascii(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)


def plain_words(c: Column, drop: Sequence[str] = ()) -> Column:
    """Accent-free words with single blanks, without the words to ``drop``; null as empty."""
    t = plain_ascii(F.trim(F.coalesce(c, F.lit(""))))
    if drop:
        t = F.regexp_replace(t, r"\b(?:" + "|".join(drop) + r")\b", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def route_name(c: Column) -> Column:
    """Upper case without blanks around and without a trailing ".0"."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\.0$", "")


def join_key(c: Column) -> Column:
    """Key as text: a trailing ".0" off, then blanks off."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def decimal_comma(c: Column, digits: int = 1, unit: str = "", missing: str = "n.d.") -> Column:
    """Number with a decimal comma and a unit; ``missing`` for null."""
    text = F.concat(F.replace(F.format_string(f"%.{digits}f", F.bround(c, digits)), F.lit("."), F.lit(",")), F.lit(unit))
    return F.when(c.isNotNull(), text).otherwise(missing)


def count_label(c: Column, one: str, many: str) -> Column:
    """"1 service", "3 services": the number rounded half-even."""
    n = F.bround(c).cast("bigint")
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def tobler_kmh(slope: Column, least: float | None = None) -> Column:
    """Walking speed on a slope (rise over run), not under ``least``."""
    speed = 6.0 * F.exp(-3.5 * F.abs(slope + 0.05))
    return speed if least is None else F.greatest(speed, F.lit(least))


def grade(rise: Column, run: Column, limit: float = 1.5) -> Column:
    """Rise over run held within +-limit; 0 for no run."""
    return F.when(run > 0, clip(rise / run, -limit, limit)).otherwise(0.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def metres_to_degrees(metres: Column | float, lat: Column) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that span ``metres`` at a latitude."""
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return m / 111_320.0, m / (111_320.0 * F.cos(F.radians(lat)))


def weekday(date: Column) -> Column:
    """English weekday name in lower case."""
    return F.lower(F.date_format(date, "EEEE"))


def mean_of(*cs: Column, default: float = 50.0) -> Column:
    """Mean of the columns that aren't null, ``default`` if all are."""
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    return F.when(n > 0, total / n).otherwise(default)


def least_of(*cs: Column) -> Column:
    """Least of the columns that aren't null, also of a single one; null for none."""
    return F.array_min(F.array(*cs))


def sum_of(*cs: Column) -> Column:
    """Sum of the columns, null as 0."""
    return sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))


def date_in_title(title: Column) -> Column:
    """The text after the last " di " of a title, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(title, r" di (.+)$", 1)), F.lit(""))


def add_missing(df, aliases: dict[str, str]):
    """``df`` with each alias as a copy of its column, where the alias isn't there yet and the column is."""
    return df.withColumns({a: F.col(c) for a, c in aliases.items() if a not in df.columns and c in df.columns})


def has_items(values: Column) -> Column:
    """Whether an array holds anything; false for null."""
    return F.coalesce(F.size(values) > 0, F.lit(False))
