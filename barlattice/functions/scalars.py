"""Scalar functions as Column builders: everything stays inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def number(x: Column) -> Column:
    """Numeric coercion: what isn't a number, and NaN, is null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_number(x: Column, default: float | None = None) -> Column:
    return F.coalesce(number(x), F.lit(default).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def percent_text(x: Column) -> Column:
    """'12.5%' to 12.5."""
    return number(F.replace(F.trim(x), F.lit("%"), F.lit("")))


def amount_text(x: Column) -> Column:
    """Signed amounts with thousands separators and the units 万 (1e4) and 亿 (1e8); bad ones are 0."""
    t = F.regexp_replace(F.trim(x), "[,，+\\s]|元$", "")
    unit = F.when(t.endswith("亿"), 1e8).when(t.endswith("万"), 1e4).otherwise(1.0)
    return F.coalesce(number(F.regexp_replace(t, "[亿万]$", "")) * unit, F.lit(0.0))


def streak_text(x: Column) -> Column:
    """'6天5板' to 5; else the first number; else null."""
    both = F.nullif(F.regexp_extract(x, r"(\d+)天(\d+)板", 2), F.lit(""))
    return F.coalesce(both, F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit(""))).try_cast("int")


def code6(x: Column) -> Column:
    """The first six digits in a row, else the text, padded to six; longer ones stay as they are."""
    t = F.coalesce(F.nullif(F.regexp_extract(x, r"(\d{6})", 1), F.lit("")), x)
    return F.when(F.length(t) >= 6, t).otherwise(F.lpad(t, 6, "0"))


def venue(code: Column) -> Column:
    """Listing venue by prefix."""
    return F.when(code.startswith("68"), "star").when(code.startswith("30"), "growth").when(code.startswith("8") | code.startswith("4"), "north").when(code.startswith("60"), "main_sh").when(code.startswith("0"), "main_sz").otherwise("other")


def market_prefix(code: Column) -> Column:
    return F.when(code.rlike("^[69]"), "sh").when(code.startswith("8"), "bj").otherwise("sz")


def is_a_share(code: Column) -> Column:
    """Six digits with the prefix of a main, growth or star board."""
    return F.coalesce(code.rlike(r"^(60[0135]|688|00[0-3]|30[01])\d{3}$"), F.lit(False))


def up_limit(code: Column) -> Column:
    """The least change, per cent, that counts as the upper limit: 19.5 on the 20 per cent venues, else 9.5."""
    return F.when(code.rlike("^(30|68)"), 19.5).otherwise(9.5)


def mean_interval(x: str, z: float = 1.96) -> dict[str, Column]:
    """Aggregates: normal interval of the mean; the mean itself for a single value."""
    m, half = F.avg(x), F.when(F.count(x) >= 2, F.stddev_samp(x) / F.sqrt(F.count(x)) * z).otherwise(0.0)
    return {"mean_low": m - half, "mean_high": m + half}


def resolve(columns: list[str], wanted: list[str]) -> str | None:
    """The column that the first of the wanted names to match means: the exact one, else one that starts with it, else the shortest that contains it."""
    for name in wanted:
        found = [c for c in columns if c == name] or [c for c in columns if c.startswith(name)][:1] or sorted((c for c in columns if name in c), key=len)
        if found:
            return found[0]
    return None


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null: greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, flat outside; null stays null."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x.isNotNull(), F.lit(float(points[-1][1])))


def anchor_score(x: Column, a1: float, a2: float, a3: float, a4: float) -> Column:
    return piecewise(x, [(a1, 0), (a2, 50), (a3, 85), (a4, 100)])


def emotion_factor(temperature: Column) -> Column:
    return piecewise(temperature, [(40, 0.0), (50, 0.4), (70, 1.0), (85, 0.6), (95, 0.3)])


def wilson(ups: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, clipped to 0..1; (0, 1) without data."""
    p, n = ratio(ups, n), n.cast("double")
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def content_hash(x: Column) -> Column:
    """MD5 of the first 120 characters without white space, 16 hex digits."""
    return F.substring(F.md5(F.substring(F.regexp_replace(x, r"\s+", ""), 1, 120)), 1, 16)


def word_hits(x: Column, words: list[str]) -> Column:
    """How many of the words occur in the text; each counts once."""
    return sum((F.when(x.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def average_rank(order: Column, group: WindowSpec, ordered: WindowSpec, ties: WindowSpec) -> Column:
    """Percentile rank with average ties, 0..100: rank plus half of the other ties, over the count of values."""
    return (F.rank().over(ordered) + (F.count(order).over(ties) - 1) / 2) / F.count(order).over(group) * 100


def average_rank_in(order: Column, ordered: WindowSpec) -> Column:
    """average_rank of the values that a window puts in order; nulls go first and must have been left out. All of it is one pass over one sort: the rows up to the last tie are rank + ties - 1."""
    up_to = F.count(order).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(ordered) + up_to) / 2 / F.count(order).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * 100


def first_true(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that holds; a null condition doesn't hold."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


#: Labelled half-open bins of the calibration's features: (upper bound, label).
BINS: dict[str, list[tuple[float | None, str]]] = {
    "rps": [(60.0, "<60"), (70.0, "60-70"), (80.0, "70-80"), (90.0, "80-90"), (95.0, "90-95"), (None, "95-100")],
    "ret20": [(-0.1, "<-10"), (-0.05, "-10--5"), (0.0, "-5-0"), (0.05, "0-5"), (0.1, "5-10"), (0.2, "10-20"), (None, "20+")],
    "volume_ratio": [(1.0, "<1.0"), (1.5, "1.0-1.5"), (2.5, "1.5-2.5"), (5.0, "2.5-5"), (None, "5+")],
    "atr_share": [(0.02, "<2"), (0.04, "2-4"), (0.07, "4-7"), (0.12, "7-12"), (None, "12+")],
    "inflow_days": [(1.0, "0"), (2.0, "1"), (3.0, "2"), (4.0, "3"), (5.0, "4"), (None, "5")],
    "ma_bull": [(1.0, "0"), (None, "1")],
    "breakout": [(1.0, "0"), (None, "1")],
}


def bin_of(x: Column, bins: list[tuple[float | None, str | int]]) -> Column:
    out = None
    for high, label in bins:
        test = x < high if high is not None else x.isNotNull()
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def bin_place(x: Column, bins: list[tuple[float | None, str]]) -> Column:
    """The bin's place, 1 for the first, 0 for none."""
    return F.coalesce(bin_of(x, [(high, i) for i, (high, _) in enumerate(bins, 1)]), F.lit(0))


def bin_label(place: Column, bins: list[tuple[float | None, str]]) -> Column:
    """The label of a bin's place; null for 0."""
    return F.get(F.array(*[F.lit(label) for _, label in bins]), place - 1)
