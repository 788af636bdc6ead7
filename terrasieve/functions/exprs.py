"""Column builders for cleaning, binning and labelling. All are plain expressions: no Python runs on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def positive(c: Column | str) -> Column:
    """Null for zero and below."""
    return F.when(col(c) > 0, col(c))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; 0 where either is null or both are 0, null where only b is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(a.isNull() | b.isNull() | ((a == 0) & (b == 0)), 0.0).otherwise(F.try_divide(a, b))


def power_to_db(c: Column | str) -> Column:
    """10 log10 of a linear power; null where that isn't positive."""
    return 10 * F.log10(positive(c))


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(a + b == 0, 0.0).otherwise(F.try_divide(a - b, a + b))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Within bounds; null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def cross_entropy(y: Column | str, p: Column | str, eps: float = 1e-15) -> Column:
    """-y ln p - (1 - y) ln(1 - p), p kept inside (0, 1)."""
    y, p = col(y), clip(p, eps, 1 - eps)
    return -y * F.log(p) - (1 - y) * F.log(1 - p)


def digitize(c: Column | str, edges: Sequence[float], *, right: bool = False) -> Column:
    """Count of edges at or below the value (``right``: below it); null for null."""
    x = col(c)
    steps = [F.when((x > e) if right else (x >= e), 1).otherwise(0) for e in edges]
    return F.when(x.isNotNull(), sum(steps[1:], steps[0]))


def loss_class(ratio: Column | str) -> Column:
    """0: none, then up to a quarter, half, three quarters, all."""
    return digitize(ratio, (0, 0.25, 0.5, 0.75), right=True)


def bit_field(c: Column | str, low: int, width: int) -> Column:
    """``width`` bits from bit ``low`` on."""
    return F.shiftright(col(c), low).bitwiseAND((1 << width) - 1)


#: First bit and width of the quality fields.
QA_FIELDS = {"cloud": (4, 1), "cloud_confidence": (5, 2), "shadow": (7, 2), "snow": (9, 2), "cirrus": (11, 2)}


def cloud_mask(qa: Column | str) -> Column:
    """Cloud, or snow or shadow of high confidence."""
    f = {k: bit_field(qa, *v) for k, v in QA_FIELDS.items()}
    return (f["cloud"] == 1) | (f["snow"] == 3) | (f["shadow"] == 3)


def recode(c: Column | str, groups: Mapping[str, Sequence], default: str | None = None, null: str | None = None) -> Column:
    """The name of the group that lists the value."""
    out = F
    for name, values in groups.items():
        out = out.when(col(c).isin(list(values)), name)
    if null is not None:
        out = out.when(col(c).isNull(), null)
    return out.otherwise(default)


def lookup(c: Column | str, table: Mapping) -> Column:
    """A literal dictionary; null where it has no entry."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), col(c))


def outcome(predicted: Column | str, actual: Column | str) -> Column:
    """TP, FP, FN or TN of two booleans."""
    p, a = col(predicted), col(actual)
    return F.when(p & a, "TP").when(p & ~a, "FP").when(~p & a, "FN").when(~p & ~a, "TN")


def pair_code(predicted: Column | str, actual: Column | str, n: int = 3) -> Column:
    """One number for each pair of classes 0 to n - 1."""
    return col(predicted) * n + col(actual)


def grid_key(row: Column | str, column: Column | str, width: int = 100_000) -> Column:
    return col(row) * width + col(column)


def in_split(key: Column | str, parts: Sequence[int], n: int = 10) -> Column:
    return F.pmod(col(key), F.lit(n)).isin(list(parts))


def period_name(day: Column | str, first: Column | str, cycle: int) -> Column:
    return F.concat(F.lit("t"), F.floor(F.datediff(col(day), col(first)) / cycle).cast("string"))


def in_season(day: Column | str, first: int = 5, last: int = 10) -> Column:
    return F.month(col(day)).between(first, last)


#: Square wa to square metres and to rai.
WA_TO_SQUARE_M, WA_TO_RAI = 4.0, 0.0025


def harvest_date(plant: Column | str, month_day: Column | str) -> Column:
    """A fixed month-day on or after planting."""
    plant = col(plant)
    same = F.to_date(F.concat(F.year(plant).cast("string"), F.lit("-"), col(month_day)))
    return F.when(same < plant, F.add_months(same, 12)).otherwise(same)


def weighted_shares(weights: Column | str, shares: Column | str) -> Column:
    """Sum of weight times share over two aligned arrays."""
    return F.aggregate(F.zip_with(col(weights), col(shares), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def renamed(df: DataFrame, name_of) -> DataFrame:
    """Columns renamed by a function of the name."""
    return df.toDF(*[name_of(c) for c in df.columns])


def cast_all(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


#: Fixed value: square metres in a rai.
SQUARE_M_PER_RAI = 1600.0


def is_or_null(c: Column | str, value) -> Column:
    """Equal to a value, or null."""
    return (col(c) == value) | col(c).isNull()


def probability_bins(p: Column | str, low: float, high: float) -> Column:
    """0 where the probability is 0 (not rice), else 1 below ``low``, 2 up to ``high``, 3 above it."""
    p = col(p)
    return F.when(p == 0, 0).when(p < low, 1).when(p <= high, 2).when(p > high, 3)


def adjacent_differences(columns: Sequence[str]) -> list[Column]:
    """Each column less the next, named a-b."""
    return [(F.col(a) - F.col(b)).alias(f"{a}-{b}") for a, b in zip(columns, columns[1:])]


def agreements(flags: Sequence[str], name: str) -> list[Column]:
    """If all flags are set, and for each two if they are equal, named by both."""
    every = F.lit(True)
    for f in flags:
        every = every & F.col(f)
    return [every.alias(name), *[(F.col(a) == F.col(b)).alias(a + b) for i, a in enumerate(flags) for b in flags[i + 1 :]]]


def with_fragment(df: DataFrame, fragments: Sequence[str]) -> DataFrame:
    """Only columns whose name holds one of the fragments: a choice on the schema, not on rows."""
    return df.select(*[c for c in df.columns if any(f in c for f in fragments)])
