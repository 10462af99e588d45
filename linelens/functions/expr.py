"""Column expressions shared by the operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def q(name: str) -> Column:
    """Column by its exact name, whatever blanks or dots it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def finite(c: Column) -> Column:
    """NaN and the infinities become null: one kind of missing value."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def present(c: Column) -> Column:
    """NaN becomes null, infinities stay."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_number(c: Column) -> Column:
    """Text to number, null where it is not one; NaN and the infinities count as missing."""
    return finite(c.try_cast("double"))


def count_below(c: Column, edges: list, over: bool = False) -> Column:
    """How many of the sorted ``edges`` lie below ``c`` (``over``: below it or equal), by halving: a few comparisons a value, whatever the number of edges."""

    def step(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(c >= edges[m] if over else c > edges[m], step(m + 1, b)).otherwise(step(a, m))

    return step(0, len(edges))


def at_most(c: Column, top: float) -> Column:
    """Clipped from above; null stays null (least() would skip it)."""
    return F.when(c > top, F.lit(float(top))).otherwise(c)


def at_least(c: Column, bottom: float) -> Column:
    return F.when(c < bottom, F.lit(float(bottom))).otherwise(c)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with minus zero folded into zero."""
    return F.round(c, digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        rounded(q(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else q(f.name)
        for f in df.schema
    ])


def known_count(cols: list[Column]) -> Column:
    return reduce(add, [c.isNotNull().cast("int") for c in cols])


def row_sum(cols: list[Column]) -> Column:
    """Sum over columns, null only where every one is null."""
    return F.when(reduce(or_, [c.isNotNull() for c in cols]), reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols]))


def row_mean(cols: list[Column]) -> Column:
    return F.try_divide(row_sum(cols), known_count(cols))


def row_spread(cols: list[Column]) -> Column:
    return F.greatest(*cols) - F.least(*cols) if len(cols) > 1 else cols[0] - cols[0]


def weighted_score(components: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(score 0..100 or null, number of available components); missing parts leave the denominator."""
    parts = [(components[name], weights[name]) for name in weights]
    available = known_count([c for c, _ in parts])
    top = reduce(add, [F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in parts])
    bottom = reduce(add, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts])
    return F.when(available >= 2, rounded(100.0 * top / bottom, 3)), available


def short_id(*cols: Column | str) -> Column:
    """12 hex digits of the sha-256 over the parts joined with '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 12)


def two_sided_p(z: Column) -> Column:
    """Normal two-sided p by a rational erfc approximation (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


# --- vectors held as array<double>

def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp((x - top) / t))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def stack_rows(wide: DataFrame, rows: list[dict[str, Column]], keep: list[str] | None = None) -> DataFrame:
    """Turn a wide row into one row per entry of ``rows`` (an inline array of structs)."""
    structs = F.array(*[F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows])
    return wide.select(*(keep or []), F.explode(structs).alias("_s")).select(*(keep or []), "_s.*")


def beside(*single_rows: DataFrame) -> DataFrame:
    """One-row tables next to each other, as one row (a union and a maximum, no cross join)."""
    names = [c for df in single_rows for c in df.columns]
    rows = single_rows[0]
    for df in single_rows[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    return rows.agg(*[F.max(q(c)).alias(c) for c in names])


# --- the same as SQL text: one call builds a wide select list, however many columns it has

def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def finite_sql(name: str) -> str:
    d = f"CAST({quoted(name)} AS DOUBLE)"
    return f"(CASE WHEN abs({d}) < DOUBLE('Infinity') THEN {d} END)"


def present_sql(name: str) -> str:
    return f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def corr_sql(x: str, y: str) -> str:
    """Pearson r over the pairs, null without spread (corr() itself fails there in ANSI mode)."""
    px, py = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"try_divide(covar_pop({px}, {py}), stddev_pop({px}) * stddev_pop({py}))"


def stack_sql(wide: DataFrame, rows: list[dict[str, str]]) -> DataFrame:
    """stack_rows for SQL text: values are expressions over the wide row."""
    entries = ", ".join("named_struct(" + ", ".join(f"'{k}', {e}" for k, e in row.items()) + ")" for row in rows)
    return wide.selectExpr(f"inline(array({entries}))")


def text(value) -> Column:
    return F.lit(value).cast("string")


def to_long(df: DataFrame, columns: list[str], keep: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long over numeric columns; only the named columns are read."""
    casted = df.select(*keep, *[finite(q(c)).alias(c) for c in columns])
    return casted.unpivot(keep, [q(c) for c in columns], name, value).where(F.col(value).isNotNull())
