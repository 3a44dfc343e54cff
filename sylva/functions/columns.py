"""Functions made of Spark's own expressions. A tree is ``parent``: an array in which ``parent[i] < i``, and -1 for the root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of modes, and the form of keys.
BUCKET_MODES = ("leaves+minsum", "leaves", "known", "none")


def degrees(parent: Column) -> Column:
    """The degree of each vertex."""
    return F.transform(parent, lambda _, i: F.size(F.filter(parent, lambda p: p == i)) + F.when(i > 0, 1).otherwise(0))


def leaf_count(parent: Column) -> Column:
    """Vertices of degree 1; a single vertex counts as a leaf."""
    return F.when(F.size(parent) == 1, 1).otherwise(F.size(F.filter(degrees(parent), lambda d: d == 1)))


def degree_sequence(parent: Column) -> Column:
    return F.sort_array(degrees(parent), asc=False)


def sequence_text(values: Column) -> Column:
    """``3,2,1,1``."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def tuple_text(values: Column) -> Column:
    """``(3, 2, 1, 1)``."""
    return F.concat(F.lit("("), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit(")"))


def bucket_key(leaves: Column, min_sum: Column, mode: str) -> Column:
    """The structural bucket of a tree; an unknown mode is refused."""
    if mode not in BUCKET_MODES:
        raise ValueError(f"unknown bucket mode {mode!r}; there are {', '.join(BUCKET_MODES)}")
    l_part, m_part = F.concat(F.lit("l="), leaves.cast("string")), F.concat(F.lit("m="), min_sum.cast("string"))
    return {"leaves+minsum": F.concat_ws("|", l_part, m_part), "leaves": l_part, "known": m_part, "none": F.lit("all")}[mode]


def polynomial_text(coeffs: Column) -> Column:
    """Coefficients, low degree first, joined by commas."""
    return F.array_join(F.transform(coeffs, lambda x: x.cast("string")), ",")


def polynomial_parse(text: Column) -> Column:
    return F.split(text, ",").cast("array<decimal(38,0)>")


def same_polynomial(a: Column, b: Column) -> Column:
    """Whether two polynomials have the same coefficients, term by term."""
    return (F.size(a) <= F.size(b)) & (F.size(a) >= F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda t: t)


def polynomial_terms(coeffs: Column) -> Column:
    """``2q^2 + 6q^3``: the terms that aren't zero; ``0`` if there are none."""
    terms = F.filter(F.transform(coeffs, lambda x, i: F.when(x != 0, F.concat(x.cast("string"), F.lit("q^"), i.cast("string")))), lambda t: t.isNotNull())
    return F.when(F.size(terms) == 0, F.lit("0")).otherwise(F.array_join(terms, " + "))


def coefficient_sum(coeffs: Column) -> Column:
    return F.aggregate(coeffs, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))


def min_exponent(coeffs: Column) -> Column:
    """The least exponent with a coefficient; null for the zero polynomial."""
    at = F.array_position(F.transform(coeffs, lambda x: x != 0), True)
    return F.when(at > 0, (at - 1).cast("int"))


def add_polynomials(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    return F.zip_with(a, b, lambda x, y: (F.coalesce(x, zero) + F.coalesce(y, zero)).cast("decimal(38,0)"))


def multiply_polynomials(a: Column, b: Column) -> Column:
    """The product by convolution; for short polynomials."""
    zero = F.lit(0).cast("decimal(38,0)")

    def term(k: Column) -> Column:
        low, high = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
        return F.aggregate(F.sequence(low, high), zero, lambda s, i: (s + F.get(a, i) * F.get(b, k - i)).cast("decimal(38,0)"))

    return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), term)


def trim_polynomial(coeffs: Column) -> Column:
    """Without zeros at the high end; the zero polynomial keeps one."""
    last = F.size(coeffs) - F.array_position(F.reverse(F.transform(coeffs, lambda x: x != 0)), True) + 1
    return F.when(~F.exists(coeffs, lambda x: x != 0), F.slice(coeffs, 1, 1)).otherwise(F.slice(coeffs, F.lit(1), last.cast("int")))


def decimal_mod(text: Column, p: int) -> Column:
    """A decimal text of any length modulo p (below 2^31), nine digits at a time."""
    groups = F.ceil(F.length(text) / 9).cast("int")
    padded = F.lpad(text, groups * 9, "0")
    return F.aggregate(F.sequence(F.lit(0), groups - 1), F.lit(0).cast("long"), lambda a, i: (a * 10**9 + F.substring(padded, i * 9 + 1, F.lit(9)).cast("long")) % p)


def evaluate_mod(polynomial: Column, x: int, p: int) -> Column:
    """The value at x modulo p (below 2^31) of a polynomial given as comma-joined coefficients, low degree first.

    Two different polynomials of degree d agree at a random x with a probability of d / p at most (Schwartz and Zippel).
    """
    return F.aggregate(F.reverse(F.split(polynomial, ",")), F.lit(0).cast("long"), lambda a, c: (a * x + decimal_mod(c, p)) % p)


def value_mod(coeffs: Column, x: int, p: int) -> Column:
    """``evaluate_mod`` of a polynomial given as an array of DECIMAL(38,0)."""
    return F.aggregate(F.reverse(coeffs), F.lit(0).cast("long"), lambda a, c: (a * x + (c % p).cast("long")) % p)


def variance_sums(coeffs: Column) -> tuple[Column, Column]:
    """Sum and sum of squares of the coefficients, exact; the variance compares by ``n * squares - sum^2``."""
    zero = F.lit(0).cast("decimal(38,0)")
    return coefficient_sum(coeffs), F.aggregate(coeffs, zero, lambda a, x: (a + (x * x).cast("decimal(38,0)")).cast("decimal(38,0)"))


def square_sum_text(coeffs: Column) -> Column:
    """The exact sum of squares of the coefficients as a text, whatever its digits.

    While the squared sum of the absolute values has no more than 38 digits, so have all parts; else coefficients are cut into three
    limbs of 13 digits, whose products add up in DECIMAL(38,0), and carries go up the five limbs of the result.
    """
    whole, base = "decimal(38,0)", F.lit(10**13).cast("decimal(14,0)")
    zero = F.lit(0).cast(whole)
    high = lambda x: ((x - x % base) / base).cast(whole)  # noqa: E731 exact: the rest is taken off before

    def limbs(x: Column) -> Column:
        x = F.abs(x)
        return F.array(*[y.cast("decimal(13,0)") for y in (x % base, high(x) % base, high(high(x)))])

    def place(rows: Column, k: int) -> Column:
        pairs = [(i, k - i) for i in range(3) if 0 <= k - i < 3]
        return F.aggregate(rows, zero, lambda a, x: (a + sum((x[i] * x[j] for i, j in pairs[1:]), x[pairs[0][0]] * x[pairs[0][1]])).cast(whole))

    def carried(a: Column, x: Column) -> Column:
        now = (a["carry"] + x).cast(whole)
        return F.struct(high(now).alias("carry"), F.concat(F.lpad((now % base).cast("string"), 13, "0"), a["text"]).alias("text"))

    def long_way(rows: Column) -> Column:
        start = F.struct(zero.alias("carry"), F.lit("").alias("text"))
        text = F.aggregate(F.array(*[place(rows, k) for k in range(5)]), start, carried, lambda a: F.concat(a["carry"].cast("string"), a["text"]))
        return F.regexp_replace(text, "^0+(?=.)", "")

    size = F.aggregate(coeffs, zero, lambda a, x: (a + F.abs(x)).cast(whole))
    return F.when(size < F.lit("1" + "0" * 19).cast(whole), variance_sums(coeffs)[1].cast("string")).otherwise(F.transform(F.array(F.transform(coeffs, limbs)), long_way)[0])


def mean_and_variance(coeffs: Column) -> tuple[Column, Column]:
    """Mean and variance of the coefficients as doubles, for display; equality is told by ``variance_sums``."""
    total, squares = variance_sums(coeffs)
    n = F.size(coeffs)
    top = (squares * n - total * total).cast("decimal(38,0)")
    return total.cast("double") / n, top.cast("double") / (n * n)


def duration_text(seconds: Column) -> Column:
    """``1d 02h 03m``, ``1h 02m 03s``, ``2m 03s``; ``?`` for null, NaN and infinite values; below zero counts as zero."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.when(d > 0, F.format_string("%dd %02dh %02dm", d, h, m)).when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).otherwise(F.format_string("%dm %02ds", m, r))
    return F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), F.lit("?")).otherwise(text)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)
