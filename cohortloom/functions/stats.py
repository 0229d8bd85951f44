"""Tail probabilities and small exact tests as SQL / Column expressions.

Spark has no ``erf``; the normal tail uses the three-range rational
approximation of W. J. Cody (Math. Comp. 1969), accurate to double precision.
The ``*_sql`` helpers return plain SQL text that Spark and DuckDB both accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational coefficients for the normal distribution.
_CENTRE_NUM = (0.065682337918207449113, 2.2352520354606839287, 161.02823106855587881,
               1067.6894854603709582, 18154.981253343561249)
_CENTRE_DEN = (1.0, 47.20258190468824187, 976.09855173777669322, 10260.932208618978205,
               45507.789335026729956)
_MIDDLE_NUM = (1.0765576773720192317e-8, 0.39894151208813466764, 8.8831497943883759412,
               93.506656132177855979, 597.27027639480026226, 2494.5375852903726711,
               6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218)
_MIDDLE_DEN = (1.0, 22.266688044328115691, 235.38790178262499861, 1519.377599407554805,
               6485.558298266760755, 18615.571640885098091, 34900.952721145977266,
               38912.003286093271411, 19685.429676859990727)
_FAR_NUM = (0.02307344176494017303, 0.21589853405795699, 0.1274011611602473639,
            0.022235277870649807, 0.001421619193227893466, 2.9112874951168792e-5)
_FAR_DEN = (1.0, 1.28426009614491121, 0.468238212480865118, 0.0659881378689285515,
            0.00378239633202758244, 7.29751555083966205e-5)
_INV_SQRT_2PI = 0.3989422804014326779


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]:.20e}"
    for value in coefficients[1:]:
        text = f"(({text})*{x}+{value:.20e})"
    return text


def normal_two_sided_sql(z: str) -> str:
    """Two-sided standard-normal p value of column ``z`` (NULL stays NULL)."""
    a = f"abs(CAST({z} AS DOUBLE))"
    sq = f"({a}*{a})"
    inv = f"(1e0/{sq})"
    centre = f"(1e0-2e0*{a}*({_horner(_CENTRE_NUM, sq)})/({_horner(_CENTRE_DEN, sq)}))"
    middle = f"(2e0*exp(-{sq}/2e0)*({_horner(_MIDDLE_NUM, a)})/({_horner(_MIDDLE_DEN, a)}))"
    far = (f"(2e0*exp(-{sq}/2e0)/{a}*({_INV_SQRT_2PI!r}e0-{inv}*({_horner(_FAR_NUM, inv)})"
           f"/({_horner(_FAR_DEN, inv)})))")
    return (f"(CASE WHEN {z} IS NULL THEN NULL WHEN {a}<=0.67448975e0 THEN {centre} "
            f"WHEN {a}<=5.656854249492380195e0 THEN {middle} ELSE {far} END)")


def normal_two_sided(z: str) -> Column:
    return F.expr(normal_two_sided_sql(z))


def chi2_upper_tail(statistic: str, df: str) -> Column:
    """Upper tail of chi-square with integer degrees of freedom, as a finite series."""
    q, k = F.col(statistic), F.col(df).cast("int")
    half = q / 2

    def series(first: Column, count: Column, step) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            F.struct(first.cast("double").alias("term"), first.cast("double").alias("total")),
            lambda acc, i: F.when(i >= count, acc).otherwise(
                F.struct((acc["term"] * step(i)).alias("term"),
                         (acc["total"] + acc["term"] * step(i)).alias("total"))),
            lambda acc: acc["total"])

    even = F.exp(-half) * series(F.lit(1.0), (k / 2).cast("int"), lambda i: half / i)
    terms = ((k - 1) / 2).cast("int")
    odd_series = F.when(terms < 1, F.lit(0.0)).otherwise(
        series(F.lit(1.0), terms, lambda i: q / (2 * i + 1)))
    root = f"sqrt({statistic})"
    odd = normal_two_sided(root) + F.exp(-half) * F.sqrt(2 * q / F.lit(3.141592653589793)) * odd_series
    tail = F.when(q <= 0, F.lit(1.0)).when(k % 2 == 0, even).otherwise(odd)
    return F.when(q.isNotNull() & (k >= 1), F.least(tail, F.lit(1.0)))


def signed_rank_exact(rank_sum: str, n: str) -> Column:
    """Exact two-sided signed-rank p value for untied, non-zero differences.

    The number of sign patterns per rank sum is built by adding one rank at a
    time to an array of counts (``n`` is the number of folds, at most 50).
    """
    size = F.col(n).cast("int")
    top = (size * (size + 1) / 2).cast("int")
    r = F.round(F.col(rank_sum)).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(
        F.sequence(F.lit(1), size), start,
        lambda acc, i: F.transform(
            acc, lambda c, s: c + F.when(s >= i, F.element_at(acc, F.greatest(s - i, F.lit(0)) + 1)).otherwise(0.0)))
    total = F.pow(F.lit(2.0), size)
    lower = F.aggregate(F.slice(counts, F.lit(1), r + 1), F.lit(0.0), lambda a, c: a + c)
    upper = F.aggregate(F.slice(counts, r + 1, top - r + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * F.least(lower, upper) / total)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def clip_unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def direction(value: Column, zero_label: str | None = "zero",
              up: str = "CRC_higher", down: str = "control_higher") -> Column:
    """Sign as a label; ``zero_label`` says what an exact zero is called."""
    return F.when(value > 0, up).when(value < 0, down).when(value == 0, F.lit(zero_label))


def sign(value: Column) -> Column:
    return F.signum(value).cast("int")


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded output without negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def log_p(p: Column, digits: int = 4) -> Column:
    """log10 of a p or q value, rounded; the scale on which p values are compared."""
    return rounded(F.log10(F.greatest(p, F.lit(1e-300))), digits)
