"""Text forms of numbers and names for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_number(value: Column) -> Column:
    """Number of a text; anything that is not a finite number becomes NULL."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def _with(expression: Column, use) -> Column:
    """Evaluate an expression once and use it several times."""
    return F.transform(F.array(expression), use)[0]


def decimals(value: Column, digits: int) -> Column:
    """Fixed digits of the exact binary value, ties to even (the formatter works on
    the shortest decimal instead and turns 4508.15 into 4508.2).

    A double is an integer times a power of two, so integer division decides.
    """
    ten = 10 ** digits

    def text_of(part: Column) -> Column:
        whole, twice, unit = part["whole"], 2 * part["rest"], part["unit"]
        units = whole + ((twice > unit) | ((twice == unit) & (whole % 2 == 1))).cast("int")
        return _with(units, lambda u: F.concat(
            F.when(part["negative"] & (u > 0), "-").otherwise(""), F.call_function("div", u, F.lit(ten)).cast("string"),
            F.concat(F.lit("."), F.lpad((u % ten).cast("string"), digits, "0")) if digits else F.lit("")))

    def divide(part: Column) -> Column:
        whole = F.call_function("div", part["scaled"], part["unit"])
        return _with(F.struct(whole.alias("whole"), (part["scaled"] - whole.cast("decimal(20,0)") * part["unit"]).alias("rest"),
                              part["unit"].alias("unit"), part["negative"].alias("negative")), text_of)

    def scale(part: Column) -> Column:
        whole = (part["size"] * F.pow(F.lit(2.0), part["power"])).cast("bigint").cast("decimal(20,0)")
        unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), part["power"]).cast("decimal(20,0)")
        return _with(F.struct((whole * F.lit(ten).cast("decimal(10,0)")).alias("scaled"), unit.alias("unit"),
                              part["negative"].alias("negative")), divide)

    def start(v: Column) -> Column:
        size = F.abs(v)
        power = F.greatest(52 - F.floor(F.log2(size)), F.lit(0)).cast("int")
        exact = _with(F.struct(size.alias("size"), power.alias("power"), (v < 0).alias("negative")), scale)
        return F.when((size >= 2.0 ** -10) & (size < 2.0 ** 40), exact).otherwise(F.format_string(f"%.{digits}f", v))

    return _with(value, start)


def fixed(value: Column, digits: int = 3, missing: str = "NA") -> Column:
    return F.coalesce(F.when(value.isNotNull(), decimals(value, digits)), F.lit(missing))


def p_text(value: Column, digits: int = 3, trim: bool = False, missing: str = "NA") -> Column:
    """Two-digit exponent form below 0.001, else fixed digits; ``trim`` drops end zeros."""
    plain = decimals(value, digits)
    if trim:
        plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(value < 0.001, F.format_string("%.2e", value)).when(value.isNotNull(), plain), F.lit(missing))


def percent_text(value: Column, digits: int = 1, missing: str = "NA") -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.concat(decimals(100 * value, digits), F.lit("%"))), F.lit(missing))


def interval_text(value: Column, low: Column, high: Column, digits: int = 3) -> Column:
    return F.concat(fixed(value, digits), F.lit(" ("), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit(")"))


def median_iqr_text(q1: Column, median: Column, q3: Column) -> Column:
    text = F.concat(decimals(median, 1), F.lit(" ("), decimals(q1, 1), F.lit("-"), decimals(q3, 1), F.lit(")"))
    return F.when(median.isNull(), "NA").otherwise(text)


def share_text(part: Column, whole: Column) -> Column:
    return F.format_string("%d/%d", part, whole)


def yes_no(value: Column) -> Column:
    """Text or flag to yes/no: true, yes and a genus match count as yes."""
    return F.when(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "genus_match"), "yes").otherwise("no")


def spaced(value: Column) -> Column:
    return F.translate(value, "_", " ")


def hyphenated(value: Column) -> Column:
    return F.translate(value, "_", "-")


def dashed_ranges(value: Column) -> Column:
    """A hyphen between two digits becomes an en dash."""
    return F.regexp_replace(value, r"(?<=\d)-(?=\d)", "–")


def shortened(value: Column, width: int, mark: str = "...") -> Column:
    """Cut at a word boundary so that the text with ``mark`` fits the width."""
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    words = F.split(flat, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    fitting = F.filter(prefixes, lambda p: F.length(p) + len(mark) <= width)
    return F.when(F.length(flat) <= width, flat).otherwise(
        F.concat(F.coalesce(F.try_element_at(fitting, F.lit(-1)), F.lit("")), F.lit(mark)))


def interval_numbers(text: Column) -> list[Column]:
    """The three numbers of ``a (b, c)``; NULL where the text has another form."""
    pattern = r"([0-9.]+) \(([0-9.]+), ([0-9.]+)\)"
    return [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double") for i in (1, 2, 3)]


def multiplier_of(rule: Column) -> Column:
    return F.nullif(F.regexp_extract(rule, r"x_([0-9.]+)", 1), F.lit("")).try_cast("double")
