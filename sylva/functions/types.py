"""Lexical types: declared conversion and conservative inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK = {"character": T.StringType(), "integer": T.IntegerType(), "double": T.DoubleType(), "logical": T.BooleanType(), "date": T.DateType()}

# The lexical forms of the types.
INTEGER = r"^[+-]?[0-9]+$"
DOUBLE = r"^[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?)|(?:\.[0-9]+))(?:[eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
LEADING_ZERO = r"^[+-]?0[0-9]"
SPACES = " \t\r\n"


def lexical(value: Column) -> Column:
    return F.trim(value, F.lit(SPACES))


def converted(value: Column, kind: str) -> Column:
    """value as a declared type; null where it isn't of that type (or null)."""
    x = lexical(value)
    if kind == "character":
        return value
    if kind == "integer":  # the least 32-bit number stands for a missing value in the data model
        n = F.when(x.rlike(INTEGER), F.regexp_replace(x, r"^\+", "").try_cast("decimal(38,0)"))
        return F.when(n.between(-2147483647, 2147483647), n.cast("int"))
    if kind == "double":
        return F.when(x.rlike(DOUBLE), F.regexp_replace(x, r"\.(?=[eE]|$)", ".0").try_cast("double"))
    if kind == "logical":
        return F.when(F.lower(x).isin("true", "1"), F.lit(True)).when(F.lower(x).isin("false", "0"), F.lit(False))
    if kind == "date":
        return F.when(x.rlike(DATE), x.try_cast("date"))
    raise ValueError(f"unknown type '{kind}'")


def misfit(value: Column, kind: str) -> Column:
    """Whether a value that isn't null can't be converted."""
    return value.isNotNull() & converted(value, kind).isNull()


def strict(value: Column, kind: str, source: str, name: str) -> Column:
    """As converted, but the query fails at a value that doesn't fit."""
    if kind == "character":
        return value
    message = F.concat(F.lit(f"Source '{source}' (output '{name}') has a value that is not {kind}: "), value)
    return F.when(misfit(value, kind), F.raise_error(message).cast(SPARK[kind])).otherwise(converted(value, kind))


#: What inference needs to know of the values of a column, as one aggregate each.
def observations(value: Column) -> dict[str, Column]:
    x = lexical(value)
    low = F.lower(x)
    some = value.isNotNull()

    def every(condition: Column) -> Column:
        return F.coalesce(F.min(F.when(some, condition)), F.lit(False))

    integer, double = converted(x, "integer"), converted(x, "double")
    finite = double.isNotNull() & (F.abs(double) < F.lit(float("inf")))
    return {
        "n": F.count(value),
        "blank": F.coalesce(F.max(F.when(some, x == "")), F.lit(False)),
        "dates": every(converted(x, "date").isNotNull()),
        "booleans": every(low.isin("true", "false", "1", "0")),
        "words": F.coalesce(F.max(F.when(some, low.isin("true", "false"))), F.lit(False)),
        "integer_shape": every(x.rlike(INTEGER)),
        "integers": every(F.coalesce(integer.isNotNull(), F.lit(False))),
        "numbers": every(F.coalesce(finite, F.lit(False))),
        "leading": F.coalesce(F.max(F.when(some, x.rlike(LEADING_ZERO))), F.lit(False)),
        "several": F.min(x) != F.max(x),
        "several_words": F.min(low) != F.max(low),
    }


def inferred(seen: dict) -> tuple[str, str, str]:
    """(type, confidence, reason) from the observations of a column; the first rule that holds."""
    sure = "high" if seen["several"] else "medium"
    if not seen["n"]:
        return "character", "none", "there are no values to judge by"
    if seen["blank"]:
        return "character", "high", "some values are blank, which only text can keep"
    if seen["dates"]:
        return "date", sure, "all values are calendar dates written year-month-day"
    if seen["booleans"] and seen["words"]:
        return "logical", "high" if seen["several_words"] else "medium", "all values are flags, some spelled out as true or false"
    if seen["booleans"]:
        return "character", "medium", "all values are 0 or 1, which may be flags, numbers or codes"
    zeroes = ("character", "high", "some numbers begin with a zero that a numeric type would lose")
    if seen["integer_shape"]:
        if seen["leading"]:
            return zeroes
        if seen["integers"]:
            return "integer", sure, "all values are whole numbers, none with a zero in front"
    if seen["numbers"]:
        if seen["leading"]:
            return zeroes
        return "double", sure, "all values are finite numbers, and not all of them whole"
    return "character", "high", "no other type has room for all values"
