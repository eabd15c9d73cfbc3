"""Arguments of a command as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positional(arguments: Column) -> Column:
    """The arguments without a separator in front."""
    return F.when(F.get(arguments, 0) == "--", F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0)))).otherwise(arguments)


def positive_integer(value: Column) -> Column:
    """The whole number above zero that a text is, null for any other text."""
    number = F.try_to_number(F.trim(value), F.lit("S999999999999999D99")).cast("double")
    return F.when((number > 0) & (number == F.floor(number)), number.cast("long"))


def required(value: Column, name: str) -> Column:
    """Like positive_integer; another text is an error."""
    return F.coalesce(positive_integer(value), F.raise_error(F.lit(f"{name} must be a positive integer")).cast("long"))
