"""Columns over linker symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of symbols that take room in the binary.
SIZED_CODES = ("T", "t", "D", "d", "R", "r")


def package_of_symbol(symbol: Column) -> Column:
    """Behind the last slash, the text up to the first dot; without a dot: empty."""
    return F.regexp_extract(F.trim(symbol), r"^((?:.*/)?[^/.]*)\.[^/]*$", 1)


def package_of_type(symbol: Column) -> Column:
    return package_of_symbol(F.regexp_replace(symbol, r"^type:\**", ""))


def is_linker_data(symbol: Column) -> Column:
    return symbol.startswith("go:") | F.contains(symbol, F.lit("..stmp_")) | symbol.rlike(r"\.(stkobj|opendefer|argliveinfo|arginfo0|arginfo1)$")


def takes_room(code: Column) -> Column:
    return code.isin(*SIZED_CODES)
