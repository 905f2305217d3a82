"""Small building blocks shared by the column rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times.

    A lambda variable is computed once per row, whereas a repeated Column is a repeated
    sub-expression; inside ``when`` branches Spark would evaluate a regex again for each use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(fv.WHITESPACE))


def nonblank(c: Column | str) -> Column:
    """The value, or null when it is null or empty."""
    return F.when(col(c) != "", col(c))


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (col(c) == "")


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a fixed table, null when absent."""
    return F.try_element_at(fixed_map(table), key)


def fixed_map(table: Mapping[str, object]) -> Column:
    """A fixed table as one constant map. Read from one JSON literal, which folds when planning."""
    kind = "string" if all(isinstance(v, str) for v in table.values()) else "double"
    return F.from_json(F.lit(json.dumps(dict(table), ensure_ascii=False)), f"map<string,{kind}>")


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cased = F.transform(
        runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))
    )
    return F.array_join(cased, "")


def whole_number_text(amount: Column) -> Column:
    """A double as text, without a fraction when it has none."""
    return F.when(
        (amount == F.floor(amount)) & (F.abs(amount) < 9e18), amount.cast("bigint").cast("string")
    ).otherwise(amount.cast("string"))
