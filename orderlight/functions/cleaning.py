"""Text -> typed value expressions. Nothing here raises on bad input; it yields NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.contract import CUSTOMER_ID_CANDIDATES, NULL_WORDS, ORDER_ID_CANDIDATES

BLANKS = " \t\n\r\x0b\x0c"

# Java accepts a type suffix ("1.5d") and hexadecimal floats; text numbers do not have them.
_JAVA_ONLY_NUMBER = r"(?i)[0-9.][df]\s*$|0x"

# Accepted date layouts beyond ISO, tried in this order.
DATE_LAYOUTS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss"]


def quoted(name: str) -> Column:
    """Column by its literal name, also when it holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.trim(c.cast("string"), F.lit(BLANKS))


def clean_id(c: Column) -> Column:
    text = strip(c)
    return F.when(~text.isin(NULL_WORDS), text)


def normalize_ids(df: DataFrame) -> DataFrame:
    known = [c for c in dict.fromkeys(ORDER_ID_CANDIDATES + CUSTOMER_ID_CANDIDATES) if c in df.columns]
    return df.withColumns({c: clean_id(quoted(c)) for c in known})


def to_number(df: DataFrame, name: str) -> Column:
    """DOUBLE or NULL; NaN counts as missing, infinities stay."""
    c = quoted(name)
    if dict(df.dtypes)[name] == "string":
        c = F.when(~c.rlike(_JAVA_ONLY_NUMBER), F.trim(c, F.lit(BLANKS))).try_cast("double")
    else:
        c = c.cast("double")
    return F.when(~F.isnan(c), c)


def to_time(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if dict(df.dtypes)[name] != "string":
        return c.cast("timestamp")
    text = F.trim(c, F.lit(BLANKS))
    return F.coalesce(
        F.try_to_timestamp(text),
        *[F.try_to_timestamp(text, F.lit(layout)) for layout in DATE_LAYOUTS],
    )


def clean_status(c: Column) -> Column:
    return F.lower(strip(c))


def first_existing(columns: list[str], candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)
