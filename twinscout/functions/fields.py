"""Paths, URL lists, prices and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscout.functions.text import SPACE, sku_key, strip

# Label texts and the thumbnail count shown on a card.
NO_PRICE = "N/A"
CURRENCY = "AED"
THUMBNAILS = 6

_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"


def _pieces(col: Column, separator: str) -> Column:
    """Split, trim every piece and drop the blank ones, keeping the order."""
    return F.array_remove(F.split(strip(col), rf"(?U)[{SPACE}]*{separator}[{SPACE}]*"), "")


def query_image_list(col: Column) -> Column:
    """Image paths of one query; the first one is the primary image."""
    return _pieces(col, ";")


def image_url_list(col: Column) -> Column:
    """URLs separated by ``;`` if there is one, else by ``,``; empty when missing."""
    parts = F.when(F.contains(col, F.lit(";")), _pieces(col, ";")).otherwise(_pieces(col, ","))
    return F.coalesce(parts, F.array().cast("array<string>"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def file_stem(path: Column) -> Column:
    """File name without its last extension; leading dots are not an extension."""
    return F.regexp_replace(file_name(path), r"(?s)^(.*[^.].*)\.[^.]*$", "$1")


def image_key(path: Column) -> Column:
    """The score key of a cached image: its stem, trimmed and upper-cased."""
    return sku_key(file_stem(path))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Render a cell as text; whole floating numbers lose their ``.0``, none gets an exponent
    between 1e-3 and 1e38."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        plain = col.cast("string")
        whole = (F.abs(col) < F.lit(1e38)) & (col == F.rint(col))
        long_fraction = F.regexp_replace(plain.try_cast("decimal(38,18)").cast("string"), "0+$", "")
        return (
            F.when(whole, plain.try_cast("decimal(38,0)").cast("string"))
            .when((F.abs(col) >= F.lit(1e7)) & (F.abs(col) < F.lit(1e17)), long_fraction)
            .otherwise(plain)
        )
    return col.cast("string")


def parse_price(col: Column, dtype: T.DataType) -> Column:
    """A price as DOUBLE; anything that is not a number, and NaN, becomes null."""
    if isinstance(dtype, T.NumericType):
        number = col.cast("double")
    else:
        text = strip(col.cast("string"))
        number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def shown_price(price: Column) -> Column:
    """The rounded price a card displays; null where the card shows no price."""
    rounded = F.call_function("format_number", price, F.lit("0")).cast("double")
    return F.when(price != 0, rounded)


def price_label(price: Column) -> Column:
    """``AED n`` rounded half to even, ``N/A`` for a missing or zero price."""
    rounded = F.call_function("format_number", price, F.lit("0"))
    return F.when(price != 0, F.concat(F.lit(CURRENCY + " "), rounded)).otherwise(F.lit(NO_PRICE))


def match_count_label(col: Column, dtype: T.DataType) -> Column:
    """``n SKU`` from the part before the decimal point; 1 when missing or blank."""
    digits = F.regexp_extract(as_text(col, dtype), r"^[^.]*", 0)
    known = F.when(digits != "", digits)
    return F.concat(F.coalesce(known, F.lit("1")), F.lit(" SKU"))
