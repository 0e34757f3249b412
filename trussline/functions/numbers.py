"""Number text: parsing with an optional decimal comma, and fixed-decimal formatting."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal or exponent notation; hexadecimal, suffixes, NaN and infinities are not numbers here.
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: What counts as blank around a number: ASCII white space, line and paragraph ends, no-break and other spaces, the byte order mark.
BLANKS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trimmed(text: Column) -> Column:
    """text without blanks of any kind around it."""
    return F.regexp_replace(text, rf"\A{BLANKS}|{BLANKS}\z", "")


def plain_number(text: Column) -> Column:
    """A finite double, or null; blanks around it go and a comma is no decimal point. Blanks alone are 0."""
    t = trimmed(text.cast("string"))
    value = F.when(t == "", F.lit(0.0)).when(F.regexp_like(t, F.lit(NUMBER)), t.try_cast("double"))
    return F.when(F.abs(value) != float("inf"), value)


def to_number(text: Column) -> Column:
    """A finite double, or null. Blanks around it go; one comma stands for the decimal point if there is no dot."""
    t = trimmed(text.cast("string"))
    one_comma = (F.regexp_count(t, F.lit(",")) == 1) & ~F.contains(t, F.lit("."))
    t = F.when(one_comma, F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    value = F.when(F.regexp_like(t, F.lit(NUMBER)), t).try_cast("double")
    return F.when(F.abs(value) != float("inf"), value)


def finite(value: Column) -> Column:
    """value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _rounded(values: np.ndarray, decimals: int) -> list[str | None]:
    """Half-up on the exact binary value (Spark's own rounding works on the shortest decimal text instead); None for what is not finite.

    Scaled by a power of ten, a double of moderate size is off by less than its
    last place; only values that come that near to a half are settled one by
    one, by their exact fractions.
    """
    scale = 10.0**decimals
    sound = np.isfinite(values)
    scaled = np.abs(np.where(sound, values, 0.0)) * scale
    whole = np.floor(scaled)
    away = scaled - whole - 0.5
    up = away >= 0
    near = np.flatnonzero(sound & ((np.abs(away) <= np.spacing(scaled) * 2) | (scaled >= 2.0**52) | (scaled - whole <= 0)))
    units = np.where(scaled < 2.0**62, whole + up, 0).astype(np.int64)
    texts = [None if not s else _text(n, u, decimals) for s, n, u in zip(sound.tolist(), np.signbit(values).tolist(), units.tolist(), strict=True)]
    for i in near.tolist():
        n = values[i]
        texts[i] = _text(bool(np.signbit(n)), int(abs(Fraction(float(n))) * 10**decimals + Fraction(1, 2)), decimals)
    return texts


def _text(negative: bool, units: int, decimals: int) -> str:
    digits = str(units).rjust(decimals + 1, "0")
    text = (digits[:-decimals] + "." + digits[-decimals:]).rstrip("0").rstrip(".") if decimals else digits
    return "-" + text if negative else text


def fixed_text(value: Column, decimals: int = 3) -> Column:
    """value with at most so many decimals and no trailing zeros; null if it is not finite."""

    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return pd.Series(_rounded(x.to_numpy(float), decimals), x.index, object)

    return convert(value.cast("double"))


def csv_number(value: Column, decimal: str = ".") -> Column:
    """Up to three decimals, '' if it is not finite."""
    text = F.coalesce(fixed_text(value, 3), F.lit(""))
    return F.replace(text, F.lit("."), F.lit(decimal)) if decimal != "." else text


def format_number(value: Column, decimals: int = 2, locale: str = "it") -> Column:
    """For display: thousands in groups, the locale's separators, no trailing zeros; '' if it is not finite."""
    group, point = (".", ",") if locale == "it" else (",", ".")
    text = fixed_text(value, decimals)
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=[0-9])(?=(?:[0-9]{3})+\z)", group)
    part = F.when(F.contains(text, F.lit(".")), F.concat(F.lit(point), F.substring_index(text, ".", -1))).otherwise("")
    return F.coalesce(F.concat(whole, part), F.lit(""))


def csv_field(text: Column, sep: str = ";") -> Column:
    """Quoted only where a separator, quote or line break asks for it."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    special = F.contains(t, F.lit(sep)) | F.contains(t, F.lit('"')) | F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\n"))
    return F.when(special, F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def natural_key(text: Column) -> Column:
    """A sort key under which A2 < A10 and case and accents don't count: digit runs of any length go by value, their length before them."""
    digits = lambda p: F.regexp_replace(p, r"\A0+(?=[0-9])", "")
    padded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), lambda p: F.when(F.regexp_like(p, F.lit(r"\A[0-9]+\z")), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "")
    return F.collate(padded, "UNICODE_CI_AI")
