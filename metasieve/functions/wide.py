"""Numbers of any size as strings that sort like the numbers.

A key is a sign mark, a biased exponent and the digits without zeros at their
ends; for negative numbers exponent and digits are complemented and a mark above
all digits ends the key. Equal numbers have equal keys: 1 and 1.0, 0 and -0.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIAS = 500_000
_DIGITS, _COMPLEMENT = "0123456789", "9876543210"


def wide_key(text: Column) -> Column:
    """The key of a decimal number's text (also with an exponent); null for null."""
    low = F.lower(F.trim(text))
    negative = low.startswith("-")
    bare = F.regexp_replace(low, r"^[+-]", "")
    power = F.coalesce(F.try_to_number(F.regexp_extract(bare, r"e\+?(-?[0-9]+)$", 1), F.lit("S999999")).cast("int"), F.lit(0))
    mantissa = F.regexp_extract(bare, r"^([0-9.]*)", 1)
    whole = F.regexp_replace(F.substring_index(mantissa, ".", 1), r"^0+", "")
    part = F.when(F.instr(mantissa, ".") > 0, F.regexp_replace(F.substring_index(mantissa, ".", -1), r"0+$", "")).otherwise("")
    lead = F.length(F.regexp_extract(part, r"^0*", 0))
    digits = F.when(whole != "", F.concat(whole, part)).otherwise(F.regexp_replace(part, r"^0+", ""))
    digits = F.regexp_replace(digits, r"0+$", "")
    exponent = F.when(whole != "", F.length(whole)).otherwise(-lead) + power
    above = F.concat(F.lit("2"), F.lpad((exponent + _BIAS).cast("string"), 6, "0"), digits)
    below = F.concat(F.lit("0"), F.lpad((F.lit(999_999) - (exponent + _BIAS)).cast("string"), 6, "0"), F.translate(digits, _DIGITS, _COMPLEMENT), F.lit("~"))
    return F.when(digits == "", "1").when(negative, below).otherwise(above)


def literal_key(x: Fraction) -> str | None:
    """The key of an exact number; None if its decimals do not end."""
    if x == 0:
        return "1"
    scale, d = 0, x.denominator
    while d % 10 == 0:
        d, scale = d // 10, scale + 1
    while d % 2 == 0 or d % 5 == 0:
        d, scale = d // (2 if d % 2 == 0 else 5), scale + 1
    if d != 1:
        return None
    text = str(abs(x.numerator) * 10**scale // x.denominator)
    exponent = len(text) - scale
    digits = text.rstrip("0")
    if x > 0:
        return f"2{exponent + _BIAS:06d}{digits}"
    return f"0{999_999 - (exponent + _BIAS):06d}{digits.translate(str.maketrans(_DIGITS, _COMPLEMENT))}~"
