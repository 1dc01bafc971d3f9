"""Numbers as untyped option bags give them: coercion, rounding and clamping.

Built without lambdas: Spark compiles no expression that has one in it, nor what is around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: White space that trimming removes, spelled out because \s is ASCII only.
BLANK = r"[\x09-\x0D\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim_all(text: Column) -> Column:
    """text without white space, also Unicode's, at either end."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def half_up(x: Column) -> Column:
    """The nearest integer; halves go up, also for negative numbers."""
    return F.floor(x.cast("double") + 0.5)


def as_number(value: Column) -> Column:
    """A string as a double: blank is 0, decimals and exponents count, anything else is null."""
    text = value.cast("string")
    number = F.regexp_extract(text, rf"^{BLANK}*({NUMBER}){BLANK}*\z", 1).try_cast("double")
    return F.coalesce(number, F.when(text.rlike(rf"^{BLANK}*\z"), 0.0))


def clamp_int(value: Column, low: int, high: int, default: int) -> Column:
    """The value rounded and limited to [low, high]; default if it is no number. A null counts as 0."""
    limited = lambda n: F.least(F.lit(high), F.greatest(F.lit(low), half_up(n)))
    number = as_number(F.coalesce(value.cast("string"), F.lit("0")))
    if low <= default <= high:
        return limited(F.coalesce(number, F.lit(float(default)))).cast("int")
    return F.when(number.isNull(), default).otherwise(limited(number)).cast("int")


def read_int(value: Column, default: int, low: int, high: int) -> Column:
    """Like clamp_int(), for options that may be missing: a null is the default."""
    return F.when(value.isNull(), default).otherwise(clamp_int(value, low, high, default))


def clamp_quality(value: Column) -> Column:
    return clamp_int(value, 10, 100, 92)


def read_enum(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def read_bool(value: Column) -> Column:
    return F.coalesce(value.cast("string") == "true", F.lit(False))


def non_negative(value: Column, default: float = 0.0) -> Column:
    number = as_number(value)
    return F.when(number >= 0, number).otherwise(default)


def plain(x: Column, digits: int) -> Column:
    """A number with at most so many decimals and no trailing zeros, as a string."""
    fixed = F.nullif(F.format_string(f"%.{digits}f", x.cast("double")), F.lit("null"))
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")) if digits else fixed


def volume_factor(percent: Column) -> Column:
    return plain(percent / 100, 4)


def snap_half(value: Column, default: float = 2.0) -> Column:
    """A scale in steps of one half; 1.5 to 4, else default."""
    snapped = F.floor(value.cast("double") * 2 + 0.5) / 2
    return let(snapped, lambda x: F.when(x.between(1.5, 4.0), x).otherwise(default))


def quarter_turns(degrees: Column) -> Column:
    """Degrees to the nearest quarter turn in [0, 360)."""
    return F.pmod(half_up(degrees / 90) * 90, F.lit(360)).cast("int")


def timecode_seconds(text: Column) -> Column:
    """Seconds of S, S.f, M:S or H:M:S; null if it is none of them or a smaller unit reaches 60."""
    part = lambda pattern, i: F.regexp_extract(text, rf"^{BLANK}*{pattern}{BLANK}*\z", i).try_cast("double")
    hours, minutes, seconds = (part(r"(?:(\d+):)?0*([0-5]?\d):0*([0-5]?\d(?:\.\d+)?)", i) for i in (1, 2, 3))
    below = F.nullif(seconds, F.lit(60.0))  # 59 and many nines
    return F.coalesce(part(r"(\d+(?:\.\d+)?)", 1), F.coalesce(hours, F.lit(0.0)) * 3600 + minutes * 60 + below)
