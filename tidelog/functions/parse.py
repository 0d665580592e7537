"""Parsing of raw journal strings, JVM-side. Each parser gives a struct of the value and the flag of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python's str.strip takes off.
_BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def parse_alarm(text: Column) -> Column:
    """(value, flag): true/t/1 and false/f/0 in any case; anything else is invalid_alarm."""
    t = F.lower(strip(text))
    value = F.when(t.isin("true", "t", "1"), True).when(t.isin("false", "f", "0"), False)
    return F.struct(value.alias("value"), F.when(value.isNull(), "invalid_alarm").alias("flag"))


def parse_local_timestamp(date: Column, time: Column) -> Column:
    """(value, flag): ISO date and time; an offset is timezone_present, anything else wrong invalid_timestamp."""
    text = F.concat_ws(" ", strip(date), strip(time))
    shape = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?"
    plain = text.rlike(shape + "$")
    zoned = text.rlike(shape + r"(Z|[+-]\d{2}(:?\d{2})?(:?\d{2})?)$")
    bare = F.regexp_replace(F.regexp_extract(text, shape, 0), ",", ".")
    value = F.when(plain | zoned, bare.try_cast("timestamp_ntz"))
    flag = F.when(value.isNull(), "invalid_timestamp").when(zoned, "timezone_present")
    return F.struct(F.when(flag.isNull(), value).alias("value"), flag.alias("flag"))


def parse_numeric(text: Column) -> Column:
    """(value, flag): a finite number after commas became points; nan and infinities are nonfinite_numeric, text is neither."""
    t = F.replace(strip(text), F.lit(","), F.lit("."))
    shape = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    number = F.when(t.rlike(shape), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    odd = t.rlike(r"(?i)^[+-]?(nan|inf|infinity)$") | F.coalesce(F.abs(number) == float("inf"), F.lit(False))
    return F.struct(F.when(~odd, number).alias("value"), F.when(odd, "nonfinite_numeric").alias("flag"))


def parse_nullable_bool(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.when(t.isin("true", "1", "yes", "да", "t", "y"), True).when(t.isin("false", "0", "no", "нет", "f", "n"), False)


def flags(*each: Column) -> Column:
    """The flags that are not null, in the order given."""
    return F.array_compact(F.array(*each))
