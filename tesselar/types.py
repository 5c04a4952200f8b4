"""Type helpers: PostgreSQL null order, and text forms of arrays, intervals, vectors and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: PostgreSQL type name -> Spark type.
TYPES = {
    "bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double",
    "numeric": "decimal(38,10)", "text": "string", "varchar": "string", "char": "string", "bytea": "binary", "uuid": "string", "date": "date",
    "time": "string", "timetz": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "json": "string", "jsonb": "string",
    "inet": "string", "cidr": "string", "macaddr": "string", "interval": "struct<months:int,days:int,micros:bigint>", "vector": "array<float>",
}


def order(col: Column | str, descending: bool = False, nulls: str | None = None) -> Column:
    """Sort key with PostgreSQL's null order: last if ascending, first if descending; `nulls` states it."""
    c = F.col(col) if isinstance(col, str) else col
    first = descending if nulls is None else nulls == "first"
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def array_to_text(values: Column, dimensions: int = 1) -> Column:
    """PostgreSQL array literal: elements quoted where needed, NULL unquoted; arrays of arrays nest."""

    def one(x: Column) -> Column:
        x = x.cast("string")
        escaped = F.regexp_replace(x, r'(["\\])', r"\\$1")
        plain = x.rlike(r'^[^\s{}",\\]+$') & (F.upper(x) != "NULL")
        return F.when(x.isNull(), "NULL").when(plain, x).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))

    inner = one if dimensions == 1 else lambda x: array_to_text(x, dimensions - 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(values, inner), ","), F.lit("}"))


_ELEMENT = r'"(?:[^"\\]|\\.)*"|(?:[^"{},\\\s]|\\.)(?:[^"{},\\]|\\.)*'


def text_to_array(text: Column, kind: str = "array<string>") -> Column:
    """Array of a PostgreSQL array literal; kind is array<type> or array<array<type>>, optional bounds such as [0:1]= are dropped."""
    from pyspark.sql.types import ArrayType, DataType

    of = DataType.fromDDL(kind).elementType
    body = F.regexp_extract(text, r"(?s)^\s*(?:(?:\[-?\d+:-?\d+\])+=)?\{(.*)\}\s*$", 1)
    if isinstance(of, ArrayType):
        # rows are cut at braces outside quotes
        parts = F.regexp_extract_all(body, F.lit(rf"(?s)(\{{(?:{_ELEMENT}|[,\s])*\}})"), 1)
        return F.transform(parts, lambda x: text_to_array(x, of.simpleString()))
    items = F.regexp_extract_all(body, F.lit(rf"(?s)({_ELEMENT})"), 1)

    def one(x: Column) -> Column:
        quoted = x.startswith('"')
        inner = F.when(quoted, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(F.rtrim(x))
        plain = F.regexp_replace(inner, r"(?s)\\(.)", "$1")
        return F.when(~quoted & (F.upper(F.rtrim(x)) == "NULL"), F.lit(None)).otherwise(plain).cast(of)

    return F.transform(items, one)


def timestamp_to_binary(value: Column) -> Column:
    """Microseconds since 2000-01-01."""
    return F.unix_micros(value) - 946_684_800_000_000


def binary_to_timestamp(micros: Column) -> Column:
    return F.timestamp_micros(micros + 946_684_800_000_000)


def parse_timestamp(text: Column) -> Column:
    """Microseconds since 2000-01-01 of a timestamp's text: with a fraction, a zone (UTC if none), BC, or infinity (the largest and smallest numbers).

    Days are counted in the proleptic Gregorian calendar, in which 1 BC is year 0.
    """
    part = lambda g: F.regexp_extract(text, r"^(\d+)-(\d+)-(\d+)(?: (\d+):(\d+):(\d+)(?:\.(\d+))?)?(?:([-+])(\d+)(?::?(\d+))?)?( BC)?$", g)
    number = lambda g: F.when(part(g) == "", F.lit(0)).otherwise(F.nullif(part(g), F.lit("")).cast("long"))
    year = F.when(part(11) != "", 1 - number(1)).otherwise(number(1))
    month, day = number(2), number(3)
    # days of the civil calendar, years beginning in March
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * F.pmod(month + 9, F.lit(12)) + 2) / 5) + day - 1
    days = era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468 - 10957
    micros = F.rpad(part(7), 6, "0").substr(1, 6)
    clock = (number(4) * 3600 + number(5) * 60 + number(6)) * 1_000_000 + F.when(part(7) == "", F.lit(0)).otherwise(micros.cast("long"))
    zone = (number(9) * 3600 + number(10) * 60) * F.when(part(8) == "-", F.lit(-1)).otherwise(F.lit(1)) * 1_000_000
    finite = days.cast("long") * 86_400_000_000 + clock - zone
    return F.when(text == "infinity", F.lit(2**63 - 1)).when(text == "-infinity", F.lit(-(2**63))).otherwise(finite)


def parse_interval(text: Column) -> Column:
    """struct(months, days, micros) of `1 year 2 mons 3 days -04:05:06.7`."""

    def amount(unit: str) -> Column:
        got = F.regexp_extract(text, rf"([-+]?\d+)\s*(?:{unit})", 1)
        return F.when(got == "", F.lit(0)).otherwise(got.cast("long"))

    clock = r"([-+]?)(\d+):(\d+)(?::(\d+)(?:\.(\d+))?)?"
    part = lambda g: F.when(F.regexp_extract(text, clock, g) == "", F.lit(0)).otherwise(F.regexp_extract(text, clock, g).cast("long"))
    micros = F.rpad(F.regexp_extract(text, clock, 5), 6, "0").substr(1, 6).cast("long")
    total = (part(2) * 3600 + part(3) * 60 + part(4)) * 1_000_000 + micros
    signed = F.when(F.regexp_extract(text, clock, 1) == "-", -total).otherwise(total)
    return F.struct((amount("years?") * 12 + amount("mons?")).cast("int").alias("months"), amount("days?").cast("int").alias("days"), signed.alias("micros"))


def interval_key(value: Column) -> Column:
    """PostgreSQL's interval order: months count as 30 days."""
    return (value["months"].cast("long") * 30 + value["days"]) * 86_400_000_000 + value["micros"]


def parse_vector(text: Column) -> Column:
    """array<float> of `[1,2.5]`."""
    return F.from_json(text, "array<float>")
