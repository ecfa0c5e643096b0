"""Scalar functions of the pattern language, as Spark columns.

A wrong type or arity gives null where the engine can tell, never an error at run time: divisions, casts and lookups are the try_
forms. Lists are indexed from 0, negative indexes count from the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"[\s   -     　\u0085]+"
DURATION = "struct<months:bigint,days:bigint,nanos:bigint>"


def long(c: Column) -> Column:
    return c.cast("long")


def trimmed(s: Column, chars: Column | None = None, mode: int = 0) -> Column:
    if chars is not None:
        out = s
        if mode in (0, 1):
            out = F.call_function("ltrim", chars, out)
        return F.call_function("rtrim", chars, out) if mode in (0, 2) else out
    out = F.regexp_replace(s, "^" + WHITE, "") if mode in (0, 1) else s
    return F.regexp_replace(out, WHITE + "$", "") if mode in (0, 2) else out


def substring(s: Column, start: Column, n: Column | None = None) -> Column:
    at = F.greatest(start, F.lit(0)) + 1
    return F.substr(s, at.cast("int"), (n if n is not None else F.char_length(s)).cast("int"))


def span(a: Column, b: Column, step: Column | None = None) -> Column:
    """Inclusive range; empty if the step leads away, null for step 0."""
    by = F.lit(1).cast("long") if step is None else long(step)
    ahead = ((by > 0) & (long(a) <= long(b))) | ((by < 0) & (long(a) >= long(b)))
    safe = F.when(ahead, by).otherwise(F.lit(1).cast("long"))
    end = F.when(ahead, long(b)).otherwise(long(a))
    return F.when(by == 0, F.lit(None)).when(ahead, F.sequence(long(a), end, safe)).otherwise(F.array().cast("array<bigint>"))


def list_item(l: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(l, i.cast("int"))).otherwise(F.get(l, (F.size(l) + i).cast("int")))


def list_slice(l: Column, low: Column | None, high: Column | None) -> Column:
    start = F.lit(0) if low is None else low
    end = F.size(l) if high is None else F.least(high, F.size(l))
    n = F.greatest(end - start, F.lit(0))
    return F.when((start < 0) | (end < 0), F.slice(l, 1, 0)).otherwise(F.slice(l, (F.greatest(start, F.lit(0)) + 1).cast("int"), n.cast("int")))


@F.pandas_udf(T.StringType())
def _normal_form(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize(f or "NFC", x) for x, f in zip(s, form, strict=True)])


ISO_DURATION = re.compile(
    r"^(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?$"
)


def duration(text: Column) -> Column:
    """Duration of an ISO 8601 text as (months, days, nanos); null if it isn't one."""
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, ISO_DURATION.pattern, i), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))
    sign = F.when(F.regexp_extract(text, ISO_DURATION.pattern, 1) == "-", -1).otherwise(1).cast("long")
    fraction = F.rpad(F.regexp_extract(text, ISO_DURATION.pattern, 9), 9, "0").cast("long")
    whole = (part(6) * 3600 + part(7) * 60 + part(8)) * 1_000_000_000
    return F.when(
        text.rlike(ISO_DURATION.pattern) & ~text.isin("P", "-P", "PT"),
        F.struct(
            (sign * (part(2) * 12 + part(3))).alias("months"),
            (sign * (part(4) * 7 + part(5))).alias("days"),
            (sign * (whole + F.coalesce(fraction, F.lit(0)))).alias("nanos"),
        ),
    )


def plus_duration(t: Column, d: Column, kind: T.DataType) -> Column:
    months = F.add_months(t, d.months.cast("int"))
    if isinstance(kind, T.DateType):
        return F.date_add(months, (d.days + F.floor(d.nanos / 86_400_000_000_000)).cast("int"))
    clock = t.cast("timestamp_ntz") - F.to_date(t).cast("timestamp_ntz")
    interval = F.make_dt_interval(d.days.cast("int"), F.lit(0), F.lit(0), (d.nanos / 1e9).cast("decimal(18,6)"))
    return months.cast("timestamp_ntz") + clock + interval


def negated(d: Column) -> Column:
    return F.struct((-d.months).alias("months"), (-d.days).alias("days"), (-d.nanos).alias("nanos"))


def as_days(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("months"), F.datediff(a, b).cast("long").alias("days"), zero.alias("nanos"))


def as_nanos(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return F.struct(zero.alias("months"), zero.alias("days"), (micros * 1000).alias("nanos"))


# -- vectors
def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


CASTS = {
    "INTEGER": "long", "INT": "long", "BIGINT": "long", "FLOAT": "double", "DOUBLE": "double", "BOOLEAN": "boolean", "BOOL": "boolean",
    "STRING": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz",
}


def try_cast(c: Column, kind: str, is_string: bool = False) -> Column:
    target = CASTS.get(kind.upper(), kind)
    if target == "long" and is_string:
        return F.coalesce(c.try_cast("long"), F.floor(c.try_cast("double")).try_cast("long"))
    return c.try_cast(target)


def positive(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(c > 0, f(c))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    # strings
    "tostring": lambda s: s.cast("string"),
    "trim": lambda s, chars=None, mode=None: trimmed(s, chars),
    "ltrim": lambda s: trimmed(s, mode=1),
    "rtrim": lambda s: trimmed(s, mode=2),
    "btrim": lambda s, chars=None: trimmed(s, chars),
    "replace": F.replace,
    "substring": substring,
    "split": lambda s, sep: F.split(s, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))),
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower,
    "char_length": lambda s: long(F.char_length(s)), "character_length": lambda s: long(F.char_length(s)),
    "octet_length": lambda s: long(F.octet_length(s)), "byte_length": lambda s: long(F.octet_length(s)),
    "left": lambda s, n: F.substr(s, F.lit(1), n.cast("int")),
    "right": lambda s, n: F.when(n <= 0, F.lit("")).otherwise(F.call_function("right", s, n.cast("int"))),
    "reverse": F.reverse,
    "string_join": lambda l, sep: F.array_join(l, sep) if isinstance(sep, str) else F.call_function("array_join", l, sep),
    "normalize": lambda s, form=None: _normal_form(s, F.lit("NFC") if form is None else form),
    "isnormalized": lambda s, form=None: s == _normal_form(s, F.lit("NFC") if form is None else form),
    # numbers
    "abs": F.abs, "ceil": lambda x: long(F.ceil(x)), "ceiling": lambda x: long(F.ceil(x)), "floor": lambda x: long(F.floor(x)),
    "round": lambda x: long(F.round(x)), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "exp": F.exp,
    "log": lambda x: positive(x, F.ln), "ln": lambda x: positive(x, F.ln), "log10": lambda x: positive(x, F.log10),
    "log2": lambda x: positive(x, F.log2), "pow": lambda a, b: F.pow(a, b), "power": lambda a, b: F.pow(a, b),
    "sign": lambda x: long(F.signum(x)), "e": lambda: F.e(), "pi": lambda: F.pi(),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "degrees": F.degrees, "radians": F.radians, "rand": lambda: F.rand(17), "random": lambda: F.rand(17),
    "mod": lambda a, b: F.call_function("try_mod", a, b),
    "tointeger": lambda x: F.coalesce(x.try_cast("long"), x.try_cast("double").try_cast("long")),
    "tofloat": lambda x: x.try_cast("double"), "toboolean": lambda x: x.try_cast("boolean"),
    # time
    "date": lambda x=None: F.current_date() if x is None else x.try_cast("date"),
    "datetime": lambda x=None: F.current_timestamp().cast("timestamp_ntz") if x is None else x.try_cast("timestamp_ntz"),
    "localdatetime": lambda x=None: F.current_timestamp().cast("timestamp_ntz") if x is None else x.try_cast("timestamp_ntz"),
    "time": lambda x=None: F.current_time() if x is None else x.try_cast("time(6)"),
    "local_time": lambda x=None: F.current_time() if x is None else x.try_cast("time(6)"),
    "duration": duration,
    "zoned_datetime": lambda x: F.struct(
        x.try_cast("timestamp").alias("ts"),
        F.coalesce(
            F.when(F.regexp_extract(x, r"([+-])(\d\d):?(\d\d)$", 1) == "-", -1).otherwise(1)
            * (F.regexp_extract(x, r"([+-])(\d\d):?(\d\d)$", 2).try_cast("int") * 3600 + F.regexp_extract(x, r"([+-])(\d\d):?(\d\d)$", 3).try_cast("int") * 60),
            F.lit(0),
        ).alias("offset"),
    ),
    "current_date": F.current_date, "current_timestamp": F.current_timestamp, "now": F.current_timestamp, "timestamp": F.current_timestamp,
    "year": lambda x: long(F.year(x)), "month": lambda x: long(F.month(x)), "day": lambda x: long(F.day(x)),
    "hour": lambda x: long(F.hour(x)), "minute": lambda x: long(F.minute(x)), "second": lambda x: long(F.second(x)),
    # lists
    "head": lambda l: F.get(l, F.lit(0)), "last": lambda l: F.try_element_at(l, F.lit(-1)),
    "tail": lambda l: F.slice(l, F.lit(2), F.greatest(F.size(l), F.lit(1))), "range": span,
    "coalesce": F.coalesce, "nullif": F.nullif, "tolist": lambda x: F.array(x), "keys": F.map_keys,
    "all_different": lambda *xs: F.size(F.array_distinct(F.array(*xs))) == len(xs),
    "same": lambda *xs: F.size(F.array_distinct(F.array(*xs))) == 1,
    # paths
    "isacyclic": lambda p: F.size(F.array_distinct(p.nodes)) == F.size(p.nodes),
    "istrail": lambda p: F.size(F.array_distinct(p.edges)) == F.size(p.edges),
    "issimple": lambda p: F.when(
        F.size(p.nodes) < 2, F.lit(True)
    ).otherwise(
        (F.size(F.array_distinct(F.slice(p.nodes, F.lit(2), F.size(p.nodes) - 1))) == F.size(p.nodes) - 1)
        & ((F.get(p.nodes, F.lit(0)) == F.try_element_at(p.nodes, F.lit(-1))) | (F.size(F.array_distinct(p.nodes)) == F.size(p.nodes)))
    ),
    # vectors
    "vector": lambda l: l.cast("array<float>"), "cosine_similarity": cosine_similarity, "dot_product": dot,
    "euclidean_distance": euclidean, "manhattan_distance": manhattan,
}


def truncate(unit: str, x: Column, kind: T.DataType) -> Column:
    """date_trunc by unit; an unknown unit gives null, a date stays a date."""
    u = unit.lower()
    known = {"year", "month", "day"} if isinstance(kind, T.DateType) else {"year", "month", "day", "hour", "minute", "second"}
    if u not in known:
        return F.lit(None).cast(kind)
    return F.date_trunc(u, x).cast(kind)
