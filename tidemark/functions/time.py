"""Times as columns: timecodes, frames, capture times and epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_ms(frame: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a timestamp column, with or without a time zone, whatever the session's zone."""
    if dict(frame.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_millis(name)


def format_timecode(ms: Column, mark: str = ".") -> Column:
    """``H:MM:SS.mmm`` with two digits of hours at least."""
    ms = ms.cast("long")
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours = F.floor(ms / 3600000)
    shown = F.when(hours < 10, part(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(mark), part(ms % 1000, 3))


def parse_timecode(text: Column) -> Column:
    """Milliseconds of ``[[H:]MM:]SS[.mmm]``; null if it isn't one."""
    pattern = r"^(?:(?:(\d+):)?(\d{1,2}):)?(\d+)(?:[.,](\d{1,3}))?$"
    group = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(text, pattern, i), F.lit("999999999")), F.lit(0)).cast("long")
    fraction = F.rpad(F.regexp_extract(text, pattern, 4), 3, "0").cast("long")
    return F.when(text.rlike(pattern), (group(1) * 3600 + group(2) * 60 + group(3)) * 1000 + F.coalesce(fraction, F.lit(0)))


def frame_at(ms: Column, rate: int, per: int = 1) -> Column:
    """Nearest frame of a time at ``rate/per`` frames a second."""
    return F.floor((ms.cast("long") * rate + 500 * per) / (1000 * per)).cast("long")


def smpte(frame: Column, rate: int, per: int = 1) -> Column:
    """Frame number as a timecode, with two digits of hours at least; at 30000/1001 and 60000/1001 labels are dropped, 2 or 4 a
    minute but for each tenth."""
    base = -(-rate // per)
    drop = {(30000, 1001): 2, (60000, 1001): 4}.get((rate, per), 0)
    n = frame.cast("long")
    if drop:
        tens, rest = F.floor(n / (base * 600 - 9 * drop)), n % (base * 600 - 9 * drop)
        n = n + 9 * drop * tens + F.when(rest > drop, drop * F.floor((rest - drop) / (base * 60 - drop))).otherwise(0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(n / (base * 3600))
    return F.concat_ws(":", F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), two(F.floor(n / (base * 60)) % 60), F.concat(two(F.floor(n / base) % 60), F.lit(";" if drop else ":"), two(n % base)))


def frame_of_smpte(text: Column, rate: int, per: int = 1) -> Column:
    """Frame number of a timecode; null if it isn't one."""
    base = -(-rate // per)
    drop = {(30000, 1001): 2, (60000, 1001): 4}.get((rate, per), 0)
    pattern = r"^(\d{2,}):(\d{2}):(\d{2})[:;](\d{2})$"
    h, m, s, f = (F.regexp_extract(text, pattern, i).try_cast("long") for i in range(1, 5))
    minutes = h * 60 + m
    return F.when(text.rlike(pattern), ((minutes * 60) + s) * base + f - drop * (minutes - F.floor(minutes / 10)))


def capture_time(text: Column) -> Column:
    """Struct ``ms``, ``kind`` (instant, local, date) and ``offset_min`` of a written capture time, from 1971 on; null if
    it can't be read. Forms: ISO and ``YYYY:MM:DD HH:MM:SS``, each with or without a time, fraction or offset."""
    pattern = r"^(\d{4})[-:](\d{2})[-:](\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
    g = lambda i: F.regexp_extract(F.trim(text), pattern, i)
    n = lambda i: F.coalesce(g(i).try_cast("int"), F.lit(0))
    day = F.try_to_date(F.concat_ws("-", g(1), g(2), g(3)), "yyyy-MM-dd")
    zone = F.when(g(8) == "Z", 0).when(g(8) != "", F.when(F.substring(g(8), 1, 1) == "-", -1).otherwise(1) * (F.substring(g(8), 2, 2).try_cast("int") * 60 + F.substring(g(8), -2, 2).try_cast("int")))
    clock = (n(4) * 3600 + n(5) * 60 + n(6)) * 1000 + F.coalesce(F.rpad(F.substring(g(7), 1, 3), 3, "0").try_cast("int"), F.lit(0))
    ms = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400000 + clock - F.coalesce(zone, F.lit(0)) * 60000
    kind = F.when(g(4) == "", "date").when(g(8) == "", "local").otherwise("instant")
    fine = F.trim(text).rlike(pattern) & day.isNotNull() & (n(1) >= 1971) & (n(4) < 24) & (n(5) < 60) & (n(6) < 61) & F.coalesce(zone.between(-720, 840), F.lit(True))
    return F.when(fine, F.struct(ms.alias("ms"), kind.alias("kind"), zone.alias("offset_min")))
