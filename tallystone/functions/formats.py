"""Display expressions: sizes, durations, bars, dates, error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB, TB = (float(1 << s) for s in (10, 20, 30, 40))


def fixed(x: Column, digits: int) -> Column:
    """Half-even rounding before formatting, as for exact decimal values."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))


def size_text(size: Column) -> Column:
    """``1.50 TB``, ``1.5 GB``, ``2 MB``, ``3 KB``, ``4 B``; negative sizes are ``0 B``.

    A unit begins at its power of 1024.
    """
    x = size.cast("double")
    return (
        F.when(size < 0, F.lit("0 B"))
        .when(x >= TB, F.concat(fixed(x / TB, 2), F.lit(" TB")))
        .when(x >= GB, F.concat(fixed(x / GB, 1), F.lit(" GB")))
        .when(x >= MB, F.concat(fixed(x / MB, 0), F.lit(" MB")))
        .when(x >= KB, F.concat(fixed(x / KB, 0), F.lit(" KB")))
        .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))
    )


def size_text_digits(size: Column, digits: int) -> Column:
    """The same digits for every unit above bytes (2: scan log, 1: run summary)."""
    x = size.cast("double")
    chain = F.when(x >= TB, F.concat(fixed(x / TB, digits), F.lit(" TB")))
    for unit, name in ((GB, "GB"), (MB, "MB"), (KB, "KB")):
        chain = chain.when(x >= unit, F.concat(fixed(x / unit, digits), F.lit(f" {name}")))
    return chain.otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))


def duration_text(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    rest = F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, rest)).when(m > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))


def usage_bar(percent: Column, width: int = 20) -> Column:
    full = F.least(F.lit(width), F.greatest(F.lit(0), (percent / 100 * width).cast("int")))
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("]"))


def percent_of(part: Column, total: Column) -> Column:
    """Share in percent; a missing or zero total counts as 1."""
    total = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(1)).otherwise(total)
    return part.cast("double") / total.cast("double") * 100


def utc(epoch: Column) -> Column:
    """Time without zone at Greenwich, whatever the session's zone.

    Days apart from seconds, whose type ends at 10^12.
    """
    days = F.floor(epoch / 86400)
    seconds = (epoch - days * 86400).cast("decimal(18,6)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds)


def plain_year(text: Column) -> Column:
    """Without the plus sign that years of more than four digits begin with."""
    return F.ltrim(text, F.lit("+"))


def timestamp_text(epoch: Column) -> Column:
    return plain_year(F.date_format(utc(epoch), "yyyy-MM-dd HH:mm:ss"))


def label_date(epoch: Column) -> Column:
    return utc(epoch).cast("date")


def date_text(epoch: Column) -> Column:
    return plain_year(label_date(epoch).cast("string"))


def grouped_number(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def rate_text(rate: Column) -> Column:
    """Grouped thousands and one decimal."""
    return F.format_number(F.round(rate.cast("double"), 1), 1)


#: What messages say, by code; the first that fits counts.
ERROR_SIGNS = {
    "EACCES": ("os error 13", "Permission denied", "permission denied"),
    "ENOENT": ("os error 2", "No such file", "no such file"),
    "EIO": ("os error 5",),
}


def error_code(message: Column) -> Column:
    """EACCES, ENOENT, EIO or EOTHER of an error message."""
    out = F.lit("EOTHER")
    for code, signs in reversed(ERROR_SIGNS.items()):
        fits = F.contains(message, F.lit(signs[0]))
        for sign in signs[1:]:
            fits = fits | F.contains(message, F.lit(sign))
        out = F.when(fits, F.lit(code)).otherwise(out)
    return out


def error_path(message: Column) -> Column:
    """What stands before the first ``": "``; else empty."""
    return F.when(F.contains(message, F.lit(": ")), F.substring_index(message, ": ", 1)).otherwise("")


def default_name(uid: Column) -> Column:
    return F.concat(F.lit("uid-"), uid.cast("string"))


def disk_bytes(blocks: Column) -> Column:
    """Bytes on disk of 512-byte blocks."""
    return blocks * 512
