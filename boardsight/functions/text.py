"""Columns over labels, durations, names, times and log records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Log levels, least to most severe.
LEVELS = ("debug", "info", "warning", "error", "critical")
DASH = "—"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the standard URL namespace id


def x_report_duration(start: Column, end: Column) -> Column:
    """``Xm YYs`` of whole seconds, a dash while open."""
    s = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)
    text = F.concat(F.floor(s / 60).cast("string"), F.lit("m "),
                    F.lpad((s - F.floor(s / 60) * 60).cast("string"), 2, "0"), F.lit("s"))
    return F.coalesce(text, F.lit(DASH))


def x_long_duration(start: Column, end: Column) -> Column:
    """``h m s`` form, never negative, hours only from one on."""
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    short = F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), short)).otherwise(short)


def x_length(seconds: Column) -> Column:
    """``m:ss``, rounded (half up) first."""
    s = F.floor(seconds + 0.5)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def x_mm_label(x_mm: Column, y_mm: Column) -> Column:
    """Signed millimetres to 0.1, a dash without a position."""
    def signed(v: Column) -> Column:
        return F.format_string("%+.1f", v.cast("double"))
    known = x_mm.isNotNull() & y_mm.isNotNull()
    return F.when(known, F.concat(signed(x_mm), F.lit(", "), signed(y_mm), F.lit(" mm"))).otherwise(DASH)


def x_slug(name: Column) -> Column:
    """ASCII file-name form of a session name."""
    ascii_only = F.regexp_replace(name, r"[^\x00-\x7F]", "?")
    marked = F.regexp_replace(ascii_only, r"[^A-Za-z0-9_\s-]", "_")
    joined = F.regexp_replace(marked, r"\s+", "_")
    trimmed = F.regexp_replace(joined, "^_+|_+$", "")
    return F.when(trimmed == "", "session").otherwise(trimmed)


def x_file_name(name: Column, started: Column, extension: str) -> Column:
    """Dated file name."""
    return F.concat(F.lit("session_"), x_slug(name), F.lit("_"),
                    F.date_format(started, "yyyyMMdd"), F.lit(f".{extension}"))


def x_iso_ms(ts: Column) -> Column:
    """UTC text cut to milliseconds, with Z."""
    return F.date_format(F.date_trunc("millisecond", ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def x_parse_iso(text: Column) -> Column:
    """An instant from ``Z`` or ``+hh:mm`` text; null if unreadable."""
    return text.try_cast("timestamp")


# Forms that case folding writes with other letters.
FOLDS = [("ß", "ss"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
# Fixed value: white space at either end, Unicode's and the four separators of ASCII.
SPACE_AROUND = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def x_name_key(name: Column) -> Column:
    """Without white space around it, and case folded: a letter's upper
    case, lowered, is the same for all its forms but those of ``FOLDS``."""
    key = F.lower(F.upper(F.regexp_replace(name, SPACE_AROUND, "")))
    for form, folded in FOLDS:
        key = F.replace(key, F.lit(form), F.lit(folded))
    return key


def x_plain_json(value: Column) -> Column:
    """Any nested value as JSON text, times as ISO text."""
    return F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})


def x_request_level(status: Column, method: Column, path: Column) -> Column:
    """Log level of a served request."""
    return (F.when(status >= 500, "error").when(status >= 400, "warning")
            .when((method == "OPTIONS") | path.rlike("^/(status|health)$"), "debug").otherwise("info"))


def x_truth_folder(file: Column) -> Column:
    """``Name_1.mkv`` gives ``name-1``."""
    return F.replace(F.lower(F.regexp_replace(file, r"\.[^.]*$", "")), F.lit("_"), F.lit("-"))


def x_level_rank(level: Column) -> Column:
    """Place of a known level, 0 when unknown."""
    return F.array_position(F.array(*[F.lit(v) for v in LEVELS]), level)


def x_derived_key(session: Column, camera: Column, frame: Column, x: Column, y: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a confirmed hole."""
    name = F.concat_ws(":", session, camera, frame.cast("string"),
                       F.bround(x, 0).cast("long").cast("string"), F.bround(y, 0).cast("long").cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
                    F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
                    F.substring(digest, 21, 12))
