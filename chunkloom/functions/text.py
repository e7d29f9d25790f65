"""Text functions as columns: lines, paths, headings, and what is shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\p{Cc}]"


def split_lines(text: Column) -> Column:
    """The lines of a text, ended by LF or CRLF; a final line end opens no further line, the empty text has none."""
    lines = F.split(text, r"\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    )


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def encode_path(text: Column) -> Column:
    """Percent-encodes ``: @ = + # %``, white space and control characters as their UTF-8 bytes."""
    reserved = rf"[:@=+#%]|{_SPACE}"
    each = F.transform(
        F.split(text, ""),
        lambda c: F.when(c.rlike(f"^(?:{reserved})$"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c),
    )
    # most names need no encoding, and are spared the way through single characters
    return F.when(text.rlike(reserved), F.array_join(each, "")).otherwise(text)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slug(heading: Column) -> Column:
    """A heading as an anchor: lower case, no punctuation, a hyphen for each blank."""
    return F.translate(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}\p{M}\p{Pc} -]", ""), " ", "-")


def heading_text(line: Column) -> Column:
    """What a heading line says; null if it says nothing."""
    return F.nullif(trim(F.regexp_replace(trim(line), "^#+", "")), F.lit(""))


def breadcrumb(package: Column, file: Column, suffix: Column) -> Column:
    """``package:file[:suffix]`` of encoded parts; an empty or missing part is left out."""
    return F.concat_ws(":", F.nullif(encode_path(package), F.lit("")), encode_path(file), F.nullif(encode_path(suffix), F.lit("")))


def sanitize(text: Column) -> Column:
    """Without control characters, except tab and line ends, so that it can be shown in a terminal."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", "")


def report_line(crumb: Column, part: Column, parts: Column, kind: Column) -> Column:
    """A chunk's breadcrumb with its part numbers and, unless it is ordinary content, its kind."""
    return F.concat(
        sanitize(F.coalesce(crumb, F.lit("unknown"))),
        F.when(part.isNotNull() & parts.isNotNull(), F.concat(F.lit(" (part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))).otherwise(""),
        F.when(kind != "content", F.concat(F.lit(" ["), kind, F.lit("]"))).otherwise(""),
    )


def blurb(text: Column, lines: int = 3) -> Column:
    """The first lines, quoted."""
    return F.array_join(F.transform(F.slice(split_lines(text), 1, lines), lambda x: F.concat(F.lit("> "), x)), "\n")


def format_duration(seconds: Column) -> Column:
    """``2h 5m``, ``3m 7s`` or ``9s``; fractions are cut off, negative durations count as none."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )


def format_eta(seconds: Column) -> Column:
    return F.when((seconds > 0) & (seconds < float("inf")) & ~F.isnan(seconds), format_duration(seconds)).otherwise("--")


def format_bytes(size: Column) -> Column:
    """``1.5 GB``, ``3.2 MB`` or ``17 bytes``."""
    gb, mb = float(1 << 30), float(1 << 20)
    return (
        F.when(size >= gb, F.format_string("%.1f GB", size.cast("double") / gb))
        .when(size >= mb, F.format_string("%.1f MB", size.cast("double") / mb))
        .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" bytes")))
    )
