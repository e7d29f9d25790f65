"""Cutting texts into chunks: by lines, and by the sections of a Markdown document.

All of it is native: a text's lines are an array, its cuts are found by folding over it, and the pieces are exploded in place. There is
neither a shuffle nor a Python worker, and a text's lines never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T

TARGET_BYTES = 6000
_RANGES = "array<struct<from:int,to:int>>"


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("from"), end.cast("int").alias("to"))


def _add(ranges: Column, start: Column, end: Column) -> Column:
    return F.array_append(ranges, _range(start, end))


def _state(start: Column, size: Column, at: Column, code: Column, ranges: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), size.cast("long").alias("size"), at.cast("int").alias("at"), code.cast("boolean").alias("code"), ranges.cast(_RANGES).alias("ranges")
    )


def _start() -> Column:
    return _state(F.lit(0), F.lit(0), F.lit(0), F.lit(False), F.array())


def line_ranges(lines: Column, limit: int) -> Column:
    """``[from, to)`` ranges of lines: as many lines as stay under ``limit`` bytes, at least one."""

    def step(s: Column, line: Column) -> Column:
        bytes_ = F.octet_length(line)
        at, after = s["at"], s["at"] + 1
        alone = bytes_ >= limit
        fits = s["size"] + bytes_ < limit
        flushed = F.when(s["start"] < at, _add(s["ranges"], s["start"], at)).otherwise(s["ranges"])
        return (
            F.when(fits, _state(s["start"], s["size"] + bytes_ + 1, after, s["code"], s["ranges"]))
            .when(alone, _state(after, F.lit(0), after, s["code"], _add(flushed, at, after)))
            .otherwise(_state(at, bytes_ + 1, after, s["code"], flushed))
        )

    return F.aggregate(lines, _start(), step, lambda s: F.when(s["start"] < s["at"], _add(s["ranges"], s["start"], s["at"])).otherwise(s["ranges"]))


def _is_fence(line: Column) -> Column:
    return T.trim(line).startswith("```")


def section_starts(lines: Column) -> Column:
    """Indexes of the lines that begin with ``#`` outside fences; a line of three backticks opens or closes a fence."""

    def step(s: Column, line: Column) -> Column:
        code = s["code"] != _is_fence(line)
        heading = ~code & T.trim(line).startswith("#")
        return F.struct(
            (s["at"] + 1).alias("at"), code.alias("code"), F.when(heading, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts")
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("code"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(lines, zero, step, lambda s: s["starts"])


def part_ranges(lines: Column, limit: int) -> Column:
    """Ranges of an oversized section: cut before a blank line, a closing fence, a quote or a list entry once ``limit`` is passed."""

    def step(s: Column, line: Column) -> Column:
        code = s["code"] != _is_fence(line)
        size = F.octet_length(line) + 1
        bare = T.trim(line)
        natural = (bare == "") | bare.rlike(r"^(?:```|[>*-])")
        cut = (s["size"] + size > limit) & (s["size"] > 0) & ~code & natural
        return F.when(cut, _state(s["at"], size, s["at"] + 1, code, _add(s["ranges"], s["start"], s["at"]))).otherwise(
            _state(s["start"], s["size"] + size, s["at"] + 1, code, s["ranges"])
        )

    return F.aggregate(lines, _start(), step, lambda s: F.when(s["start"] < s["at"], _add(s["ranges"], s["start"], s["at"])).otherwise(s["ranges"]))


def plain_ranges(lines: Column, limit: int) -> Column:
    """Ranges of lines whose bytes, line ends included, don't pass ``limit``; at least one line each."""

    def step(s: Column, line: Column) -> Column:
        size = F.octet_length(line) + 1
        cut = (s["size"] + size > limit) & (s["size"] > 0)
        return F.when(cut, _state(s["at"], size, s["at"] + 1, s["code"], _add(s["ranges"], s["start"], s["at"]))).otherwise(
            _state(s["start"], s["size"] + size, s["at"] + 1, s["code"], s["ranges"])
        )

    return F.aggregate(lines, _start(), step, lambda s: F.when(s["start"] < s["at"], _add(s["ranges"], s["start"], s["at"])).otherwise(s["ranges"]))


def _lines_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start), "\n")


def line_chunks(files: DataFrame, text: str = "text", *, limit: int = TARGET_BYTES) -> DataFrame:
    """``files`` without its text and with ``chunk_text, start_line, end_line, chunk_ordinal, chunk_count``.

    Chunks of white space only are dropped before numbering. Null and blank texts have no chunks. A line of ``limit``
    bytes or more is a chunk of its own.
    """
    rest = [c for c in files.columns if c != text]
    cut = (
        files.where(F.col(text).isNotNull())
        .select(*rest, T.split_lines(F.col(text)).alias("_lines"))
        .select(*rest, "_lines", line_ranges(F.col("_lines"), limit).alias("_ranges"))
    )
    pieces = F.transform(
        F.col("_ranges"),
        lambda r: F.struct(_lines_text(F.col("_lines"), r["from"], r["to"]).alias("t"), (r["from"] + 1).alias("s"), r["to"].alias("e")),
    )
    kept = cut.select(*rest, F.filter(pieces, lambda p: T.trim(p["t"]) != "").alias("_pieces"))
    return kept.select(*rest, F.size("_pieces").alias("chunk_count"), F.posexplode("_pieces").alias("_at", "_p")).select(
        *rest,
        F.col("_p.t").alias("chunk_text"),
        F.col("_p.s").alias("start_line"),
        F.col("_p.e").alias("end_line"),
        (F.col("_at") + 1).alias("chunk_ordinal"),
        "chunk_count",
    )


def unique_slugs(slugs: Column) -> Column:
    """The slugs of a document's headings, each made unique: a slug that is taken gets the first free number from 1.

    Null entries (headings without words) stay null.
    """

    def step(done: Column, slug: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.size(done) + 1)
        free = F.get(F.filter(numbers, lambda n: ~F.array_contains(done, F.concat(slug, F.lit("-"), n.cast("string")))), 0)
        return F.array_append(done, F.when(F.array_contains(done, slug), F.concat(slug, F.lit("-"), free.cast("string"))).otherwise(slug))

    return F.aggregate(slugs, F.array().cast("array<string>"), step)


def markdown_sections(files: DataFrame, text: str = "text", *, keep_preamble: bool = False) -> DataFrame:
    """``files`` without its text and with ``lines, start_line, end_line, heading, slug`` of each section.

    A section begins at a heading and ends before the next. What stands before the first heading is left out, unless
    ``keep_preamble``. A text without headings is one section with a null heading and ``whole`` true. Null texts and
    blank sections give no rows.
    """
    rest = [c for c in files.columns if c != text]
    lined = files.where(F.col(text).isNotNull()).select(*rest, T.split_lines(F.col(text)).alias("_lines"))
    starts = section_starts(F.col("_lines"))
    started = lined.select(*rest, "_lines", starts.alias("_found"))
    found = F.when(F.size("_found") == 0, F.array(F.lit(0))).otherwise(
        F.when((F.col("_found")[0] > 0) & F.lit(keep_preamble), F.concat(F.array(F.lit(0)), "_found")).otherwise(F.col("_found"))
    )
    started = started.select(*rest, "_lines", (F.size("_found") == 0).alias("whole"), found.alias("_starts"))

    def says(start: Column) -> Column:
        line = F.get("_lines", start)
        return F.when(~F.col("whole") & T.trim(line).startswith("#"), T.heading_text(line))

    started = started.withColumn("_headings", F.transform("_starts", says))
    started = started.withColumn("_slugs", unique_slugs(F.transform("_headings", T.slug)))

    # every section takes its own lines before the rows are multiplied, so no row carries the whole document
    def section(start: Column, at: Column) -> Column:
        end = F.coalesce(F.get("_starts", at + 1), F.size("_lines"))
        return F.struct(
            (start + 1).alias("start_line"), end.alias("end_line"), F.slice("_lines", start + 1, F.greatest(end - start, F.lit(0))).alias("lines"),
            F.get("_headings", at).alias("heading"), F.get("_slugs", at).alias("slug"),
        )

    sections = started.select(*rest, "whole", F.explode(F.transform("_starts", section)).alias("_s"))
    return sections.select(*rest, "whole", *(F.col(f"_s.{c}").alias(c) for c in ("start_line", "end_line", "lines", "heading", "slug"))).where(F.exists("lines", lambda line: T.trim(line) != ""))


def markdown_chunks(files: DataFrame, text: str = "text", *, limit: int = TARGET_BYTES, keep_preamble: bool = False) -> DataFrame:
    """The chunks of Markdown texts: sections, oversized ones divided into numbered parts.

    Adds ``chunk_text, start_line, end_line, chunk_type, symbol_name, split_part_ordinal, split_part_count`` to the
    columns of ``files`` other than the text. Part numbers count blank parts, which are then left out. A text without
    headings is one chunk of type ``markdown``, whatever its size. A section that offers no place to cut is cut between any lines, as type ``markdown``.
    """
    rest = [c for c in files.columns if c != text]
    sections = markdown_sections(files, text, keep_preamble=keep_preamble)
    size = F.octet_length(F.array_join("lines", "\n"))
    large = ~F.col("whole") & (size > limit)
    natural = part_ranges(F.col("lines"), limit)
    parted = sections.withColumn("_ranges", F.when(large, natural).otherwise(F.array(_range(F.lit(0), F.size("lines"))))).withColumn(
        "_plain", large & (F.size("_ranges") == 1)
    )
    parted = parted.withColumn("_ranges", F.when(F.col("_plain"), plain_ranges(F.col("lines"), limit)).otherwise(F.col("_ranges"))).withColumn("_large", large)
    pieces = parted.select("*", F.posexplode("_ranges").alias("_at", "_r")).withColumn("chunk_text", _lines_text(F.col("lines"), F.col("_r.from"), F.col("_r.to")))
    return pieces.where(T.trim(F.col("chunk_text")) != "").select(
        *rest,
        "chunk_text",
        (F.col("start_line") + F.col("_r.from")).alias("start_line"),
        (F.col("start_line") + F.col("_r.to") - 1).alias("end_line"),
        F.when(F.col("whole") | F.col("_plain"), "markdown").otherwise("section").alias("chunk_type"),
        F.when(~F.col("_large"), F.col("heading")).alias("symbol_name"),
        F.when(F.col("_large"), F.col("_at") + 1).alias("split_part_ordinal"),
        F.when(F.col("_large"), F.size("_ranges")).alias("split_part_count"),
        "heading",
        "slug",
    )


def chunk_ordinals(chunks: DataFrame, file: str = "file_id", start: str = "start_line") -> DataFrame:
    """``chunks`` with ``chunk_ordinal`` (1, 2, ... by start line) and ``chunk_count`` of its file."""
    by_file = Window.partitionBy(file)
    return chunks.withColumns(
        {"chunk_ordinal": F.row_number().over(by_file.orderBy(start)), "chunk_count": F.count(F.lit(1)).over(by_file).cast("int")}
    )
