"""Names and identities: hashes, ids, and the grammars of catalogs and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CATALOG_BYTES, MAX_LABEL_BYTES = 64, 128


def content_hash(text: Column) -> Column:
    """``sha256:`` and the hexadecimal SHA-256 of a text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def file_id(embedder: Column, chunker: Column, blob: Column, path: Column) -> Column:
    """16 hexadecimal digits that identify a file's content at its path, as seen by an embedder and a chunker."""
    return F.substring(F.sha2(F.concat_ws("\x1f", embedder, chunker, blob, path), 256), 1, 16)


def point_id(file: Column, ordinal: Column) -> Column:
    return F.concat(file, F.lit(":"), ordinal.cast("string"))


def git_blob_id(content: Column) -> Column:
    """The id that Git gives a blob of this content (text or binary) when no filter changes it."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.lit(b"\0"), data))


def _first_fault(name: Column, faults: str) -> Column:
    """The first character that a name mustn't have; empty if there is none."""
    return F.regexp_extract(name, f"({faults})", 1)


def _character_code(kind: str, fault: Column, reserved: str) -> Column:
    return (
        F.when(fault == "", None)
        .when(fault.rlike("^[A-Z]$"), f"{kind}_uppercase")
        .when(fault == "_", f"{kind}_underscore")
        .when(fault.rlike(f"^[{reserved}]$"), f"{kind}_reserved_char")
        .otherwise(f"{kind}_invalid_char")
    )


def catalog_error(name: Column) -> Column:
    """The code of the first rule that a catalog name breaks; null for a good name (and for null)."""
    return (
        F.when(name.isNull(), None)
        .when(name == "", "catalog_empty")
        .when(F.octet_length(name) > MAX_CATALOG_BYTES, "catalog_too_long")
        .when(name.startswith("-"), "catalog_leading_hyphen")
        .when(name.endswith("-"), "catalog_trailing_hyphen")
        .when(name.contains("--"), "catalog_consecutive_hyphens")
        .otherwise(_character_code("catalog", _first_fault(name, "[^a-z0-9-]"), ":@+#="))
    )


def label_error(name: Column) -> Column:
    """The code of the first rule that a label breaks, reading from the left; null for a good label (and for null)."""
    # what can go wrong first: a bad character, or a separator without anything since the last one
    fault = F.regexp_extract(name, r"^(?:[a-z0-9]+[./=-])*[a-z0-9]*([^a-z0-9])", 1)
    separator = fault.rlike(r"^[./=-]$")
    return (
        F.when(name.isNull(), None)
        .when(name == "", "label_empty")
        .when(F.octet_length(name) > MAX_LABEL_BYTES, "label_too_long")
        .when(name.rlike(r"^[a-z0-9]+(?:[./=-][a-z0-9]+)*$"), None)
        .when(name.rlike(r"^(?:[a-z0-9]+[./=-])+$"), "label_trailing_separator")
        .when(separator, "label_leading_separator")
        .otherwise(_character_code("label", fault, ":@+#"))
    )


def label_id_catalog(label_id: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(label_id.contains(":"), F.substring_index(label_id, ":", 1))


def label_id_label(label_id: Column) -> Column:
    """What stands after the first colon; null without one."""
    return F.when(label_id.contains(":"), F.regexp_extract(label_id, r"(?s)^[^:]*:(.*)$", 1))


def label_id_error(label_id: Column) -> Column:
    """The code of what is wrong with ``catalog:label``; null if nothing is."""
    return F.when(label_id.isNull(), None).when(~label_id.contains(":"), "label_id_no_colon").otherwise(
        F.coalesce(catalog_error(label_id_catalog(label_id)), label_error(label_id_label(label_id)))
    )
