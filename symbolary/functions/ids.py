"""Identities of files and symbols as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOC_SUFFIX, DOCUMENT_SUFFIX = "#doc", "#document"


def path_part(part: Column) -> Column:
    """A folder or file name as it stands in an id: lower case, without underscores at its ends."""
    return F.lower(F.btrim(part, F.lit("_")))


def file_prefix(path: Column, keep_extension: Column | bool = False) -> Column:
    """The id of a file from its relative path: its parts without the last extension, or with it behind an underscore."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    bare = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    kept = F.lit(keep_extension) if isinstance(keep_extension, bool) else keep_extension
    extension = F.regexp_extract(last, r".\.([^.]*)$", 1)
    name = F.when(kept & (extension != ""), F.concat(bare, F.lit("_"), extension)).otherwise(bare)
    named = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(name))
    return F.array_join(F.transform(named, path_part), "_")


def mint(prefix: Column, label: Column, scope: Column | None = None) -> Column:
    """The id of a symbol: its file, its enclosing scopes and its own name, joined by underscores."""
    inner = F.transform(scope, lambda s: F.lower(s)) if scope is not None else F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(prefix), inner, F.array(F.lower(label))), "_")


def document_id(path: Column) -> Column:
    """A document's id keeps its extension and can't meet a symbol's, which has no #."""
    return F.concat(F.array_join(F.transform(F.split(path, "/"), path_part), "_"), F.lit(DOCUMENT_SUFFIX))


def claim_id(path: Column, line: Column) -> Column:
    return F.concat(document_id(path), F.lit("#L"), line.cast("string"))
