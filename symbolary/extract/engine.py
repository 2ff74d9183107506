"""The extract stage: files to tagged rows in one pass, a failed file as a row of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolary.extract import brace_reader, end_reader, python_reader
from symbolary.functions.ids import file_prefix
from symbolary.sources.files import LANGUAGES

#: Readers by language: read(path, prefix, folders, source, put). A language without one is counted as missing.
READERS = {"python": python_reader.read} | {x: brace_reader.reader(x) for x in brace_reader.SPECS} | {x: end_reader.reader(x) for x in end_reader.LEXES}
#: Languages whose file ids keep the extension.
KEEP_EXTENSION = tuple(x for x, spec in brace_reader.SPECS.items() if spec.keep_extension)
FIELDS = "row string, path string, prefix string, ordinal long, id string, label string, kind string, line int, text string, bases array<string>, source string, target string, relation string, name string, dotted string, scope string, owner string, cls string, receiver string, receiver_is_self boolean, on_self boolean"


def language_of(path: str) -> str | None:
    return next((lang for end, lang in LANGUAGES.items() if path.lower().endswith(end)), None)


def languages(spark) -> DataFrame:
    """extension, language, missing: why files of this extension can't be read here (null if they can)."""
    rows = ", ".join(f"('{e}', '{x}', {'null' if x in READERS else repr(f'no parser for {x} is installed')})" for e, x in LANGUAGES.items())
    return spark.sql(f"select extension, language, cast(missing as string) as missing from values {rows} as t(extension, language, missing)")


def extract(files: DataFrame) -> DataFrame:
    """Tagged rows (`row` says which: file, node, edge, call, import, site, var, attr, owner, failed, missing) of files (path, source)."""
    schema = T._parse_datatype_string(FIELDS)
    keys, kinds = schema.names, pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get(f.dataType.simpleString(), pa.list_(pa.string()) if f.name == "bases" else pa.string())) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, prefix, source in zip(*(batch.column(c).to_pylist() for c in ("path", "prefix", "source")), strict=True):
                found: list[dict] = []

                def put(row: str, path=path, prefix=prefix, found=found, **fields) -> None:
                    found.append({"row": row, "path": path, "prefix": prefix, "ordinal": len(found), **fields})

                lang = language_of(path)
                if lang not in READERS:
                    put("missing", name=lang)
                else:
                    put("node", id=prefix, label=path.rsplit("/", 1)[-1], kind="file", line=1)
                    try:
                        READERS[lang](path, prefix, path.split("/")[:-1], source or "", put)
                    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                        found.clear()
                        put("failed", name=type(e).__name__)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in found], kinds.field(k).type) for k in keys], schema=kinds)

    ends = [e for e, x in LANGUAGES.items() if x in KEEP_EXTENSION]
    kept = F.greatest(*(F.endswith(F.lower("path"), F.lit(e)) for e in ends))
    return files.select("path", file_prefix(F.col("path"), kept).alias("prefix"), "source").mapInArrow(run, schema)


def graph_of(files: DataFrame, edges_too: bool = True) -> dict[str, DataFrame]:
    """nodes, edges (resolved and refused), decided calls, and failed files of files (path, source)."""
    from symbolary.operators import resolve
    from symbolary.sources.shared import cut

    rows = cut(extract(files))
    every = rows.where("row = 'node'").select("id", "label", "kind", F.col("path").alias("file"), "line", "text", "bases", "prefix", "ordinal")
    # the first of an id, by path and place, is its node; others are reported as collisions
    nodes = every.groupBy("id").agg(F.min_by(F.struct(*(c for c in every.columns if c != "id")), F.struct("file", "ordinal")).alias("n")).select("id", "n.*")
    collisions = every.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat("file", F.lit(":L"), "line"))).alias("places")).where("n > 1")
    prefixes = nodes.where("kind = 'file'").select("prefix").distinct()
    imported = resolve.imported_names(rows.where("row = 'import'").select("prefix", F.col("name").alias("local"), "dotted"), nodes, prefixes)
    owners = rows.where("row = 'owner'").groupBy("id", "prefix").agg(F.first("owner").alias("owner"))
    attributes = rows.where("row = 'attr'").groupBy("prefix", "owner", F.col("name").alias("attr")).agg(F.max_by("cls", "ordinal").alias("cls"))
    variables = resolve.variable_types(rows.where("row = 'var'").select("prefix", "scope", F.col("name").alias("var"), "cls", "ordinal"))
    calls = rows.where("row = 'call'").select(F.col("id").alias("caller"), "prefix", "name", "receiver", "receiver_is_self", "on_self", F.col("path").alias("file"), "line", "ordinal")
    decided = resolve.resolve_calls(calls, nodes, owners, attributes, variables, imported)
    held = rows.where("row = 'edge'").select("source", "target", "relation", F.lit(True).alias("resolved"), F.lit(None).cast("string").alias("reason"))
    sites = rows.where("row = 'site'").select("prefix", "dotted", "ordinal")
    edges = held.unionByName(resolve.call_edges(decided, nodes)).unionByName(resolve.import_edges(sites, prefixes)).unionByName(resolve.inherit_edges(nodes, imported))
    return {"nodes": nodes, "edges": edges, "decided": decided, "collisions": collisions, "failed": rows.where("row in ('failed', 'missing')").select("path", "row", "name")}
