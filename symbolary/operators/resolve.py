"""Resolution of calls, imports and bases by joins that record every refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of the interpreter (Python 3.13), written down so that plans agree whichever interpreter runs them.
BUILTINS = tuple(
    """
    ArithmeticError AssertionError AttributeError BaseException BaseExceptionGroup BlockingIOError BrokenPipeError
    BufferError BytesWarning ChildProcessError ConnectionAbortedError ConnectionError ConnectionRefusedError
    ConnectionResetError DeprecationWarning EOFError Ellipsis EncodingWarning EnvironmentError Exception
    ExceptionGroup False FileExistsError FileNotFoundError FloatingPointError FutureWarning GeneratorExit IOError
    ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError
    KeyboardInterrupt LookupError MemoryError ModuleNotFoundError NameError None NotADirectoryError NotImplemented
    NotImplementedError OSError OverflowError PendingDeprecationWarning PermissionError ProcessLookupError
    PythonFinalizationError RecursionError ReferenceError ResourceWarning RuntimeError RuntimeWarning
    StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TabError TimeoutError True
    TypeError UnboundLocalError UnicodeDecodeError UnicodeEncodeError UnicodeError UnicodeTranslateError
    UnicodeWarning UserWarning ValueError Warning ZeroDivisionError abs aiter all anext any ascii bin bool breakpoint
    bytearray bytes callable chr classmethod compile complex copyright credits delattr dict dir divmod enumerate eval
    exec exit filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass
    iter len license list locals map max memoryview min next object oct open ord pow print property quit range repr
    reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip
    """.split()
)
#: Methods of its containers and strings; a call of one that resolves to nothing is not worth a gap.
CONTAINER_METHODS = tuple(
    """
    add append capitalize casefold center clear copy count decode difference difference_update discard encode
    endswith expandtabs extend find format format_map fromhex fromkeys get hex index insert intersection
    intersection_update isalnum isalpha isascii isdecimal isdigit isdisjoint isidentifier islower isnumeric
    isprintable isspace issubset issuperset istitle isupper items join keys ljust lower lstrip maketrans partition
    pop popitem remove removeprefix removesuffix replace reverse rfind rindex rjust rpartition rsplit rstrip
    setdefault sort split splitlines startswith strip swapcase symmetric_difference symmetric_difference_update title
    translate union update upper values zfill
    """.split()
)

NO_METHOD = "called on self, but no such method on the class"
NO_ATTRIBUTE = "receiver is a self attribute of unknown type"
NO_RECEIVER = "receiver type unknown"
NO_TYPED = "receiver typed, but no such method in the corpus"
BUILTIN = "python builtin"
ABSENT = "not defined in this corpus (builtin or third party)"


def symbol_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """Lookups of names, each reduced before it is joined. nodes: id, label, kind, prefix; methods may have an owner."""
    real = nodes.where("kind <> 'rationale'")
    local = real.where("kind in ('function', 'class')").groupBy("prefix", "label").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    corpus = real.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    homes = real.where("kind = 'class'").groupBy("label").agg(F.countDistinct("prefix").alias("n"), F.min("prefix").alias("prefix"))
    return {"local": local, "corpus": corpus, "homes": homes.where("n = 1").select("label", "prefix")}


def suffix_match(sites: DataFrame, files: DataFrame, key: str = "site", dotted: str = "dotted") -> DataFrame:
    """key, prefix: the file that the longest tail of a dotted name stands for. files: prefix.

    Each tail is a row of its own, so the match is an equality join; the longest of a site's tails is an aggregate.
    """
    parts = F.split(dotted, r"[./]")
    tails = sites.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.lower(F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "_")))).alias("pos", "tail"))
    hit = tails.join(files.select(F.col("prefix").alias("tail")).distinct(), "tail")
    return hit.groupBy(key).agg(F.min_by("tail", "pos").alias("prefix"))


def variable_types(writes: DataFrame) -> DataFrame:
    """prefix, var, cls: of the scope that was written first, what was written last. writes: prefix, scope, var, cls, ordinal."""
    by_scope = writes.groupBy("prefix", "scope", "var").agg(F.min("ordinal").alias("first"), F.max_by("cls", "ordinal").alias("cls"))
    return by_scope.groupBy("prefix", "var").agg(F.min_by("cls", "first").alias("cls"))


def resolve_bare(calls: DataFrame, nodes: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """caller, prefix, name, target, reason, resolved of calls by a bare name, in the order: file, import, builtin, corpus.

    calls: caller, prefix, name. imported: prefix, name, id of names that an import of the file binds to a node.
    """
    t = symbol_tables(nodes)
    own = t["local"].select("prefix", F.col("label").alias("name"), F.col("n").alias("n_here"), F.col("id").alias("here"))
    far = t["corpus"].select(F.col("label").alias("name"), F.col("n").alias("n_far"), F.col("id").alias("far"))
    rows = calls.join(own, ["prefix", "name"], "left").join(far, "name", "left")
    rows = rows.join(imported.select("prefix", "name", F.col("id").alias("bound")), ["prefix", "name"], "left") if imported is not None else rows.withColumn("bound", F.lit(None).cast("string"))
    here, away = F.coalesce("n_here", F.lit(0)), F.coalesce("n_far", F.lit(0))
    target = F.when(here == 1, F.col("here")).when(here > 1, None).when(F.col("bound").isNotNull(), F.col("bound")).when(F.col("name").isin(*BUILTINS), None).when(away == 1, F.col("far"))
    places = lambda n, what: F.concat(F.lit("name defined in "), n.cast("string"), F.lit(f" {what}, cannot choose"))
    reason = (
        F.when(here == 1, "same file").when(here > 1, places(here, "scopes of this file")).when(F.col("bound").isNotNull(), "imported").when(F.col("name").isin(*BUILTINS), BUILTIN)
        .when(away == 1, "unique in corpus").when(away > 1, places(away, "places")).otherwise(ABSENT)
    )
    return rows.select("caller", "prefix", "name", target.alias("target"), reason.alias("reason"), target.isNotNull().alias("resolved"))


def resolve_calls(calls: DataFrame, nodes: DataFrame, owners: DataFrame, attributes: DataFrame, variables: DataFrame, imported: DataFrame) -> DataFrame:
    """The whole cascade; the first rule whose guard holds decides, and only an import may fall through.

    calls: caller, prefix, name, receiver, receiver_is_self, on_self, ordinal. owners: id, owner, prefix of methods.
    attributes: prefix, owner, attr, cls. variables: prefix, var, cls.
    """
    methods = nodes.where("kind in ('method', 'function')").join(owners.select("id", "owner"), "id").select("prefix", "owner", F.col("label").alias("name"), "id").groupBy("prefix", "owner", "name").agg(F.min("id").alias("id"))
    homes = symbol_tables(nodes)["homes"]
    typed = methods.join(homes, (methods.owner == homes.label) & (methods.prefix == homes.prefix)).select(F.col("owner").alias("cls"), "name", F.col("id").alias("typed_id"))
    rows = calls.join(owners.select(F.col("id").alias("caller"), "owner"), "caller", "left")
    own = methods.select("prefix", "owner", "name", F.col("id").alias("self_id"))
    rows = rows.join(own, ["prefix", "owner", "name"], "left")
    rows = rows.join(attributes.select("prefix", "owner", F.col("attr").alias("receiver"), F.col("cls").alias("attr_cls")), ["prefix", "owner", "receiver"], "left")
    rows = rows.join(variables.select("prefix", F.col("var").alias("receiver"), F.col("cls").alias("var_cls")), ["prefix", "receiver"], "left")
    rows = rows.withColumn("cls", F.when(F.col("receiver_is_self"), F.col("attr_cls")).otherwise(F.col("var_cls"))).join(typed, ["cls", "name"], "left")
    bare = resolve_bare(rows.where("receiver is null and not on_self").select("caller", "prefix", "name").distinct(), nodes, imported)
    bare = bare.select("caller", "prefix", "name", F.col("target").alias("bare_id"), F.col("reason").alias("bare_reason"))
    rows = rows.join(bare, ["caller", "prefix", "name"], "left")
    target = F.when(F.col("on_self"), F.col("self_id")).when(F.col("receiver").isNotNull(), F.col("typed_id")).otherwise(F.col("bare_id"))
    reason = (
        F.when(F.col("on_self"), F.when(F.col("self_id").isNotNull(), "self-method").otherwise(NO_METHOD))
        .when(F.col("receiver_is_self"), F.when(F.col("typed_id").isNotNull(), "self-attribute-typed").otherwise(NO_ATTRIBUTE))
        .when(F.col("receiver").isNotNull() & F.col("var_cls").isNull(), NO_RECEIVER)
        .when(F.col("receiver").isNotNull(), F.when(F.col("typed_id").isNotNull(), "receiver-typed").otherwise(NO_TYPED))
        .otherwise(F.col("bare_reason"))
    )
    return rows.select("caller", "prefix", "name", "file", "line", "ordinal", target.alias("target"), reason.alias("reason"), target.isNotNull().alias("resolved"))


def call_edges(decided: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, relation, resolved, reason: one edge for a caller and target, and gaps (?name) worth drawing.

    Calls of oneself are no edges. A refused name is drawn if some node has it and it is no method of containers.
    """
    first = decided.where("resolved and caller <> target").groupBy("caller", "target").agg(F.min("reason").alias("reason") if "ordinal" not in decided.columns else F.min_by("reason", "ordinal").alias("reason"))
    known = nodes.where("kind <> 'rationale'").select(F.col("label").alias("name")).distinct()
    gaps = decided.where(~F.col("resolved") & ~F.col("name").isin(*CONTAINER_METHODS)).join(known, "name", "left_semi")
    edge = lambda d, target, resolved: d.select(F.col("caller").alias("source"), target.alias("target"), F.lit("calls").alias("relation"), F.lit(resolved).alias("resolved"), "reason")
    return edge(first, F.col("target"), True).unionByName(edge(gaps, F.concat(F.lit("?"), F.col("name")), False))


def refusals(decided: DataFrame) -> DataFrame:
    """reason, n."""
    return decided.where("not resolved").groupBy("reason").agg(F.count("*").alias("n"))


def import_edges(sites: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, relation, resolved, reason of import sites (prefix, dotted, ordinal); one for each pair, none to oneself."""
    named = sites.groupBy("prefix", "dotted").agg(F.min("ordinal").alias("ordinal"))
    found = suffix_match(named.select("dotted").distinct().withColumn("site", F.col("dotted")), files).select(F.col("site").alias("dotted"), F.col("prefix").alias("home"))
    rows = named.join(found, "dotted", "left").where("home is null or home <> prefix")
    target = F.coalesce("home", F.concat(F.lit("?"), F.col("dotted")))
    reason = F.when(F.col("home").isNotNull(), "module in corpus").otherwise("module outside this corpus (stdlib or third party)")
    return rows.select(F.col("prefix").alias("source"), target.alias("target"), F.lit("imports").alias("relation"), F.col("home").isNotNull().alias("resolved"), reason.alias("reason")).distinct()


def inherit_edges(nodes: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """source, target, relation, resolved, reason of classes' bases: own file, then import, then a single home."""
    classes = nodes.where("kind = 'class'")
    wanted = classes.select("id", "prefix", F.explode("bases").alias("base")).distinct()
    here = classes.groupBy("prefix", F.col("label").alias("base")).agg(F.min("id").alias("here"))
    homes = symbol_tables(nodes)["homes"].withColumnRenamed("label", "base").withColumnRenamed("prefix", "home")
    far = homes.join(classes.select(F.col("label").alias("base"), F.col("prefix").alias("home"), F.col("id").alias("far")), ["base", "home"]).groupBy("base").agg(F.min("far").alias("far"))
    rows = wanted.join(here, ["prefix", "base"], "left").join(far, "base", "left")
    rows = rows.join(imported.select("prefix", F.col("name").alias("base"), F.col("id").alias("bound")), ["prefix", "base"], "left") if imported is not None else rows.withColumn("bound", F.lit(None).cast("string"))
    found = F.coalesce("here", "bound", "far")
    rows = rows.where(found.isNull() | (found != F.col("id")))
    reason = F.when(found.isNotNull(), "base class in corpus").otherwise("base class outside this corpus (builtin or third party)")
    return rows.select(F.col("id").alias("source"), F.coalesce(found, F.concat(F.lit("?"), F.col("base"))).alias("target"), F.lit("inherits").alias("relation"), found.isNotNull().alias("resolved"), reason.alias("reason"))


def imported_names(imports: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """prefix, name, id: imported names (prefix, local, dotted) that are nodes of the module that they come from."""
    named = imports.where("dotted like '%.%' and element_at(split(dotted, '[.]'), -1) = local").withColumn("module", F.regexp_replace("dotted", r"\.[^.]*$", ""))
    homes = suffix_match(named.select("module").distinct().withColumn("site", F.col("module")), files, dotted="module").select(F.col("site").alias("module"), F.col("prefix").alias("home"))
    top = nodes.where("kind in ('function', 'class')").groupBy(F.col("prefix").alias("home"), F.col("label").alias("local")).agg(F.min("id").alias("id"))
    return named.join(homes, "module").join(top, ["home", "local"]).groupBy("prefix", F.col("local").alias("name")).agg(F.min("id").alias("id"))
