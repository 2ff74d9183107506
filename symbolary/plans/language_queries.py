"""Readers of languages on a small file of each; what they must find is written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolary.extract.engine import extract, graph_of
from symbolary.extract.sample import LANGUAGE_SOURCES, SOURCES

Q: dict = {}
O: dict = {}

#: (row, kind or how it is called, id without the file's or name, bases or text or receiver or module)
FOUND = {
    "go": [
        ('node', 'file', '', ''),
        ('call', '', 'Info', 'lg'),
        ('call', '', 'Start', 'srv'),
        ('call', '', 'helper', ''),
        ('call', 'self', 'listen', ''),
        ('import', '', 'fmt', 'fmt'),
        ('import', '', 'lg', 'app.log'),
        ('node', 'class', 'base', ''),
        ('node', 'class', 'server', 'Base'),
        ('node', 'function', 'helper', ''),
        ('node', 'function', 'main', ''),
        ('node', 'method', 'server_listen', ''),
        ('node', 'method', 'server_start', ''),
        ('node', 'rationale', 'server#doc', 'Server accepts connections.'),
        ('node', 'rationale', 'server_start#doc', 'Start begins serving.'),
        ('site', '', '', 'app.log'),
        ('site', '', '', 'fmt'),
    ],
    "java": [
        ('node', 'file', '', ''),
        ('call', '', 'Store', ''),
        ('call', '', 'load', 'store'),
        ('call', 'own', 'save', 'store'),
        ('call', 'self', 'fill', ''),
        ('call', 'self', 'helper', ''),
        ('import', '', 'List', 'java.util.List.List'),
        ('import', '', 'Store', 'b.Store.Store'),
        ('node', 'class', 'inner', ''),
        ('node', 'class', 'shop', 'Base,Open'),
        ('node', 'method', 'inner_run', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_helper', ''),
        ('node', 'method', 'shop_shop', ''),
        ('node', 'rationale', 'shop#doc', 'Sells things.'),
        ('node', 'rationale', 'shop_fill#doc', 'Fills it.'),
        ('site', '', '', 'b.Store'),
        ('site', '', '', 'java.util.List'),
    ],
    "typescript": [
        ('node', 'file', '', ''),
        ('call', '', 'App', ''),
        ('call', '', 'Store', ''),
        ('call', '', 'b', ''),
        ('call', '', 'f', ''),
        ('call', '', 'test', '(.)'),
        ('call', 'own', 'load', 'store'),
        ('call', 'self', 'go', ''),
        ('import', '', 'Store', 'src.store.Store'),
        ('import', '', 'f', 'src.store.find'),
        ('import', '', 'path', 'path'),
        ('node', 'class', 'app', 'Base,Runs'),
        ('node', 'class', 'id', ''),
        ('node', 'class', 'runs', ''),
        ('node', 'function', 'helper', ''),
        ('node', 'function', 'make', ''),
        ('node', 'method', 'app_constructor', ''),
        ('node', 'method', 'app_go', ''),
        ('node', 'method', 'app_run', ''),
        ('node', 'method', 'runs_run', ''),
        ('node', 'rationale', 'app#doc', 'An app.'),
        ('site', '', '', 'path'),
        ('site', '', '', 'src.store'),
    ],
    "javascript": [
        ('node', 'file', '', ''),
        ('call', '', 'Node', ''),
        ('call', '', 'load', ''),
        ('call', '', 'put', ''),
        ('call', '', 'require', ''),
        ('call', 'own', 'push', 'root'),
        ('call', 'self', 'walk', ''),
        ('import', '', 'fs', 'fs'),
        ('import', '', 'load', 'lib.io.load'),
        ('import', '', 'put', 'lib.io.save'),
        ('node', 'class', 'tree', 'Node'),
        ('node', 'function', 'go', ''),
        ('node', 'function', 'parse', ''),
        ('node', 'method', 'tree_add', ''),
        ('node', 'method', 'tree_constructor', ''),
        ('node', 'method', 'tree_size', ''),
        ('node', 'method', 'tree_walk', ''),
        ('node', 'rationale', 'parse#doc', 'Parses.'),
        ('site', '', '', 'fs'),
        ('site', '', '', 'lib.io'),
    ],
    "csharp": [
        ('node', 'file', '', ''),
        ('call', '', 'Load', 'store'),
        ('call', '', 'Load', 'x'),
        ('call', '', 'Store', ''),
        ('call', 'own', 'Save', 'store'),
        ('call', 'self', 'Fill', ''),
        ('call', 'self', 'Helper', ''),
        ('import', '', 'L', 'App.Logging'),
        ('node', 'class', 'shop', 'Base,IOpen'),
        ('node', 'method', 'shop_count', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_helper', ''),
        ('node', 'method', 'shop_shop', ''),
        ('node', 'rationale', 'shop#doc', 'Sells things.'),
        ('site', '', '', 'App.Logging'),
        ('site', '', '', 'System'),
    ],
    "rust": [
        ('node', 'file', '', ''),
        ('call', '', 'helper', ''),
        ('call', '', 'load', 'x'),
        ('call', '', 'look', ''),
        ('call', '', 'new', 'Store'),
        ('call', 'own', 'load', 'store'),
        ('call', 'self', 'fill', ''),
        ('import', '', 'Store', 'src.store.Store'),
        ('import', '', 'look', 'src.store.find'),
        ('node', 'class', 'open', ''),
        ('node', 'class', 'shop', 'Open'),
        ('node', 'function', 'helper', ''),
        ('node', 'function', 'mk', ''),
        ('node', 'method', 'open_open', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_new', ''),
        ('node', 'method', 'shop_open', ''),
        ('node', 'rationale', '#doc', 'The crate.'),
        ('node', 'rationale', 'shop#doc', 'A shop.'),
        ('node', 'rationale', 'shop_new#doc', 'Makes one.'),
        ('site', '', '', 'src.store'),
    ],
    "php": [
        ('node', 'file', '', ''),
        ('call', '', 'Store', ''),
        ('call', '', 'helper', ''),
        ('call', '', 'write', 'W'),
        ('call', 'own', 'load', 'store'),
        ('call', 'self', 'fill', ''),
        ('import', '', 'Store', 'App.Store'),
        ('import', '', 'W', 'App.Log.Writer'),
        ('node', 'class', 'shop', 'Base,Open,Loads'),
        ('node', 'function', 'helper', ''),
        ('node', 'method', 'shop___construct', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'rationale', 'shop#doc', 'Sells.'),
        ('site', '', '', 'App.Log.Writer'),
        ('site', '', '', 'App.Store'),
    ],
    "swift": [
        ('node', 'file', '', ''),
        ('call', '', 'Store', ''),
        ('call', '', 'init', 'super'),
        ('call', '', 'load', 'store'),
        ('call', '', 'load', 'x'),
        ('call', 'own', 'save', 'store'),
        ('call', 'self', 'fill', ''),
        ('import', '', 'Foundation', 'Foundation'),
        ('node', 'class', 'open', ''),
        ('node', 'class', 'shop', 'Base,Open,Closed'),
        ('node', 'function', 'helper', ''),
        ('node', 'method', 'open_open', ''),
        ('node', 'method', 'shop_close', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_init', ''),
        ('node', 'rationale', 'shop#doc', 'Sells.'),
        ('site', '', '', 'Foundation'),
    ],
    "kotlin": [
        ('node', 'file', '', ''),
        ('call', '', 'Shop', ''),
        ('call', '', 'Store', ''),
        ('call', '', 'helper', ''),
        ('call', '', 'load', 'store'),
        ('call', '', 'look', ''),
        ('call', 'self', 'load', ''),
        ('import', '', 'Store', 'b.Store'),
        ('import', '', 'look', 'c.find'),
        ('node', 'class', 'one', ''),
        ('node', 'class', 'shop', 'Base,Open'),
        ('node', 'function', 'helper', ''),
        ('node', 'method', 'one_go', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_make', ''),
        ('node', 'method', 'shop_one', ''),
        ('node', 'method', 'store_twice', ''),
        ('node', 'rationale', 'shop#doc', 'Sells.'),
        ('site', '', '', 'b.Store'),
        ('site', '', '', 'c.find'),
    ],
    "c": [
        ('node', 'file', '', ''),
        ('call', '', 'f', '(l.head)'),
        ('call', '', 'printf', ''),
        ('call', '', 'push', ''),
        ('node', 'class', 'list', ''),
        ('node', 'class', 'node_t', ''),
        ('node', 'function', 'add', ''),
        ('node', 'function', 'push', ''),
        ('node', 'rationale', 'add#doc', 'Adds.'),
        ('node', 'rationale', 'node_t#doc', 'A list.'),
        ('site', '', '', 'list.h'),
        ('site', '', '', 'stdio.h'),
    ],
    "cpp": [
        ('node', 'file', '', ''),
        ('call', '', 'helper', ''),
        ('call', '', 'size', 'store'),
        ('call', 'own', 'load', 'store'),
        ('call', 'self', 'fill', ''),
        ('node', 'class', 'shop', 'Base,Open'),
        ('node', 'function', 'helper', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_shop', ''),
        ('node', 'method', 'shop_size', ''),
        ('node', 'method', 'shop_~shop', ''),
        ('node', 'rationale', 'shop#doc', 'Sells.'),
        ('site', '', '', 'src.shop.hpp'),
    ],
    "ruby": [
        ('node', 'file', '', ''),
        ('call', '', 'Shop', ''),
        ('call', '', 'Store', ''),
        ('call', '', 'each', 'n'),
        ('call', 'own', 'load', 'store'),
        ('call', 'self', 'add', ''),
        ('call', 'self', 'fill', ''),
        ('call', 'self', 'helper', ''),
        ('node', 'class', 'shop', 'Base,Open'),
        ('node', 'function', 'helper', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_initialize', ''),
        ('node', 'method', 'shop_make', ''),
        ('node', 'method', 'shop_name', ''),
        ('node', 'method', 'shop_ok?', ''),
        ('node', 'rationale', 'shop#doc', 'Sells things.'),
        ('node', 'rationale', 'shop_fill#doc', 'Fills.'),
        ('site', '', '', 'json'),
        ('site', '', '', 'lib.store'),
    ],
    "lua": [
        ('node', 'file', '', ''),
        ('call', '', 'helper', ''),
        ('call', '', 'load', 'store'),
        ('call', 'self', 'add', ''),
        ('import', '', 'store', 'app.store'),
        ('node', 'class', 'shop', ''),
        ('node', 'function', 'go', ''),
        ('node', 'function', 'helper', ''),
        ('node', 'method', 'shop_add', ''),
        ('node', 'method', 'shop_fill', ''),
        ('node', 'method', 'shop_new', ''),
        ('node', 'rationale', 'shop_new#doc', 'Makes one.'),
        ('site', '', '', 'app.store'),
    ],
    "bash": [
        ('node', 'file', '', ''),
        ('call', '', 'cat', ''),
        ('call', '', 'log', ''),
        ('call', '', 'start', ''),
        ('call', '', 'stop', ''),
        ('node', 'function', 'start', ''),
        ('node', 'function', 'stop', ''),
        ('node', 'rationale', 'start#doc', 'Starts it.'),
        ('site', '', '', 'lib.log'),
        ('site', '', '', 'util'),
    ],
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _files(spark, languages):
    return spark.createDataFrame([LANGUAGE_SOURCES[x] for x in languages], "path string, source string")


def _extract(language: str):
    def run(spark, d):
        rows = extract(_files(spark, [language])).where("row in ('node', 'call', 'site', 'import')")
        mine = F.regexp_replace(F.expr("substr(id, length(prefix) + 1)"), "^_", "")
        how = F.when(F.col("row") == "node", F.col("kind")).when(F.col("on_self"), "self").when(F.col("receiver_is_self"), "own").otherwise("")
        name = F.when(F.col("row") == "node", mine).otherwise(F.coalesce("name", F.lit("")))
        more = F.when(F.col("kind") == "rationale", F.col("text")).when(F.col("row") == "node", F.coalesce(F.array_join("bases", ","), F.lit(""))).when(F.col("row") == "call", F.coalesce("receiver", F.lit(""))).otherwise(F.col("dotted"))
        return rows.select("row", how.alias("how"), name.alias("name"), more.alias("more")).distinct()

    return run


for _language, _rows in FOUND.items():
    Q[f"extract_{_language}"] = _extract(_language)
    O[f"extract_{_language}"] = f'select * from (values {_values(_rows)}) t("row", how, name, more)'

#: Resolved edges of all files together, without containment and docs.
EDGES: list[tuple] = [
    ('a_shop_shop', 'inherits', 'srv_base', 'base class in corpus'),
    ('a_shop_shop_fill', 'calls', 'a_shop_shop_helper', 'self-method'),
    ('a_shop_shop_shop', 'calls', 'a_shop_shop_fill', 'self-method'),
    ('lib_shop_shop', 'inherits', 'srv_base', 'base class in corpus'),
    ('lib_shop_shop_initialize', 'calls', 'lib_shop_shop_fill', 'self-method'),
    ('lib_shop_shop_make', 'calls', 'lib_shop_shop', 'same file'),
    ('lib_util_tree_add', 'calls', 'lib_util_tree_walk', 'self-method'),
    ('list_c_add', 'calls', 'list_c_push', 'same file'),
    ('run', 'calls', 'run_start', 'same file'),
    ('run_start', 'calls', 'run_stop', 'same file'),
    ('shop_go', 'calls', 'shop_helper', 'same file'),
    ('shop_shop', 'inherits', 'srv_base', 'base class in corpus'),
    ('shop_shop_count', 'calls', 'shop_shop_helper', 'self-method'),
    ('shop_shop_fill', 'calls', 'shop_helper', 'same file'),
    ('shop_shop_fill', 'calls', 'shop_shop_add', 'self-method'),
    ('shop_shop_make', 'calls', 'shop_shop', 'same file'),
    ('shop_shop_one', 'calls', 'shop_helper', 'same file'),
    ('shop_shop_shop', 'calls', 'shop_shop_fill', 'self-method'),
    ('src_app_app', 'inherits', 'src_app_runs', 'base class in corpus'),
    ('src_app_app', 'inherits', 'srv_base', 'base class in corpus'),
    ('src_app_app_run', 'calls', 'src_app_app_go', 'self-method'),
    ('src_app_make', 'calls', 'src_app_app', 'same file'),
    ('src_lib_shop', 'inherits', 'src_lib_open', 'base class in corpus'),
    ('src_lib_shop_fill', 'calls', 'src_lib_helper', 'same file'),
    ('src_lib_shop_open', 'calls', 'src_lib_shop_fill', 'self-method'),
    ('src_shop_cpp_shop', 'inherits', 'srv_base', 'base class in corpus'),
    ('src_shop_cpp_shop_fill', 'calls', 'src_shop_cpp_helper', 'same file'),
    ('src_shop_cpp_shop_shop', 'calls', 'src_shop_cpp_shop_fill', 'self-method'),
    ('src_shop_shop', 'inherits', 'srv_base', 'base class in corpus'),
    ('src_shop_shop___construct', 'calls', 'src_shop_shop_fill', 'self-method'),
    ('src_shop_shop_fill', 'calls', 'src_shop_helper', 'same file'),
    ('srv_main', 'calls', 'srv_helper', 'same file'),
    ('srv_main', 'calls', 'srv_server_start', 'receiver-typed'),
    ('srv_server', 'inherits', 'srv_base', 'base class in corpus'),
    ('srv_server_start', 'calls', 'srv_server_listen', 'self-method'),
]


def language_edges(spark, d):
    """All languages in one corpus, from files to resolved edges."""
    edges = graph_of(_files(spark, sorted(LANGUAGE_SOURCES)))["edges"].where("resolved and relation in ('calls', 'inherits', 'imports')")
    return edges.select("source", "relation", "target", F.coalesce("reason", F.lit("")).alias("reason"))


Q["language_edges"] = language_edges
O["language_edges"] = f"select * from (values {_values(EDGES)}) t(source, relation, target, reason)"


#: The resolver's whole cascade on the Python files of the small corpus: caller, name, target, reason.
CALLS: list[tuple] = [
    ('shop_basket_basket', 'check', '', 'not defined in this corpus (builtin or third party)'),
    ('shop_basket_basket___init__', 'Store', 'shop_store_store', 'imported'),
    ('shop_basket_basket___init__', 'fill', 'shop_basket_basket_fill', 'self-method'),
    ('shop_basket_basket_fill', 'find', 'shop_store_find', 'imported'),
    ('shop_basket_basket_fill', 'len', '', 'python builtin'),
    ('shop_basket_basket_fill', 'load', '', 'receiver type unknown'),
    ('shop_basket_basket_fill', 'load', 'shop_store_store_load', 'self-attribute-typed'),
    ('shop_store_find', 'Store', 'shop_store_store', 'same file'),
    ('shop_store_find', 'dumps', '', 'receiver type unknown'),
    ('shop_store_find', 'load', 'shop_store_store_load', 'receiver-typed'),
    ('shop_store_store_load', 'helper', 'shop_store_helper', 'same file'),
]


def python_calls(spark, d):
    """Every rule of the cascade: of self, of an attribute of self, of a receiver, of an import, of the interpreter, of the corpus."""
    files = spark.createDataFrame(sorted(SOURCES.items()), "path string, source string")
    return graph_of(files)["decided"].select("caller", "name", F.coalesce("target", F.lit("")).alias("target"), "reason")


Q["python_calls"] = python_calls
O["python_calls"] = f"select * from (values {_values(CALLS)}) t(caller, name, target, reason)"
