"""Operators on fixtures, order independence, and what SQL can't express."""

import json
import os
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from symbolary.extract.engine import extract, graph_of, languages
from symbolary.extract.sample import SOURCES
from symbolary.functions import ids, names
from symbolary.operators import documents, graph, render
from symbolary.sources import files, snapshot


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_words_of_names(spark):
    cases = {"classify_file": "classify file", "NewClient": "new client", "HTTPServer": "http server", "ABcDe": "a bc de", "v2": "v 2", "naïve_größe": "na ve gr e", "中文": "中文", "": ""}
    got = frame(spark, [(k,) for k in cases], "t string").select("t", F.array_join(names.words(F.col("t")), " ").alias("w")).collect()
    assert {r.t: r.w for r in got} == cases


@pytest.mark.parametrize(("word", "want"), [("classified", "classify"), ("queries", "query"), ("matching", "match"), ("used", "used"), ("boxes", "boxe"), ("bats", "bats"), ("rings", "ring")])
def test_stem(spark, word, want):
    row = frame(spark, [(word,)], "t string").select(names.stem(F.col("t")).alias("s"), names.forms(F.col("t")).alias("f")).first()
    assert row.s == want
    assert sorted(row.f) == names.spellings(word)


def test_prefixes(spark):
    paths = [("a/_B_/c.test.ts", "a_b_c.test", "a_b_c.test_ts"), ("x.py", "x", "x_py"), ("d/.env", "d_.env", "d_.env")]
    got = frame(spark, [(p,) for p, _, _ in paths], "p string").select(ids.file_prefix(F.col("p")), ids.file_prefix(F.col("p"), True)).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, a, b in paths]


def test_extract_and_resolve(spark):
    out = graph_of(frame(spark, list(SOURCES.items()), "path string, source string"))
    edges = {(r.source, r.relation, r.target, r.resolved) for r in out["edges"].collect()}
    assert ("shop_basket", "imports", "shop_store", True) in edges
    assert ("shop_basket_basket", "inherits", "shop_store_base", True) in edges
    decided = {(r.caller, r.name, r.receiver if "receiver" in r else None): (r.target, r.reason) for r in out["decided"].withColumn("receiver", F.lit(None)).collect()}
    assert decided[("shop_basket_basket___init__", "fill", None)] == ("shop_basket_basket_fill", "self-method")
    assert decided[("shop_basket_basket_fill", "find", None)] == ("shop_store_find", "imported")
    assert decided[("shop_store_find", "load", None)] == ("shop_store_store_load", "receiver-typed")
    assert decided[("shop_basket_basket_fill", "len", None)][1] == "python builtin"
    assert {(r.path, r.row) for r in out["failed"].collect()} == {("bad.py", "failed"), ("main.zig", "missing")}
    labels = [r.label for r in out["nodes"].where("kind = 'method'").collect()]
    assert labels.count("size") == 1  # a setter is no second symbol


def test_extract_without_files(spark):
    assert extract(frame(spark, [], "path string, source string")).count() == 0
    assert languages(spark).where("missing is not null").isEmpty() and languages(spark).select("language").distinct().count() == 15


def test_code_scan(spark):
    kept = ["a/b.py", "x.TS", "src/c.h"]
    gone = ["node_modules/a.py", ".hidden/b.py", "types.d.ts", "a/readme.md", "py"]
    got = files.code_paths(frame(spark, [(p,) for p in kept + gone], "path string")).collect()
    assert sorted(r.path for r in got) == sorted(kept)


def test_neighbourhood_stops_at_hubs(spark):
    e = [("a", "hub", "calls", True), *((f"x{i}", "hub", "calls", True) for i in range(50)), ("x1", "far", "calls", True), ("a", "?gone", "calls", False)]
    random.Random(1).shuffle(e)
    got = graph.neighbourhood(frame(spark, e, "source string, target string, relation string, resolved boolean"), frame(spark, [("a",)], "id string"), 3)
    assert {(r.id, r.level, r.hub) for r in got.collect()} == {("a", 0, False), ("hub", 1, True)}


def test_communities_follow_cliques_and_order_does_not_matter(spark):
    groups = [[f"{g}{i}" for i in range(6)] for g in "ab"]
    e = [(x, y, "calls", True) for g in groups for x in g for y in g if x < y] + [("a0", "b0", "calls", True)]
    n = frame(spark, [(x, x, "function", "f", 1) for g in groups for x in g] + [("z", "z", "function", "f", 1)], "id string, label string, kind string, file string, line int")
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(e)
        got = graph.communities(n, frame(spark, e, "source string, target string, relation string, resolved boolean").repartition(3), resolution=1.0)
        results.append({r.id: r.group for r in got.collect()})
    assert results[0] == results[1] == {x: k for k, g in enumerate(groups) for x in g}


def test_sections():
    text = "intro " * 10 + "\n# One\n" + "body of one " * 5 + "\n```\n# no heading here, only a comment of code in an example\n```\n## Two\nshort\n# Three\n" + "\n\n".join("para " * 60 for _ in range(12))
    got = documents.split_sections(text, ".md")
    assert [t for t, _, _ in got][:2] == ["", "One"] and {t for t, _, _ in got[2:]} == {"Three"} and len(got) > 4
    # the rule under a title stays with its body
    assert documents.split_sections("Title\n=====\n" + "x" * 50, ".rst") == [("Title", "=====\n" + "x" * 50, 1)]
    assert documents.split_sections("", ".txt") == []


def test_budget_skips_and_goes_on(spark):
    got = render.within_budget(frame(spark, [(1, 1, 50), (1, 2, 60), (1, 3, 40)], "r int, o int, c int"), "r", "o", "c", 100)
    assert {(r.o, r.kept) for r in got.collect()} == {(1, True), (2, False), (3, True)}


def test_snapshot_round_trip(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build one first"):
        snapshot.read(spark, str(tmp_path / "none"))
    snapshot.write({"nodes": frame(spark, [("a",)], "id string")}, str(tmp_path / "s"))
    snapshot.write({"nodes": frame(spark, [("b",)], "id string")}, str(tmp_path / "s"))
    assert [r.id for r in snapshot.read(spark, str(tmp_path / "s"))["nodes"].collect()] == ["b"]


def test_rows_only_queries(spark):
    from symbolary.plans import catalog

    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_build_save_open_and_ask(spark, tmp_path):
    from symbolary.session import Map, read_prose

    root = tmp_path / "corpus"
    for path, source in {**SOURCES, "README.md": "# Baskets\n" + "A basket holds things that a store has. " * 4, "docs/x.txt": "short"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)
    Map.build(spark, str(root)).save(str(tmp_path / "map"))
    m = Map.open(spark, str(tmp_path / "map"))
    assert [r.id for r in m.ask("where is the basket class").orderBy("rank").collect()][0] == "shop_basket_basket"
    assert "Basket [shop/basket.py:L5]" in m.answer("basket") and m.answer("zzz") == "nothing matches"
    assert "basket" in {r.word for r in m.vocabulary(words=True).collect()}
    groups, gods = m.overview()
    assert groups.count() > 0 and gods.count() > 0
    sections, outcome = read_prose(spark, str(root))
    assert {(r.path, r.outcome) for r in outcome.collect()} == {("README.md", "read")} and sections.first().title == "Baskets"


def test_streams(spark, tmp_path):
    from symbolary.streaming.windows import hourly, keep_extracted, latest

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.select("event_id", "ts", "event_type", "value").write.parquet(src)
    stream = hourly(spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(src))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(events).collect()))
    changes = str(tmp_path / "changes")
    for source in ("def a(): pass", "def b(): pass"):
        frame(spark, [("m.py", source)], "path string, source string").write.mode("append").parquet(changes)
        keep_extracted(spark.readStream.schema("path string, source string").parquet(changes), out, str(tmp_path / "cp")).awaitTermination(60)
    assert {r.label for r in latest(spark.read.parquet(out)).where("row = 'node' and kind = 'function'").collect()} == {"b"}


def test_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    for pipeline in (False, True):
        if pipeline:
            shutil.copy(root / "corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'match_topk' in q and 'pipeline' not in q and set(o) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_deep(spark, tmp_path):
    from symbolary.session import Map

    built = Map.of(frame(spark, [("app/store.py", "class Store:\n    def load_all(self):\n        pass\n")], "path string, source string"), grouped=False)
    sections = frame(spark, [("README.md", 0, "Loading", "Call `load_all()` on a Store to read what is there, as often as you like.", 3), ("README.md", 1, "Other", "nothing of the kind", 9)], "path string, section_no int, title string, text string, line int")
    ask, answer = tmp_path / "ask.md", tmp_path / "answer.json"
    same, why = built.deep(sections, str(answer), str(ask))
    assert same is built and "no answer" in why and "### README.md#L3" in ask.read_text() and "L9" not in ask.read_text()
    digest = re.search(r'"ask": "([0-9a-f]{16})"', ask.read_text())[1]
    answer.write_text("{")
    assert "no valid JSON" in built.deep(sections, str(answer), str(ask))[1]
    answer.write_text(json.dumps({"ask": "other", "picks": {}}))
    assert "other questions" in built.deep(sections, str(answer), str(ask))[1]
    answer.write_text(json.dumps({"ask": digest, "picks": {"README.md#L3": ["app_store_store_load_all", "nowhere", 5]}}))
    deep, told = built.deep(sections, str(answer), str(ask))
    assert told == "1 id not on the candidate list, 1 pick was not an id"
    assert {(r.source, r.target) for r in deep.edges.where("relation = 'describes'").collect()} == {("readme.md#document#L3", "app_store_store_load_all")}
    assert "load_all [app/store.py:L2]" in deep.answer("how does load all work") and "described in" in deep.answer("how does load all work")


def test_out_path(tmp_path):
    from symbolary.sources.asks import out_path

    assert out_path("/corpus", None, "/here") == "/here/symbolary-out/map" and out_path("/corpus", "/else/x") == "/else/x"
    with pytest.raises(ValueError):
        out_path(str(tmp_path), str(tmp_path / "map"))


def test_menus_grow_with_documents_and_parts_not_with_their_product(spark, tmp_path):
    import duckdb
    from conftest import SF, TABLES, rows

    from symbolary.plans import prose_queries as q

    for t in set(TABLES) - {"documents"}:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.range(3000).selectExpr("id as doc_id", "'some words' as text", "'en' as lang", "'web' as source", "10L as n_chars")
    docs.union(docs.limit(5)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert 0 < q._mentioned(spark, str(tmp_path)).count() <= 4 * parts
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}')")
    got = rows(q.Q["candidate_menu"](spark, str(tmp_path)).toPandas())
    assert len(got[1]) > 3000 and got == rows(c.sql(q.O["candidate_menu"]).df())


def test_dangling_marks_ends_without_comparing_edges(spark):
    n = frame(spark, [(x, x, "function", "f", 1) for x in "abb"], "id string, label string, kind string, file string, line int")
    e = [("a", "b", "calls", True), ("a", "x", "calls", True), ("a", "x", "calls", True), ("y", "b", "calls", True), (None, "b", "calls", True), ("a", "z", "calls", False)]
    got = graph.dangling(n, frame(spark, e, "source string, target string, relation string, resolved boolean"))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in frame(spark, [x[:3] for x in (e[1], e[2], e[3], e[4])], "source string, target string, relation string").collect())
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("make", ["edges", "_sites", "_by_nation"])
def test_partitions_grow_with_the_tables(spark, monkeypatch, make):
    from conftest import SF

    from symbolary.plans import graph_queries
    from symbolary.sources import shared

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        getattr(graph_queries, make)(spark, SF)
        assert {k: spark.conf.get(k) for k in names} == before  # small tables ask for nothing
        monkeypatch.setattr(shared, "PARTITION_BYTES", 5000)
        getattr(graph_queries, make)(spark, SF)
        assert int(spark.conf.get(names[0])) >= 20 and shared._bytes_of(spark.conf.get(names[1])) == shared.TASK_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [shared._bytes_of(x) for x in ("64MB", "8m", "1g", "5000", "5000b")] == [64 << 20, 8 << 20, 1 << 30, 5000, 5000]
