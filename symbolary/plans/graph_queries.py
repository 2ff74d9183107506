"""Queries of the graph, vocabulary, search and rendering operators over the driver's graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolary.functions import ids, names
from symbolary.operators import components, graph, render, resolve, search
from symbolary.plans import sql
from symbolary.plans.driver_graph import EDGES_SQL, NODES_SQL, WITH, edges, nodes
from symbolary.sources.shared import enough_partitions
from symbolary.sources.tables import table

ASKED, ASKED_KIND, ASKED_PATH = "which parts are small rings", "how are large boxes used by the method", "customers 00000012 in nation 5"

Q: dict = {}
O: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        Q[name] = f
        if oracle is not None:
            O[name] = oracle
        return f

    return put


# identity


@query("ids_file_prefix", "select p_partkey, lower('src') || '_' || lower(trim(p_type, '_')) || '_' || lower(trim(p_brand, '_')) || '_' || lower(trim(replace(p_name, ' ', '.'), '_')) || '_py' as kept, "
       "lower('src') || '_' || lower(trim(p_type, '_')) || '_' || lower(trim(p_brand, '_')) || '_' || lower(trim(replace(p_name, ' ', '.'), '_')) as prefix from part")  # fmt: skip
def _(spark, d):
    path = F.concat_ws("/", F.lit("_Src"), "p_type", "p_brand", F.concat(F.translate("p_name", " ", "."), F.lit(".py")))
    return table(spark, d, "part").select("p_partkey", ids.file_prefix(path, True).alias("kept"), ids.file_prefix(path).alias("prefix"))


@query("ids_mint", "select p_partkey, lower(p_brand) || '_' || lower(p_type) || '_' || lower(p_name) as id, lower(p_brand) || '#document#L' || p_size as claim from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.mint(F.lower("p_brand"), F.col("p_name"), F.array("p_type")).alias("id"), ids.claim_id(F.col("p_brand"), F.col("p_size")).alias("claim"))


@query("collisions", "with n as (select lower(p_name) as name, p_brand || ':L' || p_partkey as place from part) select name, count(*) as n, string_agg(place, ',' order by place) as places from n group by 1 having count(*) > 1")
def _(spark, d):
    rows = nodes(spark, d).where("kind = 'method'").withColumn("name", F.lower("label"))
    return graph.collisions(rows, "name")


@query("node_union", f"with {NODES_SQL} select kind, count(*) as n, count(distinct id) as ids, min(label) as first_label, max(line) as last_line from nodes group by 1")
def _(spark, d):
    return nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("label").alias("first_label"), F.max("line").alias("last_line"))


@query("edge_union", f"{WITH} select relation, resolved, count(*) as n from edges group by all")
def _(spark, d):
    return edges(spark, d).groupBy("relation", "resolved").agg(F.count("*").alias("n"))


# resolution

_SYMBOLS_SQL = "symbols as (select 'p_' || p_partkey as id, p_name || ' ' || p_size as label, 'function' as kind, p_brand as prefix from part)"
_CALLS_SQL = "sites as (select distinct 's_' || l_suppkey as caller, p_brand as prefix, p_name || ' ' || l_quantity::integer as name from lineitem join part on l_partkey = p_partkey)"


def _symbols(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("p_"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_size").alias("label"), F.lit("function").alias("kind"), F.col("p_brand").alias("prefix"))


def _sites(spark, d):
    enough_partitions(table(spark, d, "lineitem"))
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("int").alias("q")).distinct()
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("s_"), "l_suppkey").alias("caller"), F.col("p_brand").alias("prefix"), F.concat_ws(" ", "p_name", "q").alias("name")).distinct()


_DECIDED_SQL = f"""{_SYMBOLS_SQL}, {_CALLS_SQL},
loc as (select prefix, label as name, count(*) as n_here, min(id) as here from symbols group by all),
far as (select label as name, count(*) as n_far, min(id) as far from symbols group by all),
decided as (select caller, prefix, name, case when n_here = 1 then here when n_here > 1 then null when n_far = 1 then far end as target,
  case when n_here = 1 then 'same file' when n_here > 1 then 'name defined in ' || n_here || ' scopes of this file, cannot choose' when n_far = 1 then 'unique in corpus'
       when n_far > 1 then 'name defined in ' || n_far || ' places, cannot choose' else 'not defined in this corpus (builtin or third party)' end as reason
  from sites left join loc using (prefix, name) left join far using (name))"""


@query("resolve_calls", f"with {_DECIDED_SQL} select caller, prefix, name, target, reason, target is not null as resolved from decided")
def _(spark, d):
    return resolve.resolve_bare(_sites(spark, d), _symbols(spark, d))


@query("refusals_by_reason", f"with {_DECIDED_SQL} select reason, count(*) as n from decided where target is null group by 1")
def _(spark, d):
    return resolve.refusals(resolve.resolve_bare(_sites(spark, d), _symbols(spark, d)))


@query("call_edges", f"with {_DECIDED_SQL} select caller as source, target, 'calls' as relation, true as resolved, min(reason) as reason from decided where target is not null and caller <> target group by caller, target "
       "union all select caller, '?' || name, 'calls', false, reason from decided where target is null and name in (select label from symbols)")  # fmt: skip
def _(spark, d):
    return resolve.call_edges(resolve.resolve_bare(_sites(spark, d), _symbols(spark, d)), _symbols(spark, d))


@query("symbols_label_index", f"with {_SYMBOLS_SQL} select prefix, label, count(*) as n, min(id) as id from symbols group by all")
def _(spark, d):
    return resolve.symbol_tables(_symbols(spark, d))["local"]


@query("class_unique_home", "select p_name || ' ' || p_size as label, min(p_brand) as prefix from part group by 1 having count(distinct p_brand) = 1")
def _(spark, d):
    return resolve.symbol_tables(_symbols(spark, d).withColumn("kind", F.lit("class")))["homes"]


_SUFFIX_SQL = """
site as (select distinct 'pkg.' || lower(p_type) || '.' || replace(p_name, ' ', '.') as dotted from part),
files as (select distinct replace(p_name, ' ', '_') as prefix from part where p_partkey % 3 = 0 union select distinct split_part(p_name, ' ', 2) from part where p_partkey % 5 = 0),
tails as (select dotted, i, array_to_string(string_split(dotted, '.')[i:], '_') as tail from site, (select unnest(range(1, 9)) as i) where i <= len(string_split(dotted, '.')))"""


def _import_sites(spark, d):
    part = table(spark, d, "part")
    sites = part.select(F.concat_ws(".", F.lit("pkg"), F.lower("p_type"), F.translate("p_name", " ", ".")).alias("dotted")).distinct()
    files = part.where("p_partkey % 3 = 0").select(F.translate("p_name", " ", "_").alias("prefix")).union(part.where("p_partkey % 5 = 0").select(F.split("p_name", " ")[1].alias("prefix"))).distinct()
    return sites, files


@query("suffix_match_module", f"with {_SUFFIX_SQL} select dotted as site, arg_min(tail, i) as prefix from tails join files on tail = prefix group by 1")
def _(spark, d):
    sites, files = _import_sites(spark, d)
    return resolve.suffix_match(sites.withColumn("site", F.col("dotted")), files)


@query("import_edges", f"""with {_SUFFIX_SQL}, found as (select dotted, arg_min(tail, i) as home from tails join files on tail = prefix group by 1),
  uses as (select distinct lower(p_brand) as prefix, 'pkg.' || lower(p_type) || '.' || replace(p_name, ' ', '.') as dotted from part)
  select prefix as source, coalesce(home, '?' || dotted) as target, 'imports' as relation, home is not null as resolved,
         case when home is null then 'module outside this corpus (stdlib or third party)' else 'module in corpus' end as reason
  from uses left join found using (dotted) group by all""")  # fmt: skip
def _(spark, d):
    _, files = _import_sites(spark, d)
    sites = table(spark, d, "part").select(F.lower("p_brand").alias("prefix"), F.concat_ws(".", F.lit("pkg"), F.lower("p_type"), F.translate("p_name", " ", ".")).alias("dotted"), F.col("p_partkey").alias("ordinal"))
    return resolve.import_edges(sites, files)


@query("inherit_edges", """with c as (select 'p_' || p_partkey as id, p_brand as prefix, split_part(p_name, ' ', 1) || (p_partkey % 90) as label, [split_part(p_name, ' ', 2) || (p_partkey % 13), split_part(p_name, ' ', 1) || (p_size % 90)] as bases from part),
  wanted as (select distinct id, prefix, unnest(bases) as base from c), here as (select prefix, label as base, min(id) as here from c group by all),
  homes as (select label as base, min(prefix) as home from c group by 1 having count(distinct prefix) = 1), far as (select base, min(id) as far from homes join c on label = base and prefix = home group by 1)
  select id as source, coalesce(here, far, '?' || base) as target, 'inherits' as relation, coalesce(here, far) is not null as resolved,
         case when coalesce(here, far) is null then 'base class outside this corpus (builtin or third party)' else 'base class in corpus' end as reason
  from wanted left join here using (prefix, base) left join far using (base) where coalesce(here, far) is null or coalesce(here, far) <> id""")  # fmt: skip
def _(spark, d):
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    rows = table(spark, d, "part").select(
        F.concat(F.lit("p_"), "p_partkey").alias("id"), F.col("p_brand").alias("prefix"), F.concat(first, F.col("p_partkey") % 90).alias("label"), F.lit("class").alias("kind"),
        F.array(F.concat(second, F.col("p_partkey") % 13), F.concat(first, F.col("p_size") % 90)).alias("bases"),
    )
    return resolve.inherit_edges(rows)


@query("var_type_first_write", """with w as (select user_id % 50 as prefix, event_type as scope, 'v' || (event_id % 3) as var, 'C' || cast(floor(value) as integer) % 7 as cls, event_id as ordinal from events),
  s as (select prefix, scope, var, min(ordinal) as f, arg_max(cls, ordinal) as cls from w group by all) select prefix, var, arg_min(cls, f) as cls from s group by all""")  # fmt: skip
def _(spark, d):
    writes = table(spark, d, "events").select((F.col("user_id") % 50).alias("prefix"), F.col("event_type").alias("scope"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("var"), F.concat(F.lit("C"), F.floor("value").cast("int") % 7).alias("cls"), F.col("event_id").alias("ordinal"))
    return resolve.variable_types(writes)


# graph


@query("dangling_edges", f"{WITH}, kept as (select * from edges where not (target like 'p_%' and substr(target, 3)::bigint % 50 = 0)) "
       "select count(*) as n, count(distinct target) as targets from edges where resolved and target like 'p_%' and substr(target, 3)::bigint % 50 = 0")  # fmt: skip
def _(spark, d):
    kept = nodes(spark, d).where("not (kind = 'method' and line % 50 = 0)")
    return graph.dangling(kept, edges(spark, d)).agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


@query("degrees", f"{WITH} select id, degree from degree")
def _(spark, d):
    return graph.degrees(edges(spark, d))


@query("degrees_in_nodes", f"{WITH} select id, degree from degree where id in (select id from nodes where line % 2 = 0)")
def _(spark, d):
    return graph.degrees_in(nodes(spark, d).where("line % 2 = 0"), edges(spark, d))


_PAIRS_SQL = """pairs as (select least(source, target) as a, greatest(source, target) as b, count(*) as weight from edges where resolved and source <> target
  and source in (select id from nodes) and target in (select id from nodes) group by all)"""


@query("weighted_projection", f"{WITH}, {_PAIRS_SQL} select a, b, weight from pairs")
def _(spark, d):
    return graph.weighted(nodes(spark, d), edges(spark, d))


@query("neighbour_degree", f"{WITH}, {_PAIRS_SQL} select id, count(*) as neighbours from (select a as id from pairs union all select b from pairs) group by 1")
def _(spark, d):
    return graph.neighbour_degrees(nodes(spark, d), edges(spark, d))


@query("god_nodes", f"{WITH} select nodes.id, label, file, line, degree as connections from nodes join degree using (id) where kind <> 'file' order by degree desc, id limit 15")
def _(spark, d):
    return graph.god_nodes(nodes(spark, d), edges(spark, d))


@query("connected_components", "select c_custkey as vertex, c_custkey // 8 * 8 as root from customer union all select o_orderkey + 1000000000, o_custkey // 8 * 8 from orders")
def _(spark, d):
    # orders hang on their customer, and customers on the one before, in chains of eight
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    chain = c.where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - 1).alias("b"))
    loops = c.select(F.col("c_custkey").alias("a"), F.col("c_custkey").alias("b"))
    linked = components.components(chain.unionByName(o.select((F.col("o_orderkey") + 1_000_000_000).alias("a"), F.col("o_custkey").alias("b"))), "a", "b")
    return linked.unionByName(loops.select(F.col("a").alias("vertex"), F.col("b").alias("root")).join(linked.select("vertex"), "vertex", "left_anti"))


def _by_nation(spark, d):
    """Suppliers and customers grouped by nation, with the pairs of those that sell and buy the same order."""
    enough_partitions(table(spark, d, "lineitem"), table(spark, d, "orders"))
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    member = c.select(F.concat(F.lit("c_"), "c_custkey").alias("id"), F.col("c_nationkey").alias("group")).union(s.select(F.concat(F.lit("s_"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("group")))
    sold = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = sold.groupBy(F.concat(F.lit("c_"), "o_custkey").alias("a"), F.concat(F.lit("s_"), "l_suppkey").alias("b")).agg(F.count("*").alias("weight"))
    return member, pairs


@query("modularity", """with m as (select 'c_' || c_custkey as id, c_nationkey as g from customer union all select 's_' || s_suppkey, s_nationkey from supplier),
  p as (select 'c_' || o_custkey as a, 's_' || l_suppkey as b, count(*) as weight from lineitem join orders on l_orderkey = o_orderkey group by all),
  x as (select weight, x.g as ga, y.g as gb from p join m x on x.id = a join m y on y.id = b), t as (select sum(weight)::double as w, (sum(weight) filter (where ga = gb))::double as inside from x),
  s as (select sum(dd * dd)::double as dd from (select sum(weight)::double as dd from (select ga as g, weight from x union all select gb, weight from x) group by g))
  select round(inside / w - 0.4 * dd / (4 * w * w), 6) as modularity from t, s""")  # fmt: skip
def _(spark, d):
    member, pairs = _by_nation(spark, d)
    return graph.modularity(pairs, member)


@query("group_naming", f"""{WITH}, {_PAIRS_SQL}, nb as (select id, count(*) as neighbours from (select a as id from pairs union all select b from pairs) group by 1),
  mem as (select id, line % 40 as g from nodes), real as (select nodes.*, mem.g, coalesce(neighbours, 0) as deg, case when kind = 'class' then 2 else 1 end as nameability from nodes join mem using (id) left join nb using (id)),
  folders as (select g, file, count(*) as n from real group by all), f as (select g, sum(n)::bigint as size, first(file order by n desc, file) as top, max(n) as most from folders group by 1),
  h as (select g, first(label order by kind <> 'file' desc, nameability desc, deg desc, id desc) as hub from real group by 1)
  select g as "group", case when most >= 0.4 * size then top || ' · ' || hub else hub end as name, case when most >= 0.4 * size then top else '' end as named_folder, size, hub from f join h using (g)""")  # fmt: skip
def _(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return graph.summarise_groups(n.withColumn("folder", F.col("file")), n.select("id", (F.col("line") % 40).alias("group")), graph.neighbour_degrees(n, e))


_REACH_SQL = f"""{WITH}, both_ as (select source as u, target as v from edges where resolved union all select target, source from edges where resolved),
  l1 as (select distinct v as id from both_ where u in ('p_7', 'p_21') except select unnest(['p_7', 'p_21'])),
  open1 as (select id from l1 join degree using (id) where degree <= 40),
  l2 as (select distinct v as id from both_ join open1 on u = id except (select id from l1 union select unnest(['p_7', 'p_21'])))
  select id, 0 as level, false as hub from (select unnest(['p_7', 'p_21']) as id) union all select id, 1, degree > 40 from l1 join degree using (id) union all select id, 2, degree > 40 from l2 join degree using (id)"""


@query("neighbourhood_depth2", _REACH_SQL)
def _(spark, d):
    seeds = spark.sql("select * from values ('p_7'), ('p_21') as t(id)")
    return graph.neighbourhood(edges(spark, d), seeds)


@query("communities")
def _(spark, d):
    n = nodes(spark, d).where("kind <> 'method'")
    member, pairs = _by_nation(spark, d)
    sold = pairs.where("weight > 1").select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("calls").alias("relation"), F.lit(True).alias("resolved"))
    return graph.communities(n, sold.unionByName(edges(spark, d).where("relation = 'contains'")))


@query("build_report", f"{WITH} select 'kind' as what, kind as value, count(*) as n from nodes group by 2 union all select 'relation', relation, count(*) from edges group by 2 union all select 'resolved', cast(resolved as varchar), count(*) from edges group by 2")
def _(spark, d):
    from symbolary.operators.metrics import build_report

    return build_report(nodes(spark, d), edges(spark, d))


# vocabulary and search


@query("words", f"select p_partkey, array_to_string({sql.words('''replace(p_brand, '#', '_') || p_name || 'HTTPServerV2 ' || p_type''')}, ' ') as words from part")
def _(spark, d):
    text = F.concat(F.translate("p_brand", "#", "_"), "p_name", F.lit("HTTPServerV2 "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(names.words(text), " ").alias("words"))


_WORDS_SQL = "w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents)"


@query("stem_forms", f"with {_WORDS_SQL} select word, {sql.stem('word')} as stem, array_to_string(list_sort({sql.forms('word')}), ' ') as forms from w where length(word) between 3 and 12")
def _(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct().where(F.length("word").between(3, 12))
    return found.select("word", names.stem(F.col("word")).alias("stem"), F.array_join(F.array_sort(names.forms(F.col("word"))), " ").alias("forms"))


@query("word_vocabulary", f"with {NODES_SQL} select distinct word from (select unnest({sql.words('label')}) as word from nodes) where length(word) between 3 and 30")
def _(spark, d):
    return search.word_vocabulary(nodes(spark, d))


@query("ranked_names", f"{WITH} select label, max(coalesce(degree, 0)) as degree from nodes left join degree using (id) group by 1")
def _(spark, d):
    return search.ranked_names(nodes(spark, d), edges(spark, d))


@query("vocab_contains", f"{WITH} select label, max(coalesce(degree, 0)) as degree from nodes left join degree using (id) where contains(lower(label), 'ring') group by 1 order by degree desc, label limit 60")
def _(spark, d):
    found = search.ranked_names(nodes(spark, d), edges(spark, d)).where(F.contains(F.lower("label"), F.lit("ring")))
    return found.orderBy(F.desc("degree"), "label").limit(60)


@query("prose_for", "select 'p_' || (doc_id % 200) as id, string_agg(text, ' ' order by doc_id) as prose from documents group by 1")
def _(spark, d):
    docs = table(spark, d, "documents")
    texts = docs.select(F.concat(F.lit("d_"), "doc_id").alias("id"), "text")
    said = docs.select(F.concat(F.lit("p_"), F.col("doc_id") % 200).alias("source"), F.concat(F.lit("d_"), "doc_id").alias("target"), F.lit("rationale_for").alias("relation"), F.col("doc_id").alias("ordinal"))
    return search.prose_for(texts, said)


@query("search_rows", f"with {NODES_SQL}, {sql.search_rows()} select id, label, array_to_string(list_sort(name_forms), ' ') as name_forms, path, array_to_string(list_sort(path_forms), ' ') as path_forms, is_test, greatest(1, len(name_forms))::integer as n_words, label_len::integer as label_len from rows")
def _(spark, d):
    rows = search.search_rows(nodes(spark, d))
    joined = {c: F.array_join(F.array_sort(c), " ") for c in ("name_forms", "path_forms")}
    return rows.withColumns(joined).select("id", "label", "name_forms", "path", "path_forms", "is_test", "n_words", "label_len")


def _terms(asked: str):
    found, kind = names.question(asked)
    return [(t, names.spellings(t)) for t in found], kind


def _match_sql(asked: str, source: str = "nodes", extra: str = "") -> str:
    terms, kind = _terms(asked)
    return f"{WITH}{extra}, {sql.search_rows(source)}, {sql.match(terms, kind)}"


@query("match_topk", _match_sql(ASKED) + " select * from ranked where rank <= 6")
def _(spark, d):
    return search.ranked(search.search_rows(nodes(spark, d)), edges(spark, d), ASKED)


@query("match_with_kind", _match_sql(ASKED_KIND) + " select * from ranked where rank <= 12")
def _(spark, d):
    return search.ranked(search.search_rows(nodes(spark, d)), edges(spark, d), ASKED_KIND, limit=12)


@query("match_path", _match_sql(ASKED_PATH) + " select * from ranked where rank <= 20")
def _(spark, d):
    return search.ranked(search.search_rows(nodes(spark, d)), edges(spark, d), ASKED_PATH, limit=20)


_TESTS_SQL = ", tests as (select id, label, kind, case when line % 3 = 0 then 'tests/' || file else file end as file, line from nodes)"


@query("match_test_demoted", _match_sql(ASKED, "tests", _TESTS_SQL) + " select * from ranked where rank <= 40")
def _(spark, d):
    n = nodes(spark, d).withColumn("file", F.when(F.col("line") % 3 == 0, F.concat(F.lit("tests/"), "file")).otherwise(F.col("file")))
    return search.ranked(search.search_rows(n), edges(spark, d), ASKED, limit=40)


@query("match_more", _match_sql(ASKED) + " select count(*) as scored, greatest(0, count(*) - 6) as more from scored where score > 0")
def _(spark, d):
    return search.more(search.search_rows(nodes(spark, d)), ASKED)


@query("idf", f"with {NODES_SQL}, {sql.search_rows()}, n as (select count(*) as n from rows) select term, count(*) filter (where list_has_any(name_forms, said) or contains(label, said[1]) or contains(label, said[2])) as seen, "
       "round(ln(1 + any_value(n) / (1 + count(*) filter (where list_has_any(name_forms, said) or contains(label, said[1]) or contains(label, said[2])))), 6) as weight "
       "from rows, n, (values ('rings', ['ring', 'rings']), ('box', ['box', 'box']), ('zebra', ['zebra', 'zebra'])) t(term, said) group by 1")  # fmt: skip
def _(spark, d):
    return search.idf(search.search_rows(nodes(spark, d)), ["rings", "box", "zebra"]).select("term", "seen", F.round("weight", 6).alias("weight"))


# rendering

_LINKS_SQL = f"""{WITH}, links as (select distinct * from (select source as id, relation, target as other from edges union all
    select target, case relation when 'contains' then 'part of' else 'called by' end, source from edges) where id in ('n_3', 'c_11', 's_4', 'p_40')),
  ln as (select links.*, coalesce(n.label, other) as label, coalesce(degree, 0) as deg from links left join nodes n on n.id = other left join degree dg on dg.id = other),
  rk as (select id, relation, other, label, row_number() over (partition by id order by case relation when 'calls' then 2 when 'called by' then 3 when 'part of' then 6 else 7 end, starts_with(label, '__'), starts_with(label, '_'), deg desc, label, other) as rank from ln)"""


def _ranked_links(spark, d):
    seeds = spark.sql("select * from values ('n_3'), ('c_11'), ('s_4'), ('p_40') as t(id)")
    e = edges(spark, d)
    return render.interest(e, seeds, nodes(spark, d), graph.degrees(e))


@query("link_interest_topn", f"{_LINKS_SQL} select id, relation, other, label, rank::integer as rank from rk where rank <= 10")
def _(spark, d):
    return _ranked_links(spark, d).where("rank <= 10")


@query("hidden_links", f"{_LINKS_SQL} select id, count(*) filter (where rank <= 10) as shown, count(*) filter (where rank > 10) as hidden from rk group by 1")
def _(spark, d):
    return render.capped(_ranked_links(spark, d))


@query("provenance_tags", "select l_orderkey, l_linenumber, '[' || case when l_returnflag = 'R' then 'doc ' else '' end || l_shipinstr || ':L' || l_linenumber || case when l_linestatus = 'F' then '' else ' unresolved: ' || l_returnflag end || ']' as tag "
       "from (select *, 'f' || l_suppkey as l_shipinstr from lineitem)")  # fmt: skip
def _(spark, d):
    origin = F.when(F.col("l_returnflag") == "R", "doc").otherwise("ast")
    tag = render.provenance(F.concat(F.lit("f"), "l_suppkey"), F.col("l_linenumber"), origin, F.col("l_linestatus") == "F", F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tag.alias("tag"))


@query("token_budget_greedy", """with recursive b as (select user_id % 40 as request, event_id as "order", greatest(1, floor(length(props || event_type) * (event_id % 7 + 1) / 4))::bigint as cost, row_number() over (partition by user_id % 40 order by event_id) as rn from events),
  f as (select request, "order", rn, case when cost <= 300 then cost else 0 end as spent, cost <= 300 as kept from b where rn = 1
        union all select b.request, b."order", b.rn, spent + case when spent + cost <= 300 then cost else 0 end, spent + cost <= 300 from f join b on b.request = f.request and b.rn = f.rn + 1)
  select request, "order", kept from f""")  # fmt: skip
def _(spark, d):
    text = F.length(F.concat("props", "event_type")) * (F.col("event_id") % 7 + 1)
    blocks = table(spark, d, "events").select((F.col("user_id") % 40).alias("request"), F.col("event_id").alias("order"), F.greatest(F.lit(1), F.floor(text / 4)).alias("cost"))
    return render.within_budget(blocks, "request", "order", "cost", 300)
