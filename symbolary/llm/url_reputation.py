"""URL filter: rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted by host. The share of bad pages of a host is shrunk through
beta-binomial priors: the host's prior has the mean of its registered domain (here the last two names of a host, as
there is no list of public suffixes), whose prior has the mean of its suffix (the last name), whose prior has the mean
of all. The strength of each level's prior comes from the spread of the shares at that level beyond what counting
explains (method of moments). A url is blocked if the lower bound of the host's posterior (mean less Z standard
deviations) is above LIMIT; else it is allowed. Hosts without labelled pages have the posterior of the next level.

Counts are pre-aggregated by host before anything is joined; urls meet reputations in a join by host that adaptive
execution may broadcast or split. Null urls and urls without :// have an empty host and path. Null outcomes and
repeated ids count once for each row. Empty tables give empty results; without outcomes every url that no rule fits is
allowed. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.sources.tables import table

Z, LIMIT = 1.645, 0.5
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

#: (verdict, rule); a rule is a host with a path behind it. A list like this is part of the plan: hundreds, not millions.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits (ties: the smaller text), or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, under = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{under}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _level(counts: DataFrame, key: str, parents: DataFrame | None, parent_key: str | None) -> DataFrame:
    """key, mean, pages (prior strength and counts) of each value; counts: key, n, bad (and the parent's key)."""
    share = F.col("bad") / F.col("n")
    whole = counts.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("p"), F.sum("n").alias("all"), F.count("*").alias("groups"))
    spread = counts.join(F.broadcast(whole)).groupBy("p", "all", "groups").agg(F.sum(F.col("n") * (share - F.col("p")) ** 2).alias("ss"))
    noise = F.col("p") * (1 - F.col("p"))
    between = F.greatest(F.lit(1e-9), F.col("ss") / F.col("all") - noise * F.col("groups") / F.col("all"))
    strength = spread.select("p", F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), noise / between - 1)).alias("k"))
    joined = counts.join(F.broadcast(strength))
    if parents is not None:
        joined = joined.join(parents.select(F.col(parent_key).alias("__p"), F.col("mean").alias("up")), joined[parent_key] == F.col("__p")).drop("__p")
    up = F.col("up") if parents is not None else F.col("p")
    return joined.select(key, *([parent_key] if parent_key else []), ((F.col("k") * up + F.col("bad")) / (F.col("k") + F.col("n"))).alias("mean"), (F.col("k") + F.col("n")).alias("pages"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host, mean, pages), (domain, ...), (suffix, ...) from outcomes: host, bad (0 or 1)."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = outcomes.where("bad is not null and host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = _level(suffixes, "suffix", None, None)
    by_domain = _level(domains, "domain", by_suffix, "suffix")
    return _level(hosts, "host", by_domain, "domain").drop("domain"), by_domain.drop("suffix"), by_suffix


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict: one row for each page. outcomes: host, bad."""
    host, path = host_and_path(pages[url_col])
    urls = pages.select(pages[id_col], host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    domain, suffix = domain_and_suffix(F.col("host"))
    urls = urls.withColumns({"rule": rule, "by_rule": verdict, "__domain": domain, "__suffix": suffix})
    levels = reputations(outcomes)
    for key, own, level in zip(("host", "__domain", "__suffix"), ("host", "domain", "suffix"), levels, strict=True):
        named = level.select(F.col(own).alias(f"k_{own}"), F.struct("mean", "pages").alias(f"p_{own}"))
        urls = urls.join(named, urls[key] == named[f"k_{own}"], "left")
    best = reduce(lambda a, b: F.coalesce(a, b), (F.col("p_host"), F.col("p_domain"), F.col("p_suffix")))
    mean, n = best["mean"], best["pages"]
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (n + 1))
    method = F.when(bound > LIMIT, "block").otherwise("allow")
    return urls.select(id_col, "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; a page with a quality label of its number is an outcome, bad where the label is 0."""
    pages = table(spark, sf_dir, "pages")
    host, _ = host_and_path(pages["url"])
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").select(F.col("doc_id").alias("__id"), (1 - F.col("quality")).cast("long").alias("bad"))
    known = pages.select("page_id", host.alias("host"))
    return judge(pages, known.join(labels, known.page_id == labels["__id"]).select("host", "bad"))


def _level_sql(name: str, counts: str, key: str, up: str) -> str:
    return f"""
w_{name} as (select coalesce(sum(bad) / sum(n), 0.0) as p, sum(n) as total, count(*) as groups from {counts}),
k_{name} as (select p, least({STRONGEST}, greatest({WEAKEST}, p * (1 - p) / greatest(1e-9, ss / total - p * (1 - p) * groups / total) - 1)) as k
             from (select p, total, groups, sum(n * (bad / n - p) * (bad / n - p)) as ss from {counts}, w_{name} group by all)),
r_{name} as (select c.{key}, (k * {up} + bad) / (k + n) as mean, k + n as pages from {counts} c, k_{name} {"" if name == "suffix" else f"join r_{'suffix' if name == 'domain' else 'domain'} u on u.{'suffix' if name == 'domain' else 'domain'} = c.{'suffix' if name == 'domain' else 'domain'}"})"""


def _rules_sql() -> str:
    return ", ".join(f"('{what}', '{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')" for what, text in RULES)


ORACLE = f"""
with raw as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut as (select page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) as h from raw),
u as (select page_id, translate(h, '{_UPPER}', '{_LOWER}') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) as path from cut),
d as (select *, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix from u),
rules(what, rule, own, under) as (values {_rules_sql()}),
fit as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(what, length(rule)) as what from d, rules
        where (host = own or ends_with(host, '.' || own)) and starts_with(path, under) group by 1),
hosts as (select host, domain, suffix, count(*)::double as n, sum(1 - quality)::double as bad from d join labels on page_id = doc_id where quality in (0, 1) group by all),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by all),
{_level_sql("suffix", "suffixes", "suffix", "p")},
{_level_sql("domain", "domains", "domain", "u.mean")},
{_level_sql("host", "hosts", "host", "u.mean")},
best as (select d.page_id, coalesce(a.mean, b.mean, c.mean) as m, coalesce(a.pages, b.pages, c.pages) as n
         from d left join r_host a using (host) left join r_domain b using (domain) left join r_suffix c using (suffix))
select d.page_id, host, path, rule, coalesce(what, case when m - {Z} * sqrt(m * (1 - m) / (n + 1)) > {LIMIT} then 'block' else 'allow' end) as verdict
from d join best using (page_id) left join fit using (page_id)
"""

QUERIES = {"op1_url_reputation": op1_url_reputation}
ORACLES = {"op1_url_reputation": ORACLE}
