"""DuckDB macros' worth of text: the name functions as SQL expressions, for oracles."""

from __future__ import annotations

from symbolary.functions.names import TEST_MARKS


def words(x: str) -> str:
    """The words of a name of ASCII letters, digits and others."""
    cut = f"regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform(regexp_extract_all({cut}, '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), lambda w: lower(w))"


def stem(w: str) -> str:
    return (
        f"case when length({w}) > 4 and ({w} like '%ies' or {w} like '%ied') then {w}[:-4] || 'y'"
        f" when {w} like '%ing' and length({w}) >= 7 then {w}[:-4] when {w} like '%ed' and length({w}) >= 6 then {w}[:-3]"
        f" when {w} like '%es' and length({w}) >= 6 then {w}[:-3] when {w} like '%s' and length({w}) >= 5 then {w}[:-2] else {w} end"
    )


def forms(w: str) -> str:
    return f"list_distinct([{w}, {stem(w)}, case when length({w}) > 3 and {w} like '%s' then {w}[:-2] else {w} end])"


def all_forms(x: str) -> str:
    return f"list_distinct(flatten(list_transform({words(x)}, lambda q: {forms('q')})))"


def is_test(path: str, label: str) -> str:
    marks = " or ".join(f"contains(lower({path}), '{m}')" for m in TEST_MARKS)
    return f"({marks} or starts_with(lower({path}), 'test') or starts_with({label}, 'Test') or starts_with({label}, 'test_'))"


def search_rows(nodes: str = "nodes", prose: str = "''") -> str:
    return f"""
rows as (select id, lower(label) as label, {all_forms("label")} as name_forms, lower(file) as path, {all_forms("file")} as path_forms, {all_forms(prose)} as doc_forms,
                kind, {is_test("file", "label")} as is_test, length(label) as label_len from {nodes} where kind not in ('rationale', 'claim', 'document'))"""


def match(terms: list[tuple[str, list[str]]], kind: str | None) -> str:
    """CTEs up to `ranked` (rank within all answers; nth of a name) for terms with their spellings."""
    counts, each, tier, more, matched = [], [], [], [], []
    for i, (_, said) in enumerate(terms):
        lits = "[" + ", ".join(f"'{s}'" for s in said) + "]"
        within = "(" + " or ".join(f"contains(label, '{s}')" for s in said) + ")"
        starts = "(" + " or ".join(f"starts_with(label, '{s}')" for s in said) + ")"
        inpath = "(" + " or ".join(f"contains(path, '{s}')" for s in said) + ")"
        exact, token, doc = f"list_contains({lits}, label)", f"list_has_any(name_forms, {lits})", f"list_has_any(doc_forms, {lits})"
        counts.append(f"ln(1 + count(*) / (1 + count(*) filter (where {token} or {within}))) as w{i}")
        tier.append(f"w{i} * case when {exact} then 1000.0 when {token} then 300.0 when {starts} then 100.0 when {within} then 0.0 when {doc} then 20.0 else 0.0 end")
        more.append(f"w{i} * (case when not {exact} and not {token} and not {starts} and {within} then 1.0 else 0.0 end + case when list_has_any(path_forms, {lits}) or {inpath} then 0.5 else 0.0 end)")
        matched.append(f"({exact} or {token} or {within} or {doc})::integer")
    bonus = f"case when kind = '{kind}' then 150.0 else 0.0 end" if kind else "0.0"
    return f"""
weights as (select {", ".join(counts)} from rows),
sums as (select rows.*, greatest(1, len(name_forms)) as n_words, {" + ".join(tier)} as tiered, {" + ".join(more)} as more, ({" + ".join(matched)}) / {float(len(terms))} as share from rows, weights),
scored as (select id, label, kind, label_len, round((tiered / sqrt(n_words) * share * share + more + {bonus}) * case when is_test then 0.05 else 1.0 end, 6) as score from sums),
nth as (select s.id, label, score, label_len, coalesce(degree, 0) as degree, row_number() over (partition by label order by score desc, coalesce(degree, 0) desc, label_len, s.id) as nth
        from scored s left join degree using (id) where score > 0),
ranked as (select (row_number() over (order by score desc, degree desc, label_len, id))::integer as rank, id, label, score from nth where nth <= 2)"""
