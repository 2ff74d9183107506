"""Main text of web pages: landmarks first, a host suffix array where a page has none.

A page is cut into blocks by its tags. Elements that are menus, headers outside the article, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments, by tag, role, class or id, are left out with all that they
hold. If there is an article (or a main element), its blocks are the text.

Other pages go to the suffix array of their host: the token streams of the host's pages are concatenated, their suffixes
are sorted by their first RUN tokens, neighbours in that order that agree and lie on pages of different token streams
are repeated substrings, and the tokens that these cover are boilerplate; the unique runs remain. Blocks keep their
order. The array is distributed: suffixes meet by host and first RUN tokens in an aggregate with map-side combining, so
a host of any size is sorted as one, a hot host is many suffixes that go to all tasks, and no group of pages or suffixes
is ever gathered. Only repeated suffixes come back to their pages. (Removing repeated substrings from articles too would
drop sentences that articles share, which are text; so the array decides only where structure doesn't.)

Character references are decoded after markup is cut; white space in a block becomes one space, blocks are trimmed and
joined by one space. Null and empty pages have an empty text. Elements left open by a truncated page end with it.
Repeated rows and pages with the same token stream don't count as distinct pages. A page is held whole by one task,
however long it is. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from symbolary.llm.common import hashes_of, shingle_hashes, small_batches
from symbolary.llm.url_reputation import host_and_path
from symbolary.sources.shared import cut
from symbolary.sources.tables import table

#: Tokens of a substring whose repetition on another page of the host is boilerplate.
RUN = 16

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "title"}
_DROP = _RAW | {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_AWAY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|comments?|comment-?list|disqus|replies|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|site-header|page-header|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|social|share|sharing|related|recommended|widget|pagination|pager|skip-link)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}


def _away(name: str, attributes: str, inside: bool) -> bool:
    if name in _DROP:
        return True
    if name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "article", "main") and not re.search("comment", attributes, re.I):
        return False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key == "role":
            if value.strip().lower() in _ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden":
            if key == "hidden" or value.strip().lower() == "true":
                return True
        elif _AWAY.search(value):
            return True
    return False


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The decoded blocks of a page that aren't left out, of its articles if there is one, and whether there is one."""
    page = page or ""
    stack: list[tuple[str, bool, bool]] = []  # name, whether it is left out, whether it is an article
    everything: list[str] = []
    article: list[str] = []
    now: list[str] = []
    away = inside = 0
    landmark = False
    at = 0

    def close() -> None:
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            now.clear()
            if text:
                everything.append(text)
                if inside:
                    article.append(text)

    def pop(n: int) -> None:
        nonlocal away, inside
        while len(stack) > n:
            _, left, is_article = stack.pop()
            away -= left
            inside -= is_article

    while True:
        m = _TAG.search(page, at)
        if not away and (piece := page[at : m.start() if m else len(page)]):
            now.append(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE and not away:
            close()
        if m[1]:
            if (k := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)) is not None:
                pop(k)
        elif name not in _VOID and not m[3].endswith("/"):
            if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
            left, is_article = _away(name, m[3], inside > 0), name in ("article", "main") or 'role="main"' in m[3]
            if left and not away and name in _INLINE:
                close()
            is_article = is_article and not left and not away
            landmark |= is_article
            stack.append((name, left, is_article))
            away += left
            inside += is_article
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                pop(len(stack) - 1)
    close()
    return (article if landmark else everything), landmark


def suffixes(page: str | None) -> tuple[list[str], np.ndarray]:
    """The tokens of a page's blocks, and the hash of the first RUN tokens of each suffix that has so many."""
    tokens = [w for b in blocks(page)[0] for w in b.split(" ")]
    hashes = hashes_of(" ".join(tokens))
    return tokens, shingle_hashes(hashes, RUN) if len(tokens) >= RUN else hashes[:0]


def covered(n: int, at: list[int]) -> np.ndarray:
    """Whether each of n tokens lies in a suffix's first RUN tokens, of suffixes that begin at these places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.array(at, np.int64), 1)
    np.add.at(steps, np.array(at, np.int64) + RUN, -1)
    return np.cumsum(steps)[:n] > 0


def _mapped(rows: DataFrame, schema: T.StructType, one) -> DataFrame:
    """Rows of `schema` that one(row as dict of scalars) gives for each row."""

    def run(batches):
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in one(row)]
            yield pa.RecordBatch.from_pylist(out, schema=kinds) if out else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in kinds], schema=kinds)

    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    return rows.mapInArrow(run, schema)


def _unique_runs(pages: DataFrame, schema: T.StructType) -> DataFrame:
    """id, url, text of pages without landmarks (id, url, host, html), by the suffix array of each host."""
    keyed = pages.withColumn("page", F.xxhash64("html"))
    each = keyed.select("host", "page", "html").dropDuplicates(["host", "page"])
    fields = [T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("stream", T.LongType()), T.StructField("run", T.LongType()), T.StructField("at", T.IntegerType())]

    def begin(row):
        tokens, runs = suffixes(row["html"])
        stream = xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")) - (1 << 63)
        return ({"host": row["host"], "page": row["page"], "stream": stream, "run": r, "at": k} for k, r in enumerate(runs.view(np.int64).tolist()))

    array = cut(_mapped(each, T.StructType(fields), begin))
    several = array.groupBy(F.col("host").alias("h"), F.col("run").alias("r")).agg(F.min("stream").alias("first"), F.max("stream").alias("last")).where("first <> last")
    gone = array.join(several, (array.host == several.h) & (array.run == several.r), "left_semi").groupBy(F.col("host").alias("h"), F.col("page").alias("p")).agg(F.collect_list("at").alias("at"))
    held = keyed.join(gone, (keyed.host == gone.h) & (keyed.page == gone.p), "left").select("id", "url", "html", "at")

    def rest(row):
        tokens, _ = suffixes(row["html"])
        kept = np.array(tokens, dtype=object)[~covered(len(tokens), row["at"] or [])]
        return ({"id": row["id"], "url": row["url"], "text": " ".join(kept)},)

    return _mapped(held, schema, rest)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars: one row for each page."""
    small_batches(pages.sparkSession, 512)
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType())])
    host, _ = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), host.alias("host"), pages[html_col].alias("html"))

    def structured(row):
        found, landmark = blocks(row["html"])
        return ({"id": row["id"], "url": row["url"], "text": " ".join(found)},) if landmark or not found else ()

    def plain(row):
        found, landmark = blocks(row["html"])
        return (row,) if found and not landmark else ()

    # pages without a landmark are told by their structure, not by their text; they are kept, as three steps read them
    others = cut(_mapped(rows, rows.schema, plain))
    found = _mapped(rows.select("id", "url", "html"), schema, structured).unionByName(_unique_runs(others, schema))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
