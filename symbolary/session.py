"""A built map of a corpus, and questions to it; every answer is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.extract.engine import graph_of
from symbolary.functions.names import tokens
from symbolary.operators import attach, documents, graph, metrics, render, search
from symbolary.sources import files, snapshot
from symbolary.sources.shared import cut


@dataclass
class Map:
    """nodes, edges, membership (id, group) and failed files of a corpus."""

    nodes: DataFrame
    edges: DataFrame
    member: DataFrame
    failed: DataFrame

    @classmethod
    def build(cls, spark: SparkSession, root: str, grouped: bool = True) -> Map:
        """Scan, parse, resolve and group the code under a folder."""
        return cls.of(files.code_paths(files.scan(spark, root)), grouped)

    @classmethod
    def of(cls, sources: DataFrame, grouped: bool = True) -> Map:
        """The same from rows (path, source)."""
        g = graph_of(sources)
        spark = sources.sparkSession
        # questions read these again and again, and what made them is a long plan
        nodes, edges = cut(g["nodes"]), cut(g["edges"])
        member = graph.communities(nodes, edges) if grouped else spark.createDataFrame([], "id string, group int")
        return cls(nodes, edges, member, g["failed"])

    @classmethod
    def open(cls, spark: SparkSession, out: str) -> Map:
        t = snapshot.read(spark, out)
        return cls(t["nodes"], t["edges"], t["member"], t["failed"])

    def save(self, out: str) -> None:
        coverage = {"files_parsed": self.nodes.where("kind = 'file'").count(), "unresolved_edges": self.edges.where("not resolved").count()}
        snapshot.write({"nodes": self.nodes, "edges": self.edges, "member": self.member, "failed": self.failed}, out, coverage)

    def ask(self, question: str, seeds: int = 6) -> DataFrame:
        """rank, id, label, score."""
        return search.ranked(search.search_rows(self.nodes, search.prose_for(self.nodes, self._ordered())), self.edges, question, seeds)

    def _ordered(self) -> DataFrame:
        """Edges in the order of the text that they lead to or come from: by file, line and id."""
        if "ordinal" in self.edges.columns:
            return self.edges
        texts = self.nodes.where("text is not null").groupBy(F.col("id").alias("__t")).agg(F.min(F.struct("file", "line", "id")).alias("ordinal"))
        return self.edges.join(texts, F.when(F.col("relation") == "describes", F.col("source")).otherwise(F.col("target")) == F.col("__t"), "left").drop("__t")

    def around(self, question: str, depth: int = 2) -> DataFrame:
        """id, level, hub: what lies near the answers."""
        return graph.neighbourhood(self.edges, self.ask(question), depth)

    def links(self, question: str, per_node: int = 10) -> DataFrame:
        """id, relation, other, label, rank: the answers' links, gaps (?name) among them."""
        return render.interest(self.edges, self.ask(question), self.nodes, graph.degrees(self.edges)).where(F.col("rank") <= per_node)

    def group_names(self) -> DataFrame:
        """id, group_name: the group that is named with a symbol."""
        folder = F.regexp_replace("file", "/?[^/]*$", "")
        groups = graph.summarise_groups(self.nodes.withColumn("folder", folder), self.member, graph.neighbour_degrees(self.nodes, self.edges))
        return render.shown_groups(self.member.join(groups, "group").select("id", "name", "named_folder", "size"), self.nodes)

    def answer(self, question: str, budget: int = 2000, per_node: int = 10) -> str:
        """An answer within a token budget: each symbol with its place and group, what is said of it, and its first links with
        theirs; a block that doesn't fit is passed over. What is collected is bounded by the answer's symbols and links."""
        asked = self.ask(question).collect()
        if not asked:
            return "nothing matches"
        ids = [r.id for r in asked]
        every = render.interest(self.edges, self.ask(question), self.nodes, graph.degrees(self.edges))
        places = self.nodes.groupBy(F.col("id").alias("other")).agg(F.min_by(F.concat("file", F.lit(":L"), "line"), "file").alias("place"), F.min_by("text", "file").alias("text"))
        shown = every.where(F.col("rank") <= per_node).join(places, "other", "left").select("id", "relation", "label", "rank", "place", render.snippet(F.col("text")).alias("said"))
        held: dict[str, list[str]] = {}
        for r in shown.orderBy("id", "rank").collect():
            held.setdefault(r["id"], []).append(f"  {r.relation} {r.label}" + (f" [{r.place}]" if r.place else " [not in this corpus]") + (f": {r.said}" if r.said else ""))
        hidden = {r.id: r.hidden for r in render.capped(every, per_node).where("hidden > 0").collect()}
        groups = {r.id: r.group_name for r in self.group_names().where(F.col("id").isin(ids) & F.col("group_name").isNotNull()).collect()}
        heads = {r.id: f"{r.label} [{r.file}:L{r.line}]" for r in self.nodes.where(F.col("id").isin(ids)).collect()}
        out, spent = [f"{len(asked)} symbols for: {question}"], 0
        for r in asked:
            head = heads.get(r.id, r.label) + (f" in {groups[r.id]}" if r.id in groups else "")
            block = "\n".join([head, *held.get(r.id, []), *([f"  ... {hidden[r.id]} more links"] if r.id in hidden else [])])
            if spent + max(1, len(block) // 4) <= budget:
                out.append(block)
                spent += max(1, len(block) // 4)
        left = len(asked) + 1 - len(out)
        return "\n".join([*out, *([f"({left} more did not fit the budget)"] if left else [])])

    def with_documents(self, chosen: DataFrame, passages: DataFrame) -> Map:
        """The map with the documents and claims that accepted picks (passage, id) add; groups stay as they are.

        passages: id, path, line, title, text. Ids that the map has already are not taken again.
        """
        new_nodes, new_edges = attach.claims(chosen, passages)
        fresh = new_nodes.join(self.nodes.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"])
        added = new_edges.select("source", "target", "relation", F.lit(True).alias("resolved"), F.lit(None).cast("string").alias("reason"))
        return Map(cut(self.nodes.unionByName(fresh, allowMissingColumns=True)), cut(self.edges.unionByName(added, allowMissingColumns=True)), self.member, self.failed)

    def deep(self, sections: DataFrame, answer: str, ask: str) -> tuple[Map, str]:
        """The map with what an answer says about prose sections (path, section_no, title, text, line), and what came of it.

        Without a fitting answer the questionnaire is written to `ask`, and the map stays as it is.
        """
        from symbolary.operators.order import numbered
        from symbolary.sources.asks import load_answer, write_ask

        spark = self.nodes.sparkSession
        rows = sections.withColumn("id", F.concat("path", F.lit("#L"), F.col("line").cast("string")))
        passages = numbered(rows, [F.col("path"), F.col("section_no")], "place").select("id", "place", "path", "line", "title", "text")
        said, index = cut(attach.mentions(passages)), cut(attach.label_index(self.nodes, self.edges))
        menu = cut(attach.menus(said, index))
        blocks = cut(attach.asked(passages, menu, said, index, self.nodes))
        menu = menu.join(blocks.where("kept").select("passage"), "passage", "left_semi")
        digest = attach.digest(menu).first()[0]
        answers, why = load_answer(spark, answer, digest)
        if why:
            return self, f"{why}; {write_ask(blocks, digest, ask)} passages to answer are in {ask}"
        verdicts = attach.judged(menu, answers)
        refused = ", ".join(f"{r.n} {r.verdict}" for r in attach.rejections(verdicts).orderBy("verdict").collect())
        return self.with_documents(attach.accepted(verdicts), passages), refused or "every pick was accepted"

    def vocabulary(self, contains: str = "", limit: int = 60, words: bool = False) -> DataFrame:
        """Words, or names by how connected they are."""
        if words:
            return search.word_vocabulary(self.nodes).where(F.contains("word", F.lit(contains.lower()))).orderBy("word").limit(limit)
        return search.ranked_names(self.nodes, self.edges).where(F.contains(F.lower("label"), F.lit(contains.lower()))).orderBy(F.desc("degree"), "label").limit(limit)

    def overview(self, top: int = 10) -> tuple[DataFrame, DataFrame]:
        """Groups by size, and the most connected symbols."""
        folder = F.regexp_replace("file", "/?[^/]*$", "")
        groups = graph.summarise_groups(self.nodes.withColumn("folder", folder), self.member, graph.neighbour_degrees(self.nodes, self.edges))
        return groups.orderBy(F.desc("size"), "name").limit(top), graph.god_nodes(self.nodes, self.edges)

    def report(self) -> DataFrame:
        return metrics.build_report(self.nodes, self.edges)


def read_prose(spark: SparkSession, root: str, budget: int = documents.PROSE_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Sections, and what was read or passed over, of the prose under a folder."""
    every = files.doc_paths(files.scan(spark, root))
    pdf = F.lower("path").endswith(".pdf")
    docs = every.where(~pdf).select("path", F.col("source").alias("text"))
    parts = documents.sections(docs)
    cost = parts.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "text"))), lambda x: x["text"]), "\n").alias("all")).select("path", tokens(F.col("all")).alias("cost"))
    outcome = documents.read_in_order(docs.join(cost, "path").select("path", "cost", documents.fingerprint(F.col("text")).alias("marks")), budget)
    unread = every.where(pdf).select("path", F.lit(0).cast("long").alias("tokens"), F.lit("no reader for PDF is installed").alias("outcome"))
    return parts.join(outcome.where("outcome = 'read'"), "path", "left_semi"), outcome.unionByName(unread)
