"""Graph analytics over nodes (id, label, kind, file, line, ...) and edges (source, target, relation, resolved, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROSE = ("claim", "document", "file", "rationale")
HUB_DEGREE, RESOLUTION = 40, 0.4


def ends(edges: DataFrame) -> DataFrame:
    """id: both ends of every resolved edge."""
    return edges.where("resolved").select(F.explode(F.array("source", "target")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: resolved edges at each end; a loop counts twice."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def degrees_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degrees() of ends that are nodes; the degrees are reduced before they meet the nodes."""
    return degrees(edges).join(nodes.select("id"), "id", "left_semi")


def weighted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, weight: the undirected projection (a < b) of resolved edges between nodes, without loops."""
    pairs = edges.where("resolved and source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("weight"))
    ids = nodes.select("id").distinct()
    return pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def neighbour_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, neighbours: distinct neighbours of each connected node."""
    return weighted(nodes, edges).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("neighbours"))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 15) -> DataFrame:
    """The most connected symbols: id, label, file, line, connections."""
    symbols = nodes.where(~F.col("kind").isin(*PROSE)).select("id", "label", "file", "line")
    return symbols.join(degrees(edges), "id").withColumnRenamed("degree", "connections").orderBy(F.desc("connections"), "id").limit(top)


def collisions(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are claimed more than once, with the places."""
    place = F.concat_ws(":L", "file", F.col("line").cast("string"))
    return nodes.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(place)), ",").alias("places")).where("n > 1")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolved edges (source, target, relation) of which an end is no node; two joins mark the ends, no edge is compared with another."""
    ids, rows = nodes.select(F.col("id").alias("__id")).distinct(), edges.where("resolved").select("source", "target", "relation")
    for end in ("source", "target"):
        rows = rows.join(ids, rows[end] == ids["__id"], "left").withColumnRenamed("__id", f"__{end}")
    return rows.where("__source is null or __target is null").select("source", "target", "relation")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, hub: int = HUB_DEGREE) -> DataFrame:
    """id, level, hub: what is reached from seeds (id) over edges either way; a hub that is no seed isn't gone beyond.

    One join and one anti join for each level. Hubs are left out of the frontier before it is joined, so that a level is
    at most `hub` times as large as the one before; unresolved targets (?name) connect nothing.
    """
    known = edges.where("resolved")
    degree = degrees(edges)
    both = known.select(F.col("source").alias("at"), F.col("target").alias("to")).unionByName(known.select(F.col("target").alias("at"), F.col("source").alias("to")))
    reached = seeds.select("id").distinct().join(degree, "id", "left").select("id", F.lit(0).alias("level"), F.lit(False).alias("hub"))
    frontier = reached
    for level in range(1, depth + 1):
        step = frontier.where("not hub").join(both, frontier["id"] == both["at"]).select(F.col("to").alias("id")).distinct()
        new = step.join(reached.select("id"), "id", "left_anti").join(degree, "id", "left")
        frontier = new.select("id", F.lit(level).alias("level"), (F.coalesce("degree", F.lit(0)) > hub).alias("hub"))
        reached = reached.unionByName(frontier)
    return reached


def modularity(pairs: DataFrame, member: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """modularity of a grouping (id, group) of a weighted projection (a, b, weight)."""
    m = member.select(F.col("id"), F.col("group").alias("g"))
    placed = pairs.join(m.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(m.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    total = placed.agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("ga") == F.col("gb"), F.col("weight")).otherwise(0)).alias("inside"))
    strength = placed.select(F.explode(F.array(F.struct(F.col("ga").alias("g"), "weight"), F.struct(F.col("gb").alias("g"), "weight"))).alias("x")).groupBy("x.g").agg(F.sum("x.weight").alias("d"))
    squares = strength.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"))
    return total.crossJoin(squares).select(F.round(F.col("inside") / F.col("w") - resolution * F.col("dd") / (4.0 * F.col("w") * F.col("w")), 6).alias("modularity"))


def exception_like(label, bases=None):
    """Whether a name, or a base's, is that of an exception."""
    def one(n):
        return n.rlike("(Error|Exception|Warning)$")

    return one(label) if bases is None else one(label) | F.exists(F.coalesce(bases, F.array().cast("array<string>")), one)


def summarise_groups(nodes: DataFrame, member: DataFrame, neighbours: DataFrame) -> DataFrame:
    """group, name, named_folder, size, hub: a group's folder (if two in five members live there) and its best symbol.

    nodes need a `folder`; ties between folders go to the smaller name.
    """
    real = nodes.where(~F.col("kind").isin("rationale", "claim", "document")).join(member, "id").join(neighbours, "id", "left")
    folders = real.groupBy("group", "folder").agg(F.count("*").alias("n"))
    sizes = folders.groupBy("group").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), "folder")).alias("top"))
    bases = F.col("bases") if "bases" in nodes.columns else None
    rank = F.when(exception_like(F.col("label"), bases), 0).when(F.col("kind") == "class", 2).otherwise(1)
    # a file names nothing where there are symbols
    key = F.struct((F.col("kind") != "file").alias("symbol"), rank.alias("rank"), F.coalesce("neighbours", F.lit(0)).alias("deg"), F.col("id"))
    hubs = real.groupBy("group").agg(F.max_by("label", key).alias("hub"))
    named = F.when((-F.col("top.m") >= 0.4 * F.col("size")) & ~F.col("top.folder").isin("", "."), F.col("top.folder")).otherwise("")
    out = sizes.join(hubs, "group").select("group", named.alias("named_folder"), "size", "hub")
    return out.select("group", F.when(F.col("named_folder") != "", F.concat("named_folder", F.lit(" · "), "hub")).otherwise(F.col("hub")).alias("name"), "named_folder", "size", "hub")


def number_groups(member: DataFrame) -> DataFrame:
    """id, group numbered by size, then by smallest id, from groups of more than one (id, group)."""
    sizes = member.groupBy("group").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    # as many rows as groups; ranges of the order are numbered from counts, not in one task
    ranked = sizes.select("group", (F.row_number().over(W.orderBy(F.desc("n"), "least")) - 1).alias("number"))
    return member.join(ranked, "group").select("id", F.col("number").alias("group"))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = RESOLUTION, limit: int = 5_000_000) -> DataFrame:
    """id, group: communities by local moves of modularity (Louvain), each connected component on its own.

    Components are found with joins; each is then moved in one task in integer arrays, in the order of ids with ties to
    the smaller community, so results don't depend on partitions. A component beyond `limit` edges raises.
    """
    import numpy as np
    import pandas as pd

    from symbolary.operators.components import components

    pairs = weighted(nodes, edges)
    root = components(pairs, "a", "b")
    dealt = pairs.join(root.select(F.col("vertex").alias("a"), "root"), "a")

    def move(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > limit:
            raise ValueError(f"a component has {len(frame)} edges; the limit is {limit}")
        names = np.unique(np.concatenate([frame["a"].to_numpy(dtype=object), frame["b"].to_numpy(dtype=object)]))
        a, b, w = np.searchsorted(names, frame["a"].to_numpy(dtype=object)), np.searchsorted(names, frame["b"].to_numpy(dtype=object)), frame["weight"].to_numpy(float)
        label = np.arange(len(names))
        loops = np.zeros(len(names))
        while True:
            n = len(loops)
            heads, tails, ws = np.r_[a, b], np.r_[b, a], np.r_[w, w]
            order = np.argsort(heads, kind="stable")
            heads, tails, ws = heads[order], tails[order], ws[order]
            begin = np.searchsorted(heads, np.arange(n + 1))
            strength = np.bincount(heads, ws, n) + 2 * loops
            whole, own, mass = strength.sum(), np.arange(n), strength.copy()
            moved, any_move = True, False
            while moved:
                moved = False
                for v in range(n):
                    near: dict[int, float] = {}
                    for t, x in zip(tails[begin[v] : begin[v + 1]].tolist(), ws[begin[v] : begin[v + 1]].tolist(), strict=True):
                        if t != v:
                            near[int(own[t])] = near.get(int(own[t]), 0.0) + x
                    home = int(own[v])
                    mass[home] -= strength[v]
                    gain = {c: x - resolution * strength[v] * mass[c] / whole for c, x in near.items()}
                    gain.setdefault(home, -resolution * strength[v] * mass[home] / whole)
                    best = min(gain, key=lambda c: (-round(gain[c], 9), c))
                    if gain[best] <= gain[home] + 1e-9:
                        best = home
                    mass[best] += strength[v]
                    if best != home:
                        own[v], moved, any_move = best, True, True
            if not any_move:
                break
            kept, own = np.unique(own, return_inverse=True)
            label = own[label]
            loops = np.bincount(own, loops, len(kept)) + np.bincount(own[a[own[a] == own[b]]], w[own[a] == own[b]], len(kept))
            cross = own[a] != own[b]
            lo, hi = np.minimum(own[a[cross]], own[b[cross]]), np.maximum(own[a[cross]], own[b[cross]])
            key, at = np.unique(lo * np.int64(len(kept)) + hi, return_inverse=True)
            a, b, w = key // len(kept), key % len(kept), np.bincount(at, w[cross], len(key))
        first = {}
        for i, g in enumerate(label.tolist()):
            first.setdefault(g, names[i])
        return pd.DataFrame({"id": names, "group": [first[g] for g in label.tolist()]})

    found = dealt.groupBy("root").applyInPandas(move, "id string, group string")
    return number_groups(found)
