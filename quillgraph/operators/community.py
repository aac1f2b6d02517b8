"""Communities of concepts by Louvain's method, one connected component at a time.

Components do not influence each other's modularity but for the total weight, which every task
gets, so each is optimised in a task of its own and the result is that of the whole graph. Nodes
are visited in sorted order, so results repeat; communities are numbered by their smallest member.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.operators.metrics import with_association
from quillgraph.operators.ranks import ranked
from quillgraph.shared import kept


def louvain(edges: list[tuple[str, str, float]], nodes: list[str], total: float | None = None, resolution: float = 1.0) -> dict[str, str]:
    """node -> the smallest node of its community. total: weight of the whole graph; default: of these edges."""
    names = sorted(set(nodes))
    at = {n: i for i, n in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in sorted(edges):
        if a != b and w > 0:
            i, j = at[a], at[b]
            links[i][j] = links[i].get(j, 0.0) + w
            links[j][i] = links[j].get(i, 0.0) + w
    loops = [0.0] * len(names)
    m2 = 2 * total if total is not None else sum(sum(x.values()) for x in links)
    members = [[i] for i in range(len(names))]
    while m2 > 0:
        home, moved = _local_moves(links, loops, m2, resolution)
        if not moved:
            break
        links, loops, members = _folded(links, loops, members, home)
    out = {}
    for group in members:
        low = min(names[i] for i in group)
        out |= {names[i]: low for i in group}
    return out


def _local_moves(links: list[dict[int, float]], loops: list[float], m2: float, resolution: float) -> tuple[list[int], bool]:
    n = len(links)
    home, moved = list(range(n)), False
    degree = [sum(links[i].values()) + 2 * loops[i] for i in range(n)]
    weight = degree[:]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            own, near = home[i], {}
            for j, w in links[i].items():
                near[home[j]] = near.get(home[j], 0.0) + w
            weight[own] -= degree[i]
            gain = lambda c: near.get(c, 0.0) - resolution * degree[i] * weight[c] / m2  # noqa: B023, E731
            best, top = own, gain(own)
            for c in sorted(near):
                g = gain(c)
                if g > top + 1e-12:
                    best, top = c, g
            weight[best] += degree[i]
            if best != own:
                home[i], changed, moved = best, True, True
    return home, moved


def _folded(links, loops, members, home):
    ids = {c: k for k, c in enumerate(sorted(set(home)))}
    new_links, new_loops, new_members = [{} for _ in ids], [0.0] * len(ids), [[] for _ in ids]
    for i, c in enumerate(home):
        k = ids[c]
        new_members[k] += members[i]
        new_loops[k] += loops[i]
        for j, w in links[i].items():
            o = ids[home[j]]
            if o == k:
                new_loops[k] += w / 2
            else:
                new_links[k][o] = new_links[k].get(o, 0.0) + w
    return new_links, new_loops, new_members


#: Edges of a connected component that one task may get; a larger component is an error.
MOST_EDGES = 20_000_000


def detect(concepts: DataFrame, edges: DataFrame, mode: str = "association", resolution: float = 1.0, most_edges: int = MOST_EDGES) -> DataFrame:
    """(concept, community_id) of all concepts, from edges (a, b, support); isolated concepts are communities by themselves.

    mode `association`: the weight is each edge's association strength over these edges; `support`: the support.
    A component is optimised by one task, in memory; one of more than most_edges edges raises an error.
    """
    edges = kept(edges.select("a", "b", "support"), "community-edges")
    weighted = with_association(edges.select("a", "b", "support"), "support", "w") if mode == "association" else edges.select("a", "b", F.col("support").cast("double").alias("w"))
    weighted = weighted.select("a", "b", F.coalesce("w", F.lit(0.0)).alias("w"))
    comp = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    total = weighted.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    sizes = edges.join(comp, edges["a"] == comp["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    if (largest := sizes.agg(F.max("n")).first()[0] or 0) > most_edges:
        raise ValueError(f"a connected component has {largest} edges, more than {most_edges}")
    grouped = weighted.join(comp, weighted["a"] == comp["node"]).select("component", "a", "b", "w").crossJoin(F.broadcast(total))

    def run(_: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts))
        found = louvain(list(zip(pdf.a, pdf.b, pdf.w, strict=True)), [*pdf.a, *pdf.b], float(pdf.total.iloc[0]), resolution)
        yield pd.DataFrame({"concept": list(found), "leader": list(found.values())})

    kind = dict(edges.dtypes)["a"]
    found = grouped.groupBy("component").applyInPandas(run, f"concept {kind}, leader {kind}")
    named = concepts.select("concept").distinct().join(found, "concept", "left").select("concept", F.coalesce("leader", "concept").alias("leader"))
    # numbers over the communities' leaders
    ids = ranked(named.select("leader").distinct(), "community_id", "leader").withColumn("community_id", F.col("community_id").cast("int"))
    return named.join(ids, "leader").select("concept", "community_id")


def names(assignment: DataFrame, degrees: DataFrame) -> DataFrame:
    """(community_id, name, node_count): the name is the member of the largest degree, the smallest on a tie."""
    d = assignment.join(degrees.select(F.col("node").alias("concept"), "degree"), "concept", "left").na.fill(0, ["degree"])
    return d.groupBy("community_id").agg(F.min_by("concept", F.struct((-F.col("degree")).alias("d"), "concept")).alias("name"), F.count(F.lit(1)).alias("node_count"))


def connectivity(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, components): connected components inside each community; isolated members count one each."""
    a, b = (assignment.select(F.col("concept").alias(c), F.col("community_id").alias(f"c{c}")) for c in ("a", "b"))
    inside = edges.join(a, "a").join(b, "b").filter(F.col("ca") == F.col("cb")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    comp = components(inside)
    own = assignment.join(comp, assignment["concept"] == comp["node"], "left").select("community_id", F.coalesce("component", "concept").alias("k"))
    return own.groupBy("community_id").agg(F.count_distinct("k").alias("components"))


def surprising(edges: DataFrame, assignment: DataFrame, most: int = 15, rare: int = 2) -> DataFrame:
    """Edges between communities that share at most `rare` edges; rarest first, then heaviest, then by ends."""
    a, b = (assignment.select(F.col("concept").alias(c), F.col("community_id").alias(f"c{c}")) for c in ("a", "b"))
    cross = edges.join(a, "a").join(b, "b").filter(F.col("ca") != F.col("cb"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")))
    return cross.withColumn("n", n).filter(F.col("n") <= rare).withColumn("bridge_rarity", 1 / F.col("n")).orderBy(F.desc("bridge_rarity"), F.desc("support"), "a", "b").limit(most).select("a", "b", "ca", "cb", "support", "bridge_rarity")


def god_nodes(degrees: DataFrame, most: int = 10) -> DataFrame:
    """The nodes of the largest weighted degree; ties by id."""
    return degrees.orderBy(F.desc("weighted_degree"), "node").limit(most)
