"""View queries over the facts of a graph: concept, context and institution views, and comparisons.

A view is a bundle of lazy DataFrames. The stored and the filtered concept view are one code path:
without a filter the cohort is every patent. What differs by definition (denominators of the NPMI)
is said where it happens.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.functions import text as X
from quillgraph.operators import citations as C
from quillgraph.operators import community, compare, ipc, metrics, network, temporal
from quillgraph.operators.ranks import ranked
from quillgraph.plans.options import ViewOptions, scope_key, with_panel
from quillgraph.shared import kept

# fixed values: colours of institution types, source files, shared sources and communities
INSTITUTION_COLOURS = {"銀行": "#1d6fd1", "金控": "#12385c", "保險": "#d97706", "大學": "#7c3aed", "證券投承": "#0f7662", "支付金流": "#15803d", "科技": "#475569", "學研": "#8b5cf6", "個人": "#d1d5db", "其他": "#94a3b8"}
COMMUNITY_COLOURS = ["#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC"]
APPLICANT_COMMUNITY_COLOURS = ["#7B2CBF", "#FF8C42", "#2EC4B6", "#E63946", "#4361EE", "#F4A261", "#7209B7", "#06D6A0", "#EF476F", "#118AB2"]
SOURCE_COLOURS = ["#0ea5e9", "#10b981", "#f59e0b", "#8b5cf6", "#ec4899", "#14b8a6", "#f43f5e", "#6366f1"]
SOURCE_OVERLAP = "#dc2626"
UNKNOWN_APPLICANT = "未知申請人"
MOST_FILES = 10_000


@dataclass
class Graph:
    """Facts: patents (patent_id, year, source_files[, ipc5]), membership (patent_id, concept), ownership (patent_id, applicant).

    relations, citations (from_patent, to_patent) and communities (concept, community_id
    [, community_id_applicants]) are optional, and so is what the graph's methodology says of its
    sources. Names of communities (unit, community_id, name) and cycles that an import has broken
    (temporal.legacy_cycles) come from a store.
    """

    patents: DataFrame
    membership: DataFrame
    ownership: DataFrame
    relations: DataFrame | None = None
    citations: DataFrame | None = None
    communities: DataFrame | None = None
    methodology: dict[str, str] = field(default_factory=dict)
    broken_cycles: list[dict] = field(default_factory=list)

    @cached_property
    def year_range(self) -> tuple[int, int]:
        """Of all patents, valid or not."""
        r = self.patents.agg(F.min("year"), F.max("year")).first()
        return (r[0] or 0, r[1] or 0)

    @cached_property
    def source_files(self) -> list[str]:
        """Names of uploaded files, a short list by nature; more than MOST_FILES are an error."""
        rows = self.patents.select(F.explode("source_files").alias("f")).distinct().orderBy(F.collate("f", "zh_Hant"), "f").limit(MOST_FILES + 1).collect()
        if len(rows) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} source files")
        return [r["f"] for r in rows]


@dataclass
class View:
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    citation_edges: DataFrame | None = None
    communities: DataFrame | None = None
    max_support: DataFrame | None = None
    scope: str = ""
    warnings: list[str] = field(default_factory=list)
    #: (edge_id, forward, reverse) of edges whose direction the citations contradict
    conflicts: DataFrame | None = None


def full_range(g: Graph, o: ViewOptions) -> bool:
    return o.year_range is None or tuple(o.year_range) == g.year_range


def cohort(g: Graph, o: ViewOptions) -> DataFrame | None:
    """patent_ids that the options select; None if nothing filters. Patents without a year are in no year window but in the full range."""
    full = full_range(g, o)
    if not o.source_files and not o.ipc_filter and full:
        return None
    p = g.patents
    if o.source_files:
        p = p.filter(F.arrays_overlap("source_files", F.array(*[F.lit(f) for f in o.source_files])))
    if o.ipc_filter:
        p = p.filter(F.arrays_overlap(ipc.keys_of(F.col("ipc5"), o.ipc_level), F.array(*[F.lit(k) for k in o.ipc_filter])))
    if not full:
        p = p.filter(F.col("year").between(*o.year_range))
    return p.select("patent_id")


def _within(facts: DataFrame, chosen: DataFrame | None) -> DataFrame:
    return facts if chosen is None else facts.join(chosen, "patent_id", "left_semi")


def palette(index, colours: list[str]):
    return F.element_at(F.array(*[F.lit(c) for c in colours]), (F.pmod(index, F.lit(len(colours))) + 1).cast("int"))


def colour_nodes(g: Graph, nodes: DataFrame, membership: DataFrame, o: ViewOptions) -> DataFrame:
    """Adds `colour` to concept nodes by the colour mode in force."""
    mode = o.colours
    if mode == "first_year":
        return nodes.crossJoin(F.broadcast(temporal.time_window(nodes))).withColumn("colour", N.gradient_colour(F.col("first_year"), F.col("window_from"), F.col("window_to"))).drop("window_from", "window_to")
    if mode == "source":
        each = g.patents.select("patent_id", F.explode("source_files").alias("f"))
        touch = membership.join(each, "patent_id").groupBy("concept").agg(F.min("f").alias("f"), (F.min("f") == F.max("f")).alias("one"))
        # ranks over the distinct files, a short list by nature
        rank = each.select("f").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.collate("f", "zh_Hant"), "f")) - 1)
        return nodes.join(touch.join(F.broadcast(rank), "f"), "concept", "left").withColumn("colour", F.when(F.col("one"), palette(F.col("rank"), SOURCE_COLOURS)).otherwise(F.lit(SOURCE_OVERLAP))).drop("f", "one", "rank")
    if mode == "ipc":
        best = ipc.dominant(membership, g.patents, o.ipc_level)
        shades = ipc.colours(ipc.patent_keys(g.patents, o.ipc_level))
        return nodes.join(best.join(shades, "key", "left").select("concept", F.coalesce("colour", F.lit(ipc.NO_COLOUR)).alias("colour")), "concept", "left").na.fill(ipc.NO_COLOUR, ["colour"])
    column, colours = ("community_id_applicants", APPLICANT_COMMUNITY_COLOURS) if mode == "community_applicants" else ("community_id", COMMUNITY_COLOURS)
    if column not in nodes.columns:
        return nodes.withColumn("colour", F.lit(COMMUNITY_COLOURS[-1]))
    return nodes.withColumn("colour", F.coalesce(palette(F.col(column), colours), F.lit(COMMUNITY_COLOURS[-1])))


def concept_view(g: Graph, o: ViewOptions) -> View:
    """Concepts of the cohort with frequencies and years, pairs with all unit metrics, directed by medians, with citation evidence.

    Metrics are made before the support threshold. Without a filter the NPMI counts all patents and
    all applicants, concept or not; with one, the cohort and only applicants that hold a concept.
    """
    chosen = cohort(g, o)
    chosen = None if chosen is None else kept(chosen, "cohort")
    membership, ownership = kept(_within(g.membership, chosen), "membership"), kept(_within(g.ownership, chosen), "ownership")
    held = kept(network.applicant_concepts(membership, ownership), "held")
    total_patents = (g.patents if chosen is None else chosen).agg(F.count(F.lit(1)).alias("patent_count"))
    total_applicants = ownership.agg(F.count_distinct("applicant")) if chosen is None else None
    edges = metrics.unit_metrics(membership, ownership, total_patents, total_applicants, held)
    reference = g.membership if o.temporal_reference == "full" else membership
    stats = kept(temporal.year_stats(temporal.concept_years(reference, g.patents, o.max_year)), "years")
    nodes = network.concept_frequency(membership).join(network.concept_applicants(held), "concept", "left").na.fill(0, ["applicant_count"]).join(stats, "concept", "left")
    size = F.col("applicant_count") if o.unit == "applicant" else F.col("frequency")
    nodes = nodes.withColumn("size", N.concept_size(size))
    if g.communities is not None:
        nodes = nodes.join(g.communities, "concept", "left")
    support = "support_applicants" if o.unit == "applicant" else "support"
    top = metrics.max_support(edges, support)
    shown = temporal.directed(edges.filter(F.col(support) >= o.min_support), stats).withColumn("opacity", N.support_opacity(F.col("support")))
    only = None
    if g.citations is not None:
        cited = g.citations if chosen is None else g.citations.join(chosen.withColumnRenamed("patent_id", "from_patent"), "from_patent", "left_semi").join(chosen.withColumnRenamed("patent_id", "to_patent"), "to_patent", "left_semi")
        counts = C.projected(cited, membership)
        only = C.citation_only(counts, shown.select(F.col("from").alias("a"), F.col("to").alias("b")), stats) if o.show_citations else None
        shown = C.edge_evidence(shown, counts)
    shown = shown.withColumn("kind", F.lit("cooccurrence")).withColumn("edge_id", X.stable_edge_id("cooccurrence", F.least("from", "to"), F.greatest("from", "to")))
    if o.show_semantic and g.relations is not None:
        sem = network.semantic_edges(network.admissible(g.relations, g.membership), with_evidence=False)
        for end in ("source", "target"):
            sem = sem.join(nodes.select(F.col("concept").alias(end)), end, "left_semi")
        shown = shown.unionByName(sem.select(F.col("source").alias("from"), F.col("target").alias("to"), "relation", "support", "weight", F.lit("semantic").alias("kind"), X.stable_edge_id("semantic", F.col("source"), F.col("target"), F.col("relation")).alias("edge_id")), allowMissingColumns=True)
    conflicts = shown.filter("citation_direction_conflict").select("edge_id", "forward", "reverse") if g.citations is not None else None
    communities = community_list(nodes, edges, o, support) if g.communities is not None else None
    years = g.year_range if o.year_range is None else tuple(o.year_range)
    stats_row = nodes.agg(F.count(F.lit(1)).alias("concept_count")).crossJoin(held.agg(F.count_distinct("applicant").alias("applicant_count"))).crossJoin(F.broadcast(total_patents)).withColumn("year_from", F.lit(years[0])).withColumn("year_to", F.lit(years[1]))
    return View(colour_nodes(g, nodes, membership, o), shown, stats_row, only, communities, top, scope_key(list(o.source_files) or g.source_files, o, years), view_warnings(g), conflicts)


def community_list(nodes: DataFrame, edges: DataFrame, o: ViewOptions, support: str) -> DataFrame | None:
    """(community_id, name, colour, node_count) of the communities that have nodes in the view; a name is the member with most edges."""
    column, colours = ("community_id_applicants", APPLICANT_COMMUNITY_COLOURS) if o.colours == "community_applicants" else ("community_id", COMMUNITY_COLOURS)
    if column not in nodes.columns:
        return None
    degrees = metrics.node_degrees(edges.filter(F.col(support) > 0).select(F.col("a").alias("from"), F.col("b").alias("to")))
    own = nodes.filter(F.col(column).isNotNull()).select("concept", F.col(column).alias("community_id"))
    return community.names(own, degrees).withColumn("colour", palette(F.col("community_id"), colours))


def context_view(g: Graph, o: ViewOptions) -> View:
    """Visible patents with their applicants and concepts; concepts below the support threshold leave with their edges."""
    chosen = cohort(g, o)
    patents = _within(g.patents, chosen)
    concepts_of, owners_of = _within(g.membership, chosen), _within(g.ownership, chosen)
    freq = network.concept_frequency(concepts_of)
    top = freq.agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.max("frequency"), F.lit(1).cast("long"))).alias("max_support"))
    kept = freq.filter(F.col("frequency") >= o.min_support)
    nodes = (
        network.applicant_patents(owners_of).select(F.concat(F.lit("applicant:"), F.col("applicant").cast("string")).alias("id"), F.lit("applicant").alias("type"), F.col("patent_count").alias("n"), N.applicant_size(F.col("patent_count")).alias("size"))
        .union(patents.select(F.concat(F.lit("patent:"), F.col("patent_id").cast("string")), F.lit("patent"), F.lit(1).cast("long"), F.lit(18.0)))
        .union(kept.select(F.concat(F.lit("concept:"), "concept"), F.lit("concept"), "frequency", N.concept_size(F.col("frequency"))))
    )
    edges = structural_edges(concepts_of.join(kept, "concept", "left_semi"), owners_of)
    stats = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return View(nodes, edges, stats, None, None, top, warnings=view_warnings(g))


def structural_edges(membership: DataFrame, ownership: DataFrame) -> DataFrame:
    """applicant -> patent and patent -> concept."""
    a = ownership.select(F.concat(F.lit("applicant:"), F.col("applicant").cast("string")).alias("from"), F.concat(F.lit("patent:"), F.col("patent_id").cast("string")).alias("to"), F.lit("申請了").alias("relation"))
    b = membership.select(F.concat(F.lit("patent:"), F.col("patent_id").cast("string")), F.concat(F.lit("concept:"), "concept"), F.lit("包含"))
    return a.union(b)


def facts_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, ownership) from structural edges (from, to, relation): the inverse of structural_edges()."""
    m = edges.filter(F.col("relation") == "包含").select(F.regexp_replace("from", "^patent:", "").alias("patent_id"), F.regexp_replace("to", "^concept:", "").alias("concept")).distinct()
    o = edges.filter(F.col("relation") == "申請了").select(F.regexp_replace("to", "^patent:", "").alias("patent_id"), F.regexp_replace("from", "^applicant:", "").alias("applicant")).distinct()
    return m, o


def institution_pairs(held: DataFrame) -> DataFrame:
    """(a, b, support): concepts that two institutions share, by a self-join on the concept that adaptive execution splits where a concept is hot."""
    return network.pairs_by_join(held.select("applicant", "concept"), "concept", "applicant")


def institution_view(g: Graph, o: ViewOptions, names: DataFrame | None = None) -> View:
    """Institutions that share concepts. Only institutions with an edge left are nodes; type counts come before that filter.

    names: (applicant, name) where applicants are ids; default: the applicant itself.
    """
    chosen = cohort(g, o)
    held = network.applicant_concepts(_within(g.membership, chosen), _within(g.ownership, chosen))
    pairs = institution_pairs(held)
    top = metrics.max_support(pairs)
    shown = pairs.filter(F.col("support") >= o.min_support).withColumn("weight", F.col("support").cast("double"))
    all_nodes = held.groupBy("applicant").agg(F.count(F.lit(1)).alias("concept_count"))
    named = all_nodes.withColumn("name", F.col("applicant").cast("string")) if names is None else all_nodes.join(names, "applicant", "left")
    named = named.withColumn("org_type", X.institution_type_of(F.col("name"))).withColumn("size", N.institution_size(F.col("concept_count")))
    colours = F.create_map(*[F.lit(x) for kv in INSTITUTION_COLOURS.items() for x in kv])
    connected = shown.select(F.explode(F.array("a", "b")).alias("applicant")).distinct()
    nodes = named.withColumn("colour", colours[F.col("org_type")]).join(connected, "applicant", "left_semi")
    types = named.groupBy("org_type").agg(F.count(F.lit(1)).alias("node_count"))
    stats = nodes.agg(F.count(F.lit(1)).alias("applicant_count")).crossJoin(held.agg(F.count_distinct("concept").alias("concept_count")))
    return View(nodes, shown.withColumn("edge_id", X.stable_edge_id("institution", F.col("a"), F.col("b"))), stats, None, types, top, warnings=view_warnings(g))


def shared_concept_list(held: DataFrame, a, b) -> DataFrame:
    """(concept): what two institutions share."""
    return held.filter(F.col("applicant").isin(a, b)).groupBy("concept").agg(F.count_distinct("applicant").alias("n")).filter(F.col("n") == 2).select("concept")


def select_view(g: Graph, o: ViewOptions, **more) -> View:
    if o.mode == "institution":
        return institution_view(g, o, **more)
    return concept_view(g, o) if o.mode == "concept" else context_view(g, o)


def export_views(g: Graph, o: ViewOptions) -> dict[str, View]:
    from dataclasses import replace

    return {m: select_view(g, replace(o, mode=m, show_citations=True)) for m in ("concept", "context", "institution")}


def export_rows(g: Graph, o: ViewOptions) -> DataFrame:
    """(mode, part, json) of all three views: what an offline export embeds, a JSON object for each node and edge."""
    out = None
    for mode, v in export_views(g, o).items():
        for part, df in (("nodes", v.nodes), ("edges", v.edges), ("citation_edges", v.citation_edges)):
            if df is not None:
                rows = df.select(F.lit(mode).alias("mode"), F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("json"))
                out = rows if out is None else out.union(rows)
    return out


def compare_views(g: Graph, o: ViewOptions, scopes: list[list[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of the difference of 2 to 6 scopes of source files, an empty one being all files: the scopes' concept views as one.

    Pairs of all scopes are counted in one pass over the patents. Edges are compared by their ends;
    their ids are hashes of 32 bits, which several of them may share.
    """
    if not 2 <= len(scopes) <= 6:
        raise ValueError("2 to 6 scopes")
    nodes, parts = [], []
    every = kept(compare.panel_cooccurrence(_within(g.membership, cohort(g, with_panel(o, []))), g.patents, scopes), "panels")
    for i, s in enumerate(scopes):
        own = _within(g.membership, cohort(g, with_panel(o, s)))
        nodes.append(network.concept_frequency(own).withColumnRenamed("concept", "id"))
        pairs = every.filter((F.col("panel") == i + 1) & (F.col("support") >= o.min_support))
        parts.append(pairs.select(F.struct("a", "b").alias("id"), F.col("a").alias("from"), F.col("b").alias("to"), "support"))
    ids = compare.tagged(nodes)
    every_node, edges = compare.difference(nodes, parts)
    return every_node, edges.withColumn("id", X.stable_edge_id("cooccurrence", F.col("from"), F.col("to"))), compare.summary(ids, len(scopes))


def capability_warnings(methodology: dict[str, str]) -> list[str]:
    """What a graph cannot show, or shows by reconstruction, because its payload lacks it."""
    out = []
    if methodology.get("cooccurrence_data") in ("unavailable", "reconstructed"):
        out.append(f"cooccurrence_{methodology['cooccurrence_data']}")
    if methodology.get("semantic_provenance") == "partial":
        out.append("semantic_provenance_partial")
    return out


def view_warnings(g: Graph) -> list[str]:
    """Capability warnings, and one for each edge that lost its direction because an imported graph had a cycle."""
    return capability_warnings(g.methodology) + [f"temporal_cycle_broken:{e['edge_id']}" for e in g.broken_cycles]


def graph_stats(g: Graph, placeholder: bool = True) -> DataFrame:
    """One row of counts; patents without an applicant add one placeholder applicant."""
    bare = not g.patents.join(g.ownership, "patent_id", "left_anti").isEmpty() if placeholder else False
    one = g.patents.agg(F.count(F.lit(1)).alias("patent_count"), F.min("year").alias("year_from"), F.max("year").alias("year_to"))
    return one.crossJoin(g.ownership.agg((F.count_distinct("applicant") + F.lit(int(bare))).alias("applicant_count"))).crossJoin(g.membership.agg(F.count_distinct("concept").alias("concept_count")))


def applicant_colours(ownership: DataFrame, ordinal: DataFrame, colours: list[str] = COMMUNITY_COLOURS) -> DataFrame:
    """(applicant, colour) by first appearance: the smallest ordinal of an applicant's patents, then the applicant."""
    first = ownership.join(ordinal, "patent_id").groupBy("applicant").agg(F.min("ordinal").alias("o"))
    return ranked(first, "rank", "o", "applicant").select("applicant", palette(F.col("rank"), colours).alias("colour"))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n=count:hash|e=count:hash over sorted ids and edges, the same for any input order. A drawn view is small; its text is what is hashed."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\n").alias("t"))
    e = edges.agg(F.count(F.lit(1)).alias("m"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.col("id").cast("string"), F.col("from").cast("string"), F.col("to").cast("string")))), "\n").alias("s"))
    return n.crossJoin(e).select(F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(":"), X.hex8(X.fnv1a32(F.col("t"))), F.lit("|e="), F.col("m").cast("string"), F.lit(":"), X.hex8(X.fnv1a32(F.col("s")))).alias("fingerprint"))
