"""Queries of the engine by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import testbed as T
from quillgraph.functions import numeric as N
from quillgraph.functions import text as X
from quillgraph.operators import citations as C
from quillgraph.operators import community, compare, ipc, metrics, network, publish, resolve, sampling, subgraph, temporal
from quillgraph.plans import views
from quillgraph.plans.options import ViewOptions
from quillgraph.sinks import catalog, store
from quillgraph.sources import extraction, xlsx

#: 32-bit FNV-1a of an ASCII text.
FNV = "list_reduce(list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296, cast(2166136261 as bigint))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common tables of the SQL side.
FACTS = """
with pat as (select o_orderkey as patent_id, cast(year(o_orderdate) as integer) as year, o_orderpriority as file, o_custkey as applicant, o_orderstatus as status, o_orderdate from orders),
mc as (select distinct l_orderkey as patent_id, p_name as concept from lineitem join part on l_partkey = p_partkey),
own as (select patent_id, applicant from pat union select patent_id, applicant + 1 from pat where patent_id % 5 = 0),
held as (select distinct applicant, concept from mc join own using (patent_id)),
freq as (select concept, count(*) as f from mc group by 1),
na as (select concept, count(*) as n from held group by 1),
pairs as (select x.concept as a, y.concept as b, count(*) as s from mc x join mc y on x.patent_id = y.patent_id and x.concept < y.concept group by 1, 2)
"""
YEARS = """, cy as (select concept, year from mc join pat using (patent_id) where year between 1990 and 2035),
med as (select concept, median(year) as m from cy group by 1)
"""
CODES = """, code as (select p_partkey, substr('ABCDEFGH', cast(p_size % 8 + 1 as integer), 1) || lpad(cast(p_size % 90 + 10 as varchar), 2, '0') || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(p_partkey % 26 + 1 as integer), 1) as sub,
  cast(p_partkey % 300 + 1 as varchar) as main, lpad(cast(p_size as varchar), 2, '0') as grp from part),
pk as (select distinct l_orderkey as patent_id, sub, main, grp from lineitem join code on l_partkey = p_partkey)
"""
CITES = """, lagged as (select patent_id, lag(patent_id, 1) over w as p1, lag(patent_id, 2) over w as p2 from pat window w as (partition by applicant order by o_orderdate, patent_id)),
cit as (select patent_id as f, p1 as t from lagged where p1 is not null union select p2, patent_id from lagged where p2 is not null and patent_id % 3 = 0),
cc as (select x.concept as a, y.concept as b, count(*) as n from cit join mc x on x.patent_id = f join mc y on y.patent_id = t where x.concept <> y.concept group by 1, 2)
"""
RELS = """, rel0 as (select l_orderkey as patent_id, l_linenumber as ordinal, p_name as source, lead(p_name) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) || case when l_orderkey % 5 = 0 and l_linenumber = 1 then ' outside' else '' end as target, l_returnflag as relation, l_quantity as weight from lineitem join part on l_partkey = p_partkey),
rel as (select * from rel0 where target is not null and source <> target and not contains(target, ' outside'))
"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r9(c) -> F.col:
    return F.round(c, 9)


# ---------------------------------------------------------------- network


@query("concept_frequency", FACTS + "select concept, f as frequency from freq")
def _(spark, d):
    return network.concept_frequency(T.membership(spark, d))


@query("concept_sources", FACTS + "select concept, count(*) as frequency, md5(string_agg(cast(patent_id as varchar), ',' order by patent_id)) as sources from mc group by 1")
def _(spark, d):
    s = network.concept_sources(T.membership(spark, d))
    return s.select("concept", "frequency", F.md5(F.array_join(F.transform("source_patents", lambda x: x.cast("string")), ",")).alias("sources"))


@query("cooccurrence_pairs", FACTS + "select a, b, s as support, x.f as frequency_a, y.f as frequency_b, round(s / cast(x.f + y.f - s as double), 9) as jaccard from pairs join freq x on x.concept = a join freq y on y.concept = b")
def _(spark, d):
    return network.cooccurrence(T.membership(spark, d)).withColumn("jaccard", r9("jaccard"))


@query("semantic_edges", FACTS + RELS + "select source, target, relation, count(distinct patent_id) as support, round(avg(weight), 9) as weight from rel group by 1, 2, 3")
def _(spark, d):
    r = network.admissible(T.relations(spark, d), T.membership(spark, d))
    return network.semantic_edges(r, with_evidence=False).select("source", "target", "relation", "support", r9("weight").alias("weight"))


@query("semantic_evidence", FACTS + RELS + "select source, target, relation, 'EXTRACTED' as confidence, md5(string_agg(cast(patent_id as varchar) || ':' || cast(cast(weight as integer) as varchar), ',' order by patent_id, ordinal)) as evidence from rel group by 1, 2, 3")
def _(spark, d):
    e = network.semantic_edges(network.admissible(T.relations(spark, d), T.membership(spark, d)))
    told = F.transform("evidence", lambda x: F.concat(x["patent_id"].cast("string"), F.lit(":"), F.rint(x["weight"]).cast("int").cast("string")))
    return e.select("source", "target", "relation", "confidence", F.md5(F.nullif(F.array_join(told, ","), F.lit(""))).alias("evidence"))


@query("relation_admissibility", FACTS + RELS + "select relation, count(*) as n, count(distinct patent_id) as patents from rel group by 1")
def _(spark, d):
    r = network.admissible(T.relations(spark, d), T.membership(spark, d))
    return r.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patent_id").alias("patents"))


def _synonyms(spark, d):
    names = T.read(spark, d, "part").select(F.col("p_name").alias("alias")).distinct()
    return names.select("alias", F.regexp_extract("alias", r"^(\S+)", 1).alias("canonical"))


@query("synonym_cooccurrence", FACTS + ", m2 as (select distinct patent_id, split_part(concept, ' ', 1) as concept from mc) select x.concept as a, y.concept as b, count(*) as support from m2 x join m2 y on x.patent_id = y.patent_id and x.concept < y.concept group by 1, 2")
def _(spark, d):
    m = network.canonicalise(T.membership(spark, d), _synonyms(spark, d))
    return network.pairs_by(m, "patent_id", "concept")


@query("applicant_patents", FACTS + "select applicant, count(distinct patent_id) as patent_count from own group by 1")
def _(spark, d):
    return network.applicant_patents(T.ownership(spark, d))


@query("concept_applicants", FACTS + "select concept, n as applicant_count from na")
def _(spark, d):
    return network.concept_applicants(network.applicant_concepts(T.membership(spark, d), T.ownership(spark, d)))


@query("applicant_pair_support", FACTS + "select x.concept as a, y.concept as b, count(*) as support from held x join held y on x.applicant = y.applicant and x.concept < y.concept group by 1, 2")
def _(spark, d):
    return network.pairs_by_join(network.applicant_concepts(T.membership(spark, d), T.ownership(spark, d)), "applicant", "concept")


UNIT_METRICS = """, pa as (select x.concept as a, y.concept as b, count(*) as s from held x join held y on x.applicant = y.applicant and x.concept < y.concept group by 1, 2),
e as (select pairs.a, pairs.b, pairs.s as support, x.f as fa, y.f as fb, coalesce(pa.s, 0) as sa, coalesce(nx.n, 0) as na, coalesce(ny.n, 0) as nb from pairs join freq x on x.concept = pairs.a join freq y on y.concept = pairs.b left join pa on pa.a = pairs.a and pa.b = pairs.b left join na nx on nx.concept = pairs.a left join na ny on ny.concept = pairs.b),
t as (select (select count(distinct patent_id) from mc) as np, (select count(distinct applicant) from held) as ni, (select sum(support) from e) as ss, (select sum(sa) from e) as ssa),
inc as (select c, sum(support) as w, sum(sa) as wa from (select a as c, support, sa from e union all select b, support, sa from e) group by 1)
select e.a, e.b, support, round(support / cast(fa + fb - support as double), 9) as jaccard, sa as support_applicants, round(case when na + nb - sa > 0 then sa / cast(na + nb - sa as double) else 0 end, 9) as jaccard_applicants,
 round(case when support / np < 1 - 1e-12 then greatest(-1, least(1, ln((support / np) / ((fa / np) * (fb / np))) / -ln(support / np))) end, 9) as npmi,
 round(case when sa > 0 and na > 0 and nb > 0 and sa / ni < 1 - 1e-12 then greatest(-1, least(1, ln((sa / ni) / ((na / ni) * (nb / ni))) / -ln(sa / ni))) end, 9) as npmi_applicants,
 round(cast(ss * support / cast(ia.w * ib.w as double) as double), 9) as association_strength, round(case when sa > 0 then ssa * sa / cast(ia.wa * ib.wa as double) end, 9) as association_strength_applicants
from e cross join t join inc ia on ia.c = e.a join inc ib on ib.c = e.b"""


@query("unit_metrics", FACTS + UNIT_METRICS)
def _(spark, d):
    m = metrics.unit_metrics(T.membership(spark, d), T.ownership(spark, d))
    return m.select("a", "b", "support", r9("jaccard").alias("jaccard"), "support_applicants", *[r9(c).alias(c) for c in ("jaccard_applicants", "npmi", "npmi_applicants", "association_strength", "association_strength_applicants")])


@query("max_support", FACTS + "select greatest(1, max(s)) as max_support from pairs")
def _(spark, d):
    return metrics.max_support(network.cooccurrence(T.membership(spark, d)))


@query("edge_widths", FACTS + "select a, b, round(least(8, 1 + 7 * (s / cast(x.f + y.f - s as double))), 9) as width, round(0.3 + 0.7 * (1 - exp(-s / 5.0)), 9) as opacity from pairs join freq x on x.concept = a join freq y on y.concept = b")
def _(spark, d):
    return network.cooccurrence(T.membership(spark, d)).select("a", "b", r9(N.cooccurrence_width(F.col("jaccard"))).alias("width"), r9(N.support_opacity(F.col("support"))).alias("opacity"))


@query("node_sizes", FACTS + "select concept, round(greatest(10, least(72, 10 + 10 * sqrt(f))), 9) as size, round(least(52, 18 + 5 * sqrt(n)), 9) as institution_size from freq join na using (concept)")
def _(spark, d):
    m = T.membership(spark, d)
    n = network.concept_frequency(m).join(network.concept_applicants(network.applicant_concepts(m, T.ownership(spark, d))), "concept")
    return n.select("concept", r9(N.concept_size(F.col("frequency"))).alias("size"), r9(N.institution_size(F.col("applicant_count"))).alias("institution_size"))


@query("node_degrees", FACTS + "select c as node, count(*) as degree, cast(sum(s) as double) as weighted_degree from (select a as c, s from pairs union all select b, s from pairs) group by 1")
def _(spark, d):
    e = network.cooccurrence(T.membership(spark, d)).select(F.col("a").alias("from"), F.col("b").alias("to"), F.col("support").cast("double").alias("weight"))
    return metrics.node_degrees(e, "weight").select("node", "degree", "weighted_degree")


@query("god_nodes", FACTS + "select c as node, count(*) as degree, cast(sum(s) as double) as weighted_degree from (select a as c, s from pairs union all select b, s from pairs) group by 1 order by 3 desc, 1 limit 10")
def _(spark, d):
    e = network.cooccurrence(T.membership(spark, d)).select(F.col("a").alias("from"), F.col("b").alias("to"), F.col("support").cast("double").alias("weight"))
    return community.god_nodes(metrics.node_degrees(e, "weight")).select("node", "degree", "weighted_degree")


# ---------------------------------------------------------------- years

STATS = """, o as (select concept, year, row_number() over (partition by concept order by year) as r, count(*) over (partition by concept) as n from cy),
st as (select concept, min(year) as first_year, cast(max(case when r = ceil(0.25 * n) then year end) as integer) as q1_year, cast(max(case when r = ceil(0.75 * n) then year end) as integer) as q3_year, max(year) as last_year, max(n) as n,
 max(case when r = n // 2 then year end) as va, max(case when r = n // 2 + 1 then year end) as vb, max(case when r = n // 2 + 2 then year end) as vc from o group by 1)
"""


@query("concept_year_stats", FACTS + YEARS + STATS + """select concept, first_year, q1_year, cast(case when n % 2 = 1 then vb else (va + vb) / 2.0 end as double) as median_year, q3_year, last_year,
 cast(case when n >= 2 then case when n % 2 = 1 then (va + vb) / 2.0 else va end end as double) as median_loo_min, cast(case when n >= 2 then case when n % 2 = 1 then (vb + vc) / 2.0 else vb end end as double) as median_loo_max, n as observations from st""")
def _(spark, d):
    s = temporal.year_stats(temporal.concept_years(T.membership(spark, d), T.patents(spark, d), T.MAX_YEAR))
    return s.select("concept", "first_year", "q1_year", "median_year", "q3_year", "last_year", "median_loo_min", "median_loo_max", "observations")


@query("concept_year_counts", FACTS + YEARS + "select concept, year, count(*) as n from cy group by 1, 2")
def _(spark, d):
    s = temporal.year_stats(temporal.concept_years(T.membership(spark, d), T.patents(spark, d), T.MAX_YEAR))
    return s.select("concept", F.explode("year_counts").alias("y", "n")).select("concept", F.col("y").cast("int").alias("year"), "n")


@query("applicant_concept_years", FACTS + ", cy as (select concept || '#' || cast(applicant as varchar) as concept, year from mc join pat using (patent_id) where year between 1990 and 2035)" + STATS + "select concept, first_year, last_year, cast(case when n % 2 = 1 then vb else (va + vb) / 2.0 end as double) as median_year, cast(case when n >= 2 then case when n % 2 = 1 then (va + vb) / 2.0 else va end end as double) as median_loo_min from st")
def _(spark, d):
    m = T.membership(spark, d).join(T.patents(spark, d).select("patent_id", "applicant"), "patent_id").select("patent_id", F.concat_ws("#", "concept", F.col("applicant").cast("string")).alias("concept"))
    return temporal.year_stats(temporal.concept_years(m, T.patents(spark, d), T.MAX_YEAR)).select("concept", "first_year", "last_year", "median_year", "median_loo_min")


@query("time_window", FACTS + YEARS + "select min(y) as window_from, max(y) as window_to from (select concept, min(year) as y from cy group by 1)")
def _(spark, d):
    return temporal.time_window(temporal.year_stats(temporal.concept_years(T.membership(spark, d), T.patents(spark, d), T.MAX_YEAR)))


def _brands(spark, d):
    """Concept = brand and type, patents of few lines: medians that differ."""
    part = T.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("concept"))
    return network.laid_out(T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("patent_id"), "l_partkey").join(part, "l_partkey").select("patent_id", "concept"))


BRANDS = FACTS.replace("p_name as concept", "p_brand || ' ' || p_type || ' ' || cast(p_size as varchar) as concept")


@query("oriented_pairs", BRANDS + YEARS + """select case when x.m > y.m then b else a end as "from", case when x.m > y.m then a else b end as "to", coalesce(x.m <> y.m, false) as directed, s as support from pairs left join med x on x.concept = a left join med y on y.concept = b""")
def _(spark, d):
    m = _brands(spark, d)
    s = temporal.year_stats(temporal.concept_years(m, T.patents(spark, d), T.MAX_YEAR))
    return temporal.directed(network.cooccurrence(m).select("a", "b", "support"), s).select("from", "to", "directed", "support")


@query("ordinal_bands", BRANDS + YEARS + "select concept as id, cast((dense_rank() over (order by m) - 1) * 220 as bigint) as y from med")
def _(spark, d):
    s = temporal.year_stats(temporal.concept_years(_brands(spark, d), T.patents(spark, d), T.MAX_YEAR))
    return temporal.layout(s.select(F.col("concept").alias("id"), "median_year")).select("id", "y")


@query("temporal_layout", BRANDS + YEARS + "select concept as id, round((" + FNV.format(text="concept") + " / 4294967295.0 - 0.5) * 700, 6) as x, cast((dense_rank() over (order by m) - 1) * 220 as bigint) as y from med")
def _(spark, d):
    s = temporal.year_stats(temporal.concept_years(_brands(spark, d), T.patents(spark, d), T.MAX_YEAR))
    return temporal.layout(s.select(F.col("concept").alias("id"), "median_year")).withColumn("x", F.round("x", 6))


@query("playback_counts", BRANDS + YEARS + "select y as year, cast(sum(count(*)) over (order by y) as bigint) as concepts from (select concept, min(year) as y from cy group by 1) group by 1")
def _(spark, d):
    return temporal.cumulative_first_years(temporal.year_stats(temporal.concept_years(_brands(spark, d), T.patents(spark, d), T.MAX_YEAR)))


def _gradient_sql(t: str) -> str:
    """A place 0..1 on the rainbow as a colour: linear between the anchors in OKLab, then to sRGB."""
    anchors = [N.oklab(c) for c in N.RAINBOW]
    anchors.append(anchors[-1])
    lists = [[a[k] for a in anchors] for k in range(3)]
    last = len(N.RAINBOW) - 1
    lab = [f"(list_extract({v}, i + 1) + (list_extract({v}, i + 2) - list_extract({v}, i + 1)) * share)" for v in lists]
    dot = lambda row, v: " + ".join(f"({c!r}) * {x}" for c, x in zip(row, v, strict=True))
    lms = [f"pow({dot(r, ('l', 'a', 'b'))}, 3)" for r in N.FROM_LAB]
    channel = lambda x: f"lpad(hex(cast(floor(255 * (case when {x} <= 0.0031308 then 12.92 * {x} else 1.055 * pow({x}, {1 / 2.4!r}) - 0.055 end) + 0.5) as integer)), 2, '0')"
    rgb = ", ".join(f"greatest(0, least(1, {dot(r, ('u', 'v', 'w'))})) as {c}" for r, c in zip(N.TO_RGB, ("r", "g", "bl"), strict=True))
    return f"""g0 as (select *, cast(floor(t * {last}) as integer) as i, t * {last} - floor(t * {last}) as share from {t}),
g1 as (select *, {lab[0]} as l, {lab[1]} as a, {lab[2]} as b from g0), g2 as (select *, {lms[0]} as u, {lms[1]} as v, {lms[2]} as w from g1), g3 as (select *, {rgb} from g2)
select concept, first_year, '#' || {channel("r")} || {channel("g")} || {channel("bl")} as colour from g3"""


@query("first_year_colours", BRANDS + YEARS + ", fy as (select concept, min(year) as first_year from cy group by 1), win as (select min(first_year) as lo, max(first_year) as hi from fy), pl as (select concept, first_year, case when hi > lo then (first_year - lo) / cast(hi - lo as double) else 0.0 end as t from fy cross join win), " + _gradient_sql("pl"))
def _(spark, d):
    s = temporal.year_stats(temporal.concept_years(_brands(spark, d), T.patents(spark, d), T.MAX_YEAR))
    return s.crossJoin(F.broadcast(temporal.time_window(s))).select("concept", "first_year", N.gradient_colour(F.col("first_year"), F.col("window_from"), F.col("window_to")).alias("colour"))


# ---------------------------------------------------------------- citations


@query("citation_projection", FACTS + CITES + 'select a as "from", b as "to", n from cc')
def _(spark, d):
    return C.projected(T.citations(spark, d), T.membership(spark, d))


STATE = "case when f = 0 and r = 0 then 'absent' when not (abs(f - r) >= 2 and (least(f, r) = 0 or greatest(f, r) >= 2 * least(f, r))) then 'insufficient' when f > r then 'aligned' else 'conflicting' end"


@query("citation_evidence", BRANDS + YEARS + CITES + f""", dir as (select case when x.m > y.m then b else a end as "from", case when x.m > y.m then a else b end as "to", coalesce(x.m <> y.m, false) as directed from pairs left join med x on x.concept = a left join med y on y.concept = b),
ev as (select d.*, coalesce(p.n, 0) as f, coalesce(q.n, 0) as r from dir d left join cc p on p.a = d."from" and p.b = d."to" left join cc q on q.a = d."to" and q.b = d."from")
select "from", "to", directed, f as forward, r as reverse, {STATE} as state, directed and {STATE} in ('aligned', 'conflicting') as citation_supported, directed and {STATE} = 'conflicting' as citation_direction_conflict from ev""")
def _(spark, d):
    m = _brands(spark, d)
    s = temporal.year_stats(temporal.concept_years(m, T.patents(spark, d), T.MAX_YEAR))
    e = temporal.directed(network.cooccurrence(m).select("a", "b", "support"), s).select("from", "to", "directed")
    return C.edge_evidence(e, C.projected(T.citations(spark, d), m)).select("from", "to", "directed", F.col("forward").cast("long").alias("forward"), F.col("reverse").cast("long").alias("reverse"), "state", "citation_supported", "citation_direction_conflict")


@query("citation_only_edges", BRANDS + YEARS + CITES + f""", un as (select least(a, b) as a, greatest(a, b) as b, sum(case when a < b then n else 0 end) as ab, sum(case when a > b then n else 0 end) as ba from cc group by 1, 2),
free as (select un.* from un left join pairs using (a, b) where pairs.a is null),
ori as (select case when x.m > y.m then free.b else free.a end as "from", case when x.m > y.m then free.a else free.b end as "to", cast(case when x.m > y.m then ba else ab end as bigint) as f, cast(case when x.m > y.m then ab else ba end as bigint) as r from free join med x on x.concept = free.a join med y on y.concept = free.b where x.m <> y.m)
select "from", "to", f as forward, r as reverse, {STATE} = 'conflicting' as conflict from ori where {STATE} in ('aligned', 'conflicting')""")
def _(spark, d):
    m = _brands(spark, d)
    s = temporal.year_stats(temporal.concept_years(m, T.patents(spark, d), T.MAX_YEAR))
    out = C.citation_only(C.projected(T.citations(spark, d), m), network.pairs_by(m, "patent_id", "concept"), s)
    return out.select("from", "to", F.col("forward").cast("long").alias("forward"), F.col("reverse").cast("long").alias("reverse"), "conflict")


@query("reference_resolution", """with p as (select o_orderkey as id, 'I' || cast(o_orderkey // 2 as varchar) as k, 'I' || cast((o_orderkey * 7) % 20000 // 2 as varchar) as r from orders), f as (select k, min(id) as cited from p group by 1)
select id as patent_id, r as key, case when cited <> id then cited end as cited from p left join f on f.k = p.r""")
def _(spark, d):
    k = F.col("o_orderkey")
    p = T.read(spark, d, "orders").select(k.alias("patent_id"), F.concat(F.lit("TW-I"), F.floor(k / 2).cast("string"), F.lit("U")).alias("patent_number"), F.array(F.concat(F.lit("twI "), F.floor((k * 7) % 20000 / 2).cast("string"))).alias("references"))
    return C.resolve_references(p).select("patent_id", "key", "cited")


# ---------------------------------------------------------------- classification


@query("ipc_normalised", FACTS + CODES + "select p_partkey, sub || main || '/' || grp as key, sub as subclass, 5 as depth from code")
def _(spark, d):
    key = X.normalize_ipc5(T.raw_code())
    return T.read(spark, d, "part").select("p_partkey", key.alias("key"), X.ipc_subclass(key).alias("subclass"), X.ipc_depth(key).alias("depth"))


@query("ipc_counts", FACTS + CODES + "select sub as key, count(distinct patent_id) as n from pk group by 1")
def _(spark, d):
    return ipc.counts(T.coded_patents(spark, d), 3)


@query("ipc_tree", FACTS + CODES + """, lv as (select patent_id, unnest([1, 2, 3, 4, 5]) as level, unnest([sub[1:1], sub[1:3], sub, sub || main, sub || main || '/' || grp]) as key, unnest([null, sub[1:1], sub[1:3], sub, sub || main]) as parent from pk)
select level, key, parent, count(distinct patent_id) as n from lv group by 1, 2, 3""")
def _(spark, d):
    return ipc.tree(T.coded_patents(spark, d), 5)


@query("ipc_dominant", FACTS + CODES + ", k as (select distinct patent_id, sub from pk), n as (select concept, sub, count(*) as c from mc join k using (patent_id) group by 1, 2) select concept, sub as key from n qualify row_number() over (partition by concept order by c desc, sub) = 1")
def _(spark, d):
    return ipc.dominant(T.membership(spark, d), T.coded_patents(spark, d), 3)


@query("ipc_selection", FACTS + CODES + "select distinct patent_id from pk where sub[1:1] in ('B', 'G')")
def _(spark, d):
    return ipc.selected(T.coded_patents(spark, d), 1, ["B", "G"])


@query("ipc_colours", FACTS + CODES + f"select key, list_extract({ipc.IPC_COLOURS}, cast((row_number() over (order by key) - 1) % 12 + 1 as integer)) as colour from (select distinct sub as key from pk)")
def _(spark, d):
    return ipc.colours(ipc.patent_keys(T.coded_patents(spark, d), 3))


# ---------------------------------------------------------------- views

COHORT = "year between 1996 and 1999 and file in ('1-URGENT', '2-HIGH')"
OPTIONS = ViewOptions(min_support=2, year_range=(1996, 1999), source_files=("1-URGENT", "2-HIGH"))


def cohort_sql(facts: str, where: str) -> str:
    return facts.replace("o_orderdate from orders)", "o_orderdate from orders),\npat0 as (select * from pat)", 1).replace("from pat union", f"from pat where {where} union").replace("from pat where patent_id % 5 = 0", f"from pat where patent_id % 5 = 0 and {where}").replace("on l_partkey = p_partkey)", f"on l_partkey = p_partkey join pat on patent_id = l_orderkey where {where})", 1)


@query("cohort", FACTS + f"select patent_id from pat where {COHORT}")
def _(spark, d):
    return views.cohort(T.graph(spark, d), OPTIONS)


@query("cohort_by_code", FACTS + CODES + "select distinct patent_id from pat join pk using (patent_id) where file in ('1-URGENT') and sub[1:3] in ('B11', 'C12', 'D13')")
def _(spark, d):
    return views.cohort(T.graph(spark, d), ViewOptions(source_files=("1-URGENT",), ipc_filter=("B11", "C12", "D13"), ipc_level=2))


@query("concept_view_nodes", cohort_sql(FACTS, COHORT) + YEARS + "select concept, f as frequency, n as applicant_count, m as median_year, round(greatest(10, least(72, 10 + 10 * sqrt(f))), 9) as size from freq join na using (concept) left join med using (concept)")
def _(spark, d):
    v = views.concept_view(T.graph(spark, d), OPTIONS)
    return v.nodes.select("concept", "frequency", "applicant_count", "median_year", r9("size").alias("size"))


@query("concept_view_edges", cohort_sql(FACTS, COHORT) + YEARS + """select case when x.m > y.m then b else a end as "from", case when x.m > y.m then a else b end as "to", s as support, coalesce(x.m <> y.m, false) as directed, round(s / cast(fx.f + fy.f - s as double), 9) as jaccard,
 round(ln((s / t.n) / ((fx.f / t.n) * (fy.f / t.n))) / -ln(s / t.n), 9) as npmi from pairs left join med x on x.concept = a left join med y on y.concept = b join freq fx on fx.concept = a join freq fy on fy.concept = b cross join (select count(*) as n from pat where """ + COHORT + ") t where s >= 2")
def _(spark, d):
    v = views.concept_view(T.graph(spark, d), OPTIONS)
    return v.edges.select("from", "to", "support", "directed", r9("jaccard").alias("jaccard"), r9("npmi").alias("npmi"))


@query("concept_view_applicants", FACTS + UNIT_METRICS.replace("select e.a, e.b, support,", "select e.a, e.b, support, na as xx,").replace("from e cross join t", "from e cross join t").split("select e.a, e.b")[0] + ", n0 as (select count(distinct applicant) as n from own) select least(a, b) as a, greatest(a, b) as b, sa as support_applicants, round(case when sa / n < 1 - 1e-12 then ln((sa / n) / ((na / n) * (nb / n))) / -ln(sa / n) end, 9) as npmi_applicants from e cross join n0 where sa >= 3")
def _(spark, d):
    v = views.concept_view(T.graph(spark, d), ViewOptions(unit="applicant", min_support=3))
    return v.edges.select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"), "support_applicants", r9("npmi_applicants").alias("npmi_applicants"))


@query("concept_view_semantic", FACTS + RELS + """select 'semantic' as kind, source as "from", target as "to", relation, count(distinct patent_id) as support from rel group by 1, 2, 3, 4 union all select 'cooccurrence', a, b, null, s from pairs""")
def _(spark, d):
    e = views.concept_view(T.graph(spark, d), ViewOptions(show_semantic=True)).edges
    together = F.col("kind") == "cooccurrence"
    return e.select("kind", F.when(together, F.least("from", "to")).otherwise(F.col("from")).alias("from"), F.when(together, F.greatest("from", "to")).otherwise(F.col("to")).alias("to"), "relation", "support")


@query("concept_view_sources", BRANDS + f", t as (select concept, min(file) as lo, max(file) as hi from mc join pat using (patent_id) group by 1), fs as (select file, row_number() over (order by file) as i from (select distinct file from pat)) select concept, case when lo = hi then list_extract({views.SOURCE_COLOURS}, cast((i - 1) % 8 + 1 as integer)) else '{views.SOURCE_OVERLAP}' end as colour from t join fs on fs.file = lo")
def _(spark, d):
    g = T.graph(spark, d)
    nodes = network.concept_frequency(_brands(spark, d))
    return views.colour_nodes(g, nodes, _brands(spark, d), ViewOptions(colour_mode="source")).select("concept", "colour")


@query("concept_view_ipc_colours", FACTS + CODES + f", k as (select distinct patent_id, sub from pk), n as (select concept, sub, count(*) as c from mc join k using (patent_id) group by 1, 2), top as (select concept, sub from n qualify row_number() over (partition by concept order by c desc, sub) = 1), rk as (select sub, row_number() over (order by sub) as i from (select distinct sub from pk)) select concept, list_extract({ipc.IPC_COLOURS}, cast((i - 1) % 12 + 1 as integer)) as colour from top join rk using (sub)")
def _(spark, d):
    g = T.graph(spark, d)
    return views.colour_nodes(g, network.concept_frequency(g.membership), g.membership, ViewOptions(colour_mode="ipc")).select("concept", "colour")


def _with_communities(spark, d):
    from dataclasses import replace

    own = network.concept_frequency(T.membership(spark, d)).select("concept", (F.ascii("concept") % 7).cast("int").alias("community_id"), (F.length("concept") % 12).cast("int").alias("community_id_applicants"))
    return replace(T.graph(spark, d), communities=own)


@query("concept_view_communities", FACTS + f"""select concept, ascii(concept) % 7 as community_id, list_extract({views.COMMUNITY_COLOURS}, cast(ascii(concept) % 7 + 1 as integer)) as colour, list_extract({views.APPLICANT_COMMUNITY_COLOURS}, cast(length(concept) % 12 % 10 + 1 as integer)) as colour_applicants from freq""")
def _(spark, d):
    g = _with_communities(spark, d)
    nodes = network.concept_frequency(g.membership).join(g.communities, "concept")
    one = views.colour_nodes(g, nodes, g.membership, ViewOptions())
    other = views.colour_nodes(g, nodes, g.membership, ViewOptions(unit="applicant")).select("concept", F.col("colour").alias("colour_applicants"))
    return one.join(other, "concept").select("concept", "community_id", "colour", "colour_applicants")


@query("concept_view_community_list", FACTS + f""", dg as (select c, count(*) as dg from (select a as c from pairs union all select b from pairs) group by 1)
select ascii(concept) % 7 as community_id, arg_min(concept, {{'d': -coalesce(dg, 0), 'c': concept}}) as name, list_extract({views.COMMUNITY_COLOURS}, cast(ascii(any_value(concept)) % 7 + 1 as integer)) as colour, count(*) as node_count from freq left join dg on dg.c = concept group by 1""")
def _(spark, d):
    return views.concept_view(_with_communities(spark, d), ViewOptions()).communities.select("community_id", "name", "colour", "node_count")


@query("context_view_nodes", cohort_sql(FACTS, COHORT) + "select 'applicant:' || cast(applicant as varchar) as id, 'applicant' as type, count(distinct patent_id) as n from own group by 1 union all select 'patent:' || cast(patent_id as varchar), 'patent', 1 from pat where " + COHORT + " union all select 'concept:' || concept, 'concept', f from freq where f >= 50")
def _(spark, d):
    v = views.context_view(T.graph(spark, d), ViewOptions(mode="context", min_support=50, year_range=(1996, 1999), source_files=("1-URGENT", "2-HIGH")))
    return v.nodes.select("id", "type", "n")


@query("context_view_edges", cohort_sql(FACTS, COHORT) + """select '申請了' as relation, 'applicant:' || cast(applicant as varchar) as "from", 'patent:' || cast(patent_id as varchar) as "to" from own union all select '包含', 'patent:' || cast(patent_id as varchar), 'concept:' || concept from mc join freq using (concept) where f >= 50""")
def _(spark, d):
    v = views.context_view(T.graph(spark, d), ViewOptions(mode="context", min_support=50, year_range=(1996, 1999), source_files=("1-URGENT", "2-HIGH")))
    return v.edges.select("relation", "from", "to")


PARTS = "with held as (select distinct o_custkey as applicant, l_partkey as concept from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT')"


def _part_graph(spark, d):
    g = T.graph(spark, d)
    m = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("patent_id"), F.col("l_partkey").alias("concept")).distinct()
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("patent_id"), F.col("o_custkey").alias("applicant"))
    return views.Graph(g.patents, m, o)


INSTITUTIONS = ViewOptions(mode="institution", min_support=2, source_files=("1-URGENT",))


@query("institution_view_edges", PARTS + " select x.applicant as a, y.applicant as b, count(*) as support from held x join held y on x.concept = y.concept and x.applicant < y.applicant group by 1, 2 having count(*) >= 2")
def _(spark, d):
    return views.institution_view(_part_graph(spark, d), INSTITUTIONS).edges.select("a", "b", "support")


@query("institution_view_nodes", PARTS + ", e as (select x.applicant as a, y.applicant as b from held x join held y on x.concept = y.concept and x.applicant < y.applicant group by 1, 2 having count(*) >= 2) select applicant, count(*) as concept_count, round(least(52, 18 + 5 * sqrt(count(*))), 9) as size from held where applicant in (select a from e union select b from e) group by 1")
def _(spark, d):
    return views.institution_view(_part_graph(spark, d), INSTITUTIONS).nodes.select("applicant", "concept_count", r9("size").alias("size"))


@query("institution_shared_concepts", PARTS.replace("where o_orderpriority = '1-URGENT'", "") + ", two as (select applicant from held group by 1 order by count(*) desc, applicant limit 2) select concept from held join two using (applicant) group by 1 having count(*) = 2")
def _(spark, d):
    g = _part_graph(spark, d)
    held = network.applicant_concepts(g.membership, g.ownership)
    two = [r["applicant"] for r in held.groupBy("applicant").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "applicant").limit(2).collect()]
    return views.shared_concept_list(held, *two)


@query("graph_stats", FACTS + "select (select count(*) from pat) as patent_count, (select min(year) from pat) as year_from, (select max(year) from pat) as year_to, (select count(distinct applicant) from own) as applicant_count, (select count(distinct concept) from mc) as concept_count")
def _(spark, d):
    return views.graph_stats(T.graph(spark, d))


@query("structural_edges", FACTS + """select '申請了' as relation, 'applicant:' || cast(applicant as varchar) as "from", 'patent:' || cast(patent_id as varchar) as "to" from own union all select '包含', 'patent:' || cast(patent_id as varchar), 'concept:' || concept from mc""")
def _(spark, d):
    return views.structural_edges(T.membership(spark, d), T.ownership(spark, d)).select("relation", "from", "to")


@query("facts_round_trip", FACTS + "select cast(patent_id as varchar) as patent_id, concept from mc")
def _(spark, d):
    return views.facts_of(views.structural_edges(T.membership(spark, d), T.ownership(spark, d)))[0]


@query("applicant_colours", FACTS + f", f as (select applicant, min(patent_id) as o from own group by 1) select applicant, list_extract({views.COMMUNITY_COLOURS}, cast((row_number() over (order by o, applicant) - 1) % 10 + 1 as integer)) as colour from f")
def _(spark, d):
    own = T.ownership(spark, d)
    return views.applicant_colours(own, T.patents(spark, d).select("patent_id", F.col("patent_id").alias("ordinal")))


@query("topology_fingerprint", FACTS + ", n as (select count(*) as c, string_agg(concept, chr(10) order by concept) as t from freq), e as (select count(*) as c, string_agg(x, chr(10) order by x) as t from (select a || '~' || b || '|' || a || '|' || b as x from pairs)) select 'n=' || cast(n.c as varchar) || ':' || lpad(lower(hex(" + FNV.format(text="n.t") + ")), 8, '0') || '|e=' || cast(e.c as varchar) || ':' || lpad(lower(hex(" + FNV.format(text="e.t") + ")), 8, '0') as fingerprint from n cross join e")
def _(spark, d):
    e = network.cooccurrence(T.membership(spark, d)).select(F.concat_ws("~", "a", "b").alias("id"), F.col("a").alias("from"), F.col("b").alias("to"))
    return views.fingerprint(network.concept_frequency(T.membership(spark, d)).select(F.col("concept").alias("id")), e)


# ---------------------------------------------------------------- comparisons


@query("compare_membership", FACTS + """, p as (select concept as id, 1 as panel from mc join pat using (patent_id) where file = '1-URGENT' and year = 1996 union select concept, 2 from mc join pat using (patent_id) where file = '2-HIGH' and year = 1997 union select concept, 3 from mc join pat using (patent_id) where file = '5-LOW' and year = 1998),
g as (select id, string_agg(cast(panel as varchar), ',' order by panel) as panels, count(*) as n from p group by 1) select id, panels, case when n >= 3 then 'shared' when n <= 1 then 'unique' else 'partial' end as membership from g""")
def _(spark, d):
    g, m = T.patents(spark, d), T.membership(spark, d)
    frames = [m.join(g.filter(F.array_contains("source_files", f) & (F.col("year") == y)).select("patent_id"), "patent_id", "left_semi").select(F.col("concept").alias("id")).distinct() for f, y in (("1-URGENT", 1996), ("2-HIGH", 1997), ("5-LOW", 1998))]
    out = compare.membership(compare.tagged(frames), 3)
    return out.select("id", F.array_join(F.transform("panels", lambda x: x.cast("string")), ",").alias("panels"), "membership")


@query("compare_summary", FACTS + """, p as (select distinct applicant as id, 1 as panel from own join pat p using (patent_id, applicant) where file = '1-URGENT' union select distinct applicant, 2 from own join pat p using (patent_id, applicant) where file = '2-HIGH'),
g as (select id, count(*) as k, min(panel) as p from p group by 1) select count(*) as union_count, count(*) filter (k = 2) as shared, count(*) filter (k = 1 and p = 1) as a_only, count(*) filter (k = 1 and p = 2) as b_only, round(count(*) filter (k = 2) / cast(count(*) as double), 9) as jaccard from g""")
def _(spark, d):
    p = T.patents(spark, d)
    frames = [p.filter(F.array_contains("source_files", f)).select(F.col("applicant").alias("id")).distinct() for f in ("1-URGENT", "2-HIGH")]
    return compare.summary(compare.tagged(frames), 2).withColumn("jaccard", r9("jaccard"))


@query("compare_overlap", FACTS + ", p as (select distinct applicant as id, file from pat) select n_panels, count(*) as n from (select id, count(*) as n_panels from p group by 1) group by 1")
def _(spark, d):
    p = T.patents(spark, d)
    files = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    frames = [p.filter(F.array_contains("source_files", f)).select(F.col("applicant").alias("id")).distinct() for f in files]
    return compare.overlap(compare.tagged(frames), 5)


@query("compare_shared_concepts", BRANDS + ", s as (select concept, bool_or(file = '1-URGENT') as x, bool_or(file = '2-HIGH') as y from mc join pat using (patent_id) group by 1), c as (select count(*) filter (x and not y) as a_only, count(*) filter (y and not x) as b_only, count(*) filter (x and y) as shared from s) select a_only, b_only, shared, a_only + b_only + shared as union_count, round(shared / cast(a_only + b_only + shared as double), 9) as jaccard from c")
def _(spark, d):
    return compare.shared_concepts(_brands(spark, d), T.patents(spark, d), ["1-URGENT"], ["2-HIGH"]).withColumn("jaccard", r9("jaccard"))


@query("compare_panels", FACTS + ", p as (select patent_id, 1 as panel from pat where file in ('1-URGENT') union all select patent_id, 2 from pat where file in ('1-URGENT', '2-HIGH') union all select patent_id, 3 from pat) select panel, x.concept as a, y.concept as b, count(*) as support from mc x join mc y on x.patent_id = y.patent_id and x.concept < y.concept join p on p.patent_id = x.patent_id group by 1, 2, 3")
def _(spark, d):
    return compare.panel_cooccurrence(T.membership(spark, d), T.patents(spark, d), [["1-URGENT"], ["1-URGENT", "2-HIGH"], []])


@query("union_first_panel", FACTS + ", u as (select applicant as id, year, 0 as p from pat where file = '1-URGENT' union all select applicant, year, 1 from pat where file = '2-HIGH') , f as (select id, p, min(year) as year from u group by 1, 2) select id, year from f qualify row_number() over (partition by id order by p) = 1")
def _(spark, d):
    p = T.patents(spark, d)
    frames = [p.filter(F.array_contains("source_files", f)).groupBy(F.col("applicant").alias("id")).agg(F.min("year").alias("year")) for f in ("1-URGENT", "2-HIGH")]
    return compare.union_first(frames)


# ---------------------------------------------------------------- graph algorithms

PAIRS = ", big as (select a, b, s from pairs)"


def _all_pairs(spark, d):
    """Every co-occurrence pair."""
    return network.cooccurrence(T.membership(spark, d))


@query("hops_from_centre", FACTS + PAIRS + """, e as (select a as f, b as t from big union select b, a from big), c as (select min(a) as id from big),
h1 as (select distinct t as id from e join c on f = c.id), h2 as (select distinct t as id from e join h1 on f = h1.id)
select id, min(hop) as hop from (select id, 0 as hop from c union all select id, 1 from h1 union all select id, 2 from h2) group by 1""")
def _(spark, d):
    e = _all_pairs(spark, d).select(F.col("a").alias("from"), F.col("b").alias("to"))
    return subgraph.reach(e.agg(F.min("from").alias("id")), e, 2)


@query("keyword_subgraph", FACTS + PAIRS + """, n as (select concept as id from freq where contains(lower(concept), 'al')), e as (select a as f, b as t from big union select b, a from big), k as (select id from n union select t from e join n on f = n.id) select a, b from big where a in (select id from k) and b in (select id from k)""")
def _(spark, d):
    e = _all_pairs(spark, d).select(F.col("a").alias("from"), F.col("b").alias("to"))
    nodes = network.concept_frequency(T.membership(spark, d)).select(F.col("concept").alias("id"), F.col("concept").alias("label"))
    return subgraph.by_keyword(nodes, e, "AL", 1)[1].select(F.col("from").alias("a"), F.col("to").alias("b"))


@query("node_search", FACTS + "select concept as id from freq where contains(lower(concept), 'a') order by concept limit 25")
def _(spark, d):
    nodes = network.concept_frequency(T.membership(spark, d)).select(F.col("concept").alias("id"), F.col("concept").alias("label"))
    return subgraph.search(nodes, "A").select("id")


@query("centre_neighbours", FACTS + ", c as (select min(a) as id from pairs) select case when a = c.id then b else a end as neighbour, round(s / cast(x.f + y.f - s as double), 9) as jaccard, s as support from pairs join c on c.id in (a, b) join freq x on x.concept = a join freq y on y.concept = b")
def _(spark, d):
    p = network.cooccurrence(T.membership(spark, d))
    centre = p.agg(F.min("a")).first()[0]
    return subgraph.neighbours(p.select(F.col("a").alias("from"), F.col("b").alias("to"), "jaccard", "support"), centre).withColumn("jaccard", r9("jaccard"))


@query("louvain_communities")
def _(spark, d):
    m = T.membership(spark, d)
    return community.detect(network.concept_frequency(m), network.cooccurrence(m).select("a", "b", "support"))


@query("louvain_communities_applicants")
def _(spark, d):
    m = T.membership(spark, d)
    held = network.applicant_concepts(m, T.ownership(spark, d))
    return community.detect(network.concept_frequency(m), network.pairs_by_join(held, "applicant", "concept"), mode="support")


def _fixed_communities(spark, d):
    """Communities that SQL knows as well: the first letter of a concept."""
    return network.concept_frequency(T.membership(spark, d)).select("concept", (F.ascii("concept") % 7).cast("int").alias("community_id"))


@query("community_names", FACTS + ", dg as (select c, count(*) as dg from (select a as c from pairs union all select b from pairs) group by 1) select ascii(concept) % 7 as community_id, arg_min(concept, {'d': -coalesce(dg, 0), 'c': concept}) as name, count(*) as node_count from freq left join dg on dg.c = concept group by 1")
def _(spark, d):
    deg = metrics.node_degrees(network.pairs_by(T.membership(spark, d), "patent_id", "concept").select(F.col("a").alias("from"), F.col("b").alias("to")))
    return community.names(_fixed_communities(spark, d), deg)


@query("community_connectivity", FACTS + PAIRS + """, inn as (select a, b from big where ascii(a) % 7 = ascii(b) % 7), u as (select a as x, b as y from inn union select b, a from inn),
rc as (with recursive r as (select concept as n, concept as m from freq union select u.y, r.m from r join u on u.x = r.n) select n, min(m) as root from r group by 1)
select ascii(n) % 7 as community_id, count(distinct root) as components from rc group by 1""")
def _(spark, d):
    return community.connectivity(_fixed_communities(spark, d), _all_pairs(spark, d).select("a", "b"))


@query("surprising_connections", FACTS + PAIRS + """, x as (select a, b, s as support, ascii(a) % 7 as ca, ascii(b) % 7 as cb from big), y as (select *, count(*) over (partition by least(ca, cb), greatest(ca, cb)) as n from x where ca <> cb)
select a, b, ca, cb, support, 1 / n as bridge_rarity from y where n <= 2 order by bridge_rarity desc, support desc, a, b limit 15""")
def _(spark, d):
    return community.surprising(_all_pairs(spark, d).select("a", "b", "support"), _fixed_communities(spark, d))


@query("primary_labels", FACTS + YEARS + """, e as (select case when x.m > y.m then b else a end as f, case when x.m > y.m then a else b end as t, coalesce(x.m <> y.m, false) as directed from pairs left join med x on x.concept = a left join med y on y.concept = b),
dg as (select id, count(*) as degree, sum(i) as ind, sum(o) as outd from (select f as id, 0 as i, cast(directed as integer) as o from e union all select t, cast(directed as integer), 0 from e) group by 1),
n as (select concept as id, ascii(concept) % 7 as c, f as frequency, coalesce(degree, 0) as degree, coalesce(ind, 0) as ind, coalesce(outd, 0) as outd from freq left join dg on dg.id = concept),
best as (select c, arg_min(id, {'s': -(degree + frequency), 'i': id}) as id from n group by 1),
every as (select * from (select id, 1 as priority, degree, 0 as c from n where ind = 0 and outd > 0 order by degree desc, id limit 35)
 union all select * from (select id, 2, degree, 0 from n order by degree desc, id limit 3)
 union all select n.id, 3, n.degree, best.c from best join n using (id)
 union all select * from (select id, 4, degree, 0 from n order by degree desc, id limit 35)),
chosen as (select * from every qualify row_number() over (partition by id order by priority) = 1)
select id, priority, degree from chosen order by priority, case when priority = 3 then c else 0 end, degree desc, id limit 35""")
def _(spark, d):
    m = T.membership(spark, d)
    s = temporal.year_stats(temporal.concept_years(m, T.patents(spark, d), T.MAX_YEAR))
    e = temporal.directed(network.cooccurrence(m).select("a", "b", "support"), s)
    nodes = _fixed_communities(spark, d).join(network.concept_frequency(m), "concept").withColumnRenamed("concept", "id")
    return publish.primary_labels(nodes, e, publish.primary_label_cap(180))


@query("reveal_waves", FACTS + "select concept as id, cast(floor((row_number() over (order by concept) - 1) * 8 / count(*) over ()) * 120 as bigint) as delay_ms from freq")
def _(spark, d):
    return publish.reveal_waves(network.concept_frequency(T.membership(spark, d)).withColumnRenamed("concept", "id"), 8, 120)


# ---------------------------------------------------------------- entity resolution

STAGED = """with o as (select o_orderkey as k, * from orders), st0 as (select k as row_id, case when k % 3 <> 0 then 'I' || cast(k // 4 as varchar) end as pn, case when k % 7 <> 0 then cast(k // 6 as varchar) end as an, 'TITLE' || cast((k // 3) % 5 as varchar) as tk,
 'title ' || cast((k // 3) % 5 as varchar) as title, 'abstract ' || cast(k % 11 as varchar) as abstract, strftime(o_orderdate, '%Y-%m-%d') as filing_date, 'applicant ' || cast(o_custkey % 50 as varchar) as applicant, o_orderpriority as file, cast(k % 13 as integer) as cited, strftime(o_orderdate + to_days(case when k % 9 = 0 then -10 else 500 end), '%Y-%m-%d') as publication_date, 'P' || cast(k % 17 as varchar) as publication_number, 'class ' || cast(k % 5 as varchar) as design_class, case when k % 3 <> 0 then 'TWI' || cast(k // 4 as varchar) || 'U' end as patent_number, case when k % 7 <> 0 then 'tw' || cast(k // 6 as varchar) end as application_number,
 case when o_orderstatus = 'F' then '核駁' when o_orderstatus = 'O' then '公開' else '核准' end as status from o)"""
GROUPED = STAGED + """, link as (select x.row_id as u, y.row_id as v from st0 x join st0 y on x.tk = y.tk and x.row_id <> y.row_id and abs(x.row_id - y.row_id) < 64 where (x.pn = y.pn) or ((x.pn is null or y.pn is null) and x.an = y.an)),
rc as (with recursive r as (select row_id as n, row_id as m from st0 union select link.v, r.m from r join link on link.u = r.n) select n as row_id, min(m) as group_id from r group by 1)"""


@query("identifier_keys", STAGED + " select row_id, pn, an, tk from st0")
def _(spark, d):
    return resolve.staged(T.staged_orders(spark, d), fold=False).select("row_id", "pn", "an", "tk")


@query("resolution_groups", GROUPED + " select row_id, group_id from rc")
def _(spark, d):
    return resolve.groups(resolve.staged(T.staged_orders(spark, d), fold=False))


@query("resolution_merge", GROUPED + """, j as (select * from rc join st0 using (row_id)), m as (select group_id, count(*) as n_rows, min(filing_date) as filing_date, string_agg(distinct file, ',' order by file) as files, max(cited) as cited_by_count,
 arg_min(abstract, {'n': -length(abstract), 't': abstract}) as abstract, arg_min(status, {'s': case status when '核駁' then -3 when '公開' then -2 else -1 end, 't': status}) as case_status, string_agg(distinct applicant, '；' order by applicant) as applicant, min(title) as title, min(publication_date) as publication_date, min(publication_number) as publication_number, min(design_class) as design_class, arg_min(patent_number, {'n': -length(patent_number), 't': patent_number}) as patent_number, min(application_number) as application_number, string_agg(distinct coalesce(an, ''), ',' order by coalesce(an, '')) filter (an is not null) as application_numbers, string_agg(distinct status, ',' order by status) as case_statuses from j group by 1),
inv as (select group_id, string_agg(distinct v, ',' order by v) as inventors from (select group_id, 'inventor ' || cast(row_id % 3 as varchar) as v from rc union select group_id, 'inventor ' || cast(row_id % 4 as varchar) from rc) group by 1) select m.* replace (coalesce(application_numbers, '') as application_numbers), inventors from m join inv using (group_id)""")
def _(spark, d):
    st = resolve.staged(T.staged_orders(spark, d), fold=False)
    m = resolve.merged(st, resolve.groups(st), fold=False)
    lists = [F.array_join(c, ",").alias(c) for c in ("application_numbers", "case_statuses", "inventors")]
    return m.select("group_id", "n_rows", "filing_date", F.array_join("source_files", ",").alias("files"), "cited_by_count", "abstract", "case_status", "applicant", "title", "publication_date", "publication_number", "design_class", "patent_number", "application_number", *lists)


@query("stable_ids", STAGED + " select row_id, sha1(case when pn is not null then 'pn|' || pn || '|' || tk when an is not null then 'an|' || an || '|' || tk else 'noid|' || tk || '|' || sha1(abstract) || '|' || applicant || '|' || filing_date end) as id from st0")
def _(spark, d):
    s = T.staged_orders(spark, d)
    return s.select("row_id", X.stable_patent_id(F.col("patent_number"), F.col("application_number"), F.col("title"), F.col("abstract"), F.col("applicants"), F.col("filing_date"), fold=False).alias("id"))


@query("title_conflicts", STAGED + " select pn, string_agg(distinct tk, ',' order by tk) as titles from st0 where pn is not null group by 1 having count(distinct tk) > 1")
def _(spark, d):
    return resolve.title_conflicts(resolve.staged(T.staged_orders(spark, d), fold=False)).select("pn", F.array_join("titles", ",").alias("titles"))


@query("number_collisions", STAGED + " select an, count(*) as n from st0 where an is not null group by 1 having count(distinct pn) > 1 or (count(distinct tk) > 1 and bool_or(pn is null))")
def _(spark, d):
    return resolve.number_collisions(resolve.staged(T.staged_orders(spark, d), fold=False)).select("an", F.size("rows").cast("long").alias("n"))


@query("unidentified_rows", STAGED + " select row_id, title from st0 where pn is null and an is null")
def _(spark, d):
    return resolve.unidentified(resolve.staged(T.staged_orders(spark, d), fold=False))


@query("merge_warnings", GROUPED + ", j as (select * from rc join st0 using (row_id)), w as (select 'appno_conflicts' as kind from j group by group_id having count(distinct an) > 1 union all select 'case_status_conflicts' from j group by group_id having count(distinct status) > 1) select kind, count(*) as n from w group by 1")
def _(spark, d):
    st = resolve.staged(T.staged_orders(spark, d), fold=False)
    return resolve.warning_summary(resolve.merge_warnings(resolve.merged(st, resolve.groups(st), fold=False)))


@query("identity_conflicts", GROUPED + " select group_id from rc join st0 using (row_id) group by 1 having count(distinct applicant) > 1")
def _(spark, d):
    st = resolve.staged(T.staged_orders(spark, d), fold=False)
    return resolve.identity_conflicts(st, resolve.groups(st), fold=False)


@query("date_warnings", "select o_orderkey as row_id, 'date_out_of_range' as kind from orders where year(o_orderdate) > 1997 union all select o_orderkey, 'publication_before_filing' from orders where o_orderkey % 9 = 0")
def _(spark, d):
    return resolve.date_warnings(T.staged_orders(spark, d), 1997)


@query("pair_rules", STAGED + """ select x.row_id as a, y.row_id as b, case when x.pn is not null and y.pn is not null then case when x.pn = y.pn then case when x.tk = y.tk then '1a' else '1b' end else '1c' end
 when x.an is not null and y.an is not null then case when x.an = y.an then case when x.tk = y.tk then '2a' else '2b' end else '2c' end else '3' end as rule from st0 x join st0 y on y.row_id = x.row_id + 1""")
def _(spark, d):
    s = resolve.staged(T.staged_orders(spark, d), fold=False).select("row_id", "pn", "an", "tk")
    t = s.select(*[F.col(c).alias(f"{c}2") for c in s.columns])
    j = s.join(t, F.col("row_id2") == F.col("row_id") + 1)
    return j.select(F.col("row_id").alias("a"), F.col("row_id2").alias("b"), resolve.pair_decision(F.col("pn"), F.col("an"), F.col("tk"), F.col("pn2"), F.col("an2"), F.col("tk2")).alias("rule"))


# ---------------------------------------------------------------- sampling, ingest, parsing


@query("sample_plan", "select o_orderpriority as source_file, count(*) as available, least(100, count(*)) as allocated from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 1 union all select null, count(*), least(100, count(*)) from orders where o_orderpriority not in ('1-URGENT', '5-LOW')")
def _(spark, d):
    return sampling.plan(T.patents(spark, d), ["1-URGENT", "5-LOW"], 100)


@query("sampled_patents", """with p as (select case when o_orderpriority in ('1-URGENT', '5-LOW') then o_orderpriority end as source_file, o_orderkey as patent_id from orders)
select source_file, patent_id from p qualify row_number() over (partition by source_file order by md5(cast(patent_id as varchar) || ':7'), patent_id) <= 100""")
def _(spark, d):
    return sampling.sample(T.patents(spark, d), ["1-URGENT", "5-LOW"], 100, seed=7).select("source_file", "patent_id")


@query("answer_parsing", "select event_id, cast(json_extract(props, '$.k') as double) as weight from events")
def _(spark, d):
    e = T.read(spark, d, "events")
    answer = F.concat(F.lit('Here: ```json\n[{"keywords":["x"],"relations":[{"source":"a","target":"b","relation":"r","weight":'), F.get_json_object("props", "$.k"), F.lit("}]}]\n```"))
    rel = extraction.clean_relations(F.get(extraction.answer_items(answer), F.lit(0))["relations"])
    return e.select("event_id", F.get(rel, F.lit(0))["weight"].alias("weight"))


@query("excel_dates", "select o_orderkey, strftime(date '1899-12-30' + cast(30000 + o_orderkey % 20000 as integer), '%Y-%m-%d') as d from orders")
def _(spark, d):
    return T.read(spark, d, "orders").select("o_orderkey", N.coerce_date((30000 + F.col("o_orderkey") % 20000).cast("string")).alias("d"))


@query("filing_years", "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as sort_key, cast(year(o_orderdate) as integer) as year, year(o_orderdate) between 1990 and 1998 as valid from orders")
def _(spark, d):
    s = F.date_format("o_orderdate", "yyyy/M/d")
    y = N.filing_year(s)
    return T.read(spark, d, "orders").select("o_orderkey", N.date_sort_key(s).alias("sort_key"), y.alias("year"), N.is_valid_year(y, 1998).alias("valid"))


@query("applicant_names", "select c_custkey, split_part(c_name, ' ', 1) as name, 'TW' as country, upper(regexp_replace(c_name, '\\s', '', 'g')) || '公司' as merge_key from customer")
def _(spark, d):
    c = T.read(spark, d, "customer")
    raw = F.concat(F.col("c_name"), F.lit(" some street (X) (TW)"))
    return c.select("c_custkey", X.clean_applicant_name(raw).alias("name"), X.extract_country(raw).alias("country"), X.normalize_applicant_name(F.concat("c_name", F.lit(" Co., Ltd.")), fold=False).alias("merge_key"))


@query("organisation_types", "select c_custkey, case c_custkey % 4 when 0 then '銀行' when 1 then '學研' when 2 then '科技資訊' else '其他' end as kind, case c_custkey % 4 when 0 then '銀行' when 1 then '大學' when 2 then '科技' else '學研' end as institution from customer")
def _(spark, d):
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, " Bank").when(k == 1, " University").when(k == 2, " Software").otherwise(" Ltd"))
    return T.read(spark, d, "customer").select("c_custkey", X.classify_org_type(name).alias("kind"), X.institution_type_of(name).alias("institution"))


@query("split_applicant_cells", "select o_orderkey, cast(o_custkey as varchar) || case when o_custkey % 2 = 0 then '|other' else '' end as names from orders")
def _(spark, d):
    cell = F.concat(F.col("o_custkey").cast("string"), F.lit("；"), F.when(F.col("o_custkey") % 2 == 0, "other; ").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))))
    return T.read(spark, d, "orders").select("o_orderkey", F.array_join(X.split_applicants(cell), "|").alias("names"))


@query("keyword_matches", "select doc_id from documents where contains(lower(text), 'tion the')")
def _(spark, d):
    return T.read(spark, d, "documents").filter(X.matches_keyword("Tion the", F.col("text"))).select("doc_id")


@query("stable_edge_ids", FACTS + "select a, b, 'e:cooccurrence:' || lpad(lower(hex(" + FNV.format(text="""'["cooccurrence","' || a || '","' || b || '"]'""") + ")), 8, '0') as edge_id from pairs")
def _(spark, d):
    return network.pairs_by(T.membership(spark, d), "patent_id", "concept").select("a", "b", X.stable_edge_id("cooccurrence", F.col("a"), F.col("b")).alias("edge_id"))


@query("keyword_extraction", """with w as (select cast(doc_id as varchar) as patent_id, list_transform(list_sort(list_filter([{'p': instr(t, 'tion'), 'w': 'tion'}, {'p': instr(t, 'ment'), 'w': 'ment'}, {'p': instr(t, 'ung'), 'w': 'ung'}, {'p': instr(t, 'ción'), 'w': 'ción'}], lambda x: x.p > 0)), lambda x: x.w) as k from (select doc_id, ' ' || coalesce(text, '') as t from documents))
select patent_id, array_to_string(k, ',') as keywords, cast(greatest(len(k) - 1, 0) as integer) as n_relations from w""")
def _(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("patent_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    return extraction.extract(docs, extraction.keyword_extractor(["tion", "ment", "ung", "ción"])).select("patent_id", F.array_join("keywords", ",").alias("keywords"), F.size("relations").alias("n_relations"))


# ---------------------------------------------------------------- stores and lists


@query("membership_derivation", FACTS + "select 'membership' as fact, 'patent:' || cast(patent_id as varchar) as patent, 'concept:' || concept as other from mc union all select 'ownership', 'patent:' || cast(patent_id as varchar), 'applicant:' || cast(applicant as varchar) from own join customer on c_custkey = applicant")
def _(spark, d):
    """Facts out of stored edges; of the applicants only known customers are nodes, so the second one of some patents is refused."""
    e = views.structural_edges(T.membership(spark, d), T.ownership(spark, d))
    ids = lambda df, c, kind: df.select(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("id")).distinct()
    p, c = ids(T.patents(spark, d), "patent_id", "patent"), ids(T.membership(spark, d), "concept", "concept")
    m, o = store.membership_from_edges(e, p, c, ids(T.read(spark, d, "customer"), "c_custkey", "applicant"))
    return m.select(F.lit("membership").alias("fact"), "patent", F.col("concept").alias("other")).union(o.select(F.lit("ownership"), "patent", "applicant"))


@query("history_list", "select cast(o_orderkey as varchar) as analysis_id, o_orderstatus as status from orders order by o_orderdate desc, cast(o_orderkey as varchar) limit 200")
def _(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("analysis_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return catalog.history(o, most=500).select("analysis_id", "status")


@query("community_composition", FACTS + "select cast(ascii(concept) % 7 as integer) as community_id, count(*) as n from freq group by 1")
def _(spark, d):
    return subgraph.community_composition(_fixed_communities(spark, d))


@query("subgraph_metrics", FACTS + ", c as (select min(a) as id from pairs) select count(*) as direct_edges, count(distinct case when a = c.id then b else a end) as direct_neighbours from pairs join c on c.id in (a, b)")
def _(spark, d):
    p = network.cooccurrence(T.membership(spark, d))
    return subgraph.metrics(p.select(F.col("a").alias("from"), F.col("b").alias("to"), "jaccard", "support"), p.agg(F.min("a")).first()[0])


@query("hidden_membership", """with m as (select distinct l_orderkey as patent_id, p_name || ' ' || cast(p_partkey as varchar) as concept from lineitem join part on l_partkey = p_partkey),
n as (select concept as id, bool_or(o_orderpriority = '1-URGENT') as x, bool_or(o_orderpriority = '2-HIGH') as y from m join orders on o_orderkey = patent_id where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1) select id from n where x and not y""")
def _(spark, d):
    """Concepts of the first file's patents that none of the second's has. Concept = name and part: names are on both sides."""
    part = T.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("concept"))
    m = network.laid_out(T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("patent_id"), "l_partkey").join(part, "l_partkey").select("patent_id", "concept"))
    p = T.patents(spark, d)
    frames = [m.join(p.filter(F.array_contains("source_files", f)).select("patent_id"), "patent_id", "left_semi").select(F.col("concept").alias("id")).distinct() for f in ("1-URGENT", "2-HIGH")]
    members = compare.membership(compare.tagged(frames), 2)
    none = spark.createDataFrame([], "id string, `from` string, `to` string")
    return compare.hidden(members, none, members.limit(0), ["a"])[0]


APPLICANT_SIDES = "with n as (select o_custkey as id, bool_or(o_orderpriority = '1-URGENT') as x, bool_or(o_orderpriority = '2-HIGH') as y from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1)"


@query("hidden_edges", APPLICANT_SIDES + ", h as (select id from n where x and not y) select 'e' || cast(c_custkey as varchar) as id from customer where c_custkey % 11 = 0 or c_custkey in (select id from h) or c_custkey + 1 in (select id from h)")
def _(spark, d):
    """Edges from each applicant to the next one, hidden with their ends, or by a class of their own."""
    p = T.patents(spark, d)
    frames = [p.filter(F.array_contains("source_files", f)).select(F.col("applicant").alias("id")).distinct() for f in ("1-URGENT", "2-HIGH")]
    k = F.col("c_custkey")
    edges = T.read(spark, d, "customer").select(F.concat(F.lit("e"), k.cast("string")).alias("id"), k.alias("from"), (k + 1).alias("to"))
    own = T.read(spark, d, "customer").select(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.when(k % 11 == 0, "a").otherwise("shared").alias("membership"))
    return compare.hidden(compare.membership(compare.tagged(frames), 2), edges, own, ["a"])[1]


@query("file_summaries", "select o_orderpriority as file, count(*) as rows, count(*) as with_year, cast(0 as bigint) as with_ipc from orders group by 1")
def _(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"))
    return xlsx.file_summaries(o)


@query("batch_numbers", "with b as (select o_orderkey as patent_id, cast('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8) as bigint) % 1024 as k from orders), n as (select patent_id, k, row_number() over (partition by k order by patent_id) - 1 as n from b) select patent_id, cast(k as varchar) || '-' || cast(n // 5 as varchar) as batch, cast(n % 5 as integer) as place from n")
def _(spark, d):
    return extraction.batch_ids(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("patent_id"))).select("patent_id", "batch", "place")


@query("number_groups", "select p_partkey, case when p_size % 2 = 0 then 'x|' || p_name else p_name end as names from part")
def _(spark, d):
    """A numbered column group with blanks and repeats, as spreadsheets have it."""
    c = F.create_map(F.lit("申請人2"), F.col("p_name"), F.lit("申請人1"), F.when(F.col("p_size") % 2 == 0, "x").otherwise(F.col("p_name")), F.lit("申請人10"), F.lit(" "))
    return T.read(spark, d, "part").withColumn("cells", c).select("p_partkey", F.array_join(xlsx._group("申請人"), "|").alias("names"))


# ---------------------------------------------------------------- references, differences, exports

REFERENCES = "with p as (select o_orderkey as id, 'I' || cast(o_orderkey // 2 as varchar) as k, 'I' || cast((o_orderkey * 7) % 20000 // 2 as varchar) as r from orders), f as (select k, min(id) as cited from p group by 1), c as (select id, r, case when cited <> id then cited end as cited from p left join f on f.k = p.r)"


def _referring(spark, d):
    k = F.col("o_orderkey")
    return T.read(spark, d, "orders").select(k.alias("patent_id"), F.concat(F.lit("TW-I"), F.floor(k / 2).cast("string"), F.lit("U")).alias("patent_number"), F.array(F.concat(F.lit("twI "), F.floor((k * 7) % 20000 / 2).cast("string"))).alias("references"))


@query("reference_split", REFERENCES + ' select id as patent_id, case when cited is not null then r end as "references", case when cited is null then r end as external_references from c')
def _(spark, d):
    split, _cited = C.with_references(_referring(spark, d))
    return split.select("patent_id", F.array_join("references", ",").alias("references"), F.array_join("external_references", ",").alias("external_references"))


@query("reference_citations", REFERENCES + " select distinct id as from_patent, cited as to_patent from c where cited is not null")
def _(spark, d):
    return C.with_references(_referring(spark, d))[1]


SCOPES = [["1-URGENT"], ["2-HIGH"], ["5-LOW"]]
DIFFERENCE = BRANDS + """, w as (select * from mc join pat using (patent_id) where year between 1996 and 1997),
pn as (select *, case file when '1-URGENT' then 1 when '2-HIGH' then 2 when '5-LOW' then 3 end as panel from w where file in ('1-URGENT', '2-HIGH', '5-LOW'))"""


def _kinds(column: str, values: dict) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then '{v}'" for k, v in values.items()) + " end"


def _difference(spark, d):
    from dataclasses import replace

    g = replace(T.graph(spark, d), membership=_brands(spark, d))
    return views.compare_views(g, ViewOptions(year_range=(1996, 1997), min_support=1), SCOPES)


@query("compare_difference_nodes", DIFFERENCE + f""", c as (select concept as id, panel, count(*) as f from pn group by 1, 2), g as (select id, string_agg(cast(panel as varchar), ',' order by panel) as panels, count(*) as n, arg_min(f, panel) as frequency from c group by 1),
m as (select id, panels, frequency, case when n >= 3 then 'shared' when n <= 1 then 'unique' else 'partial' end as membership from g) select *, {_kinds("membership", compare.DIFF_COLOURS)} as colour, {_kinds("membership", compare.DIFF_SHAPES)} as shape from m""")
def _(spark, d):
    nodes = _difference(spark, d)[0]
    return nodes.select("id", F.array_join(F.transform("panels", lambda x: x.cast("string")), ",").alias("panels"), "frequency", "membership", "colour", "shape")


@query("compare_difference_edges", DIFFERENCE + f""", c as (select x.concept as a, y.concept as b, x.panel, count(*) as s from pn x join pn y on x.patent_id = y.patent_id and x.concept < y.concept group by 1, 2, 3), g as (select a, b, count(*) as n, arg_min(s, panel) as support from c group by 1, 2),
m as (select a as "from", b as "to", support, case when n >= 3 then 'shared' when n <= 1 then 'unique' else 'partial' end as membership from g) select *, {_kinds("membership", compare.DIFF_COLOURS)} as colour, {_kinds("membership", compare.DIFF_DASHES)} as dashes from m""")
def _(spark, d):
    return _difference(spark, d)[1].select("from", "to", "support", "membership", "colour", "dashes")


@query("first_edges", FACTS + RELS + ", e as (select source || '>' || target as id, patent_id, ordinal, relation from rel) select id, patent_id, relation from e qualify row_number() over (partition by id order by patent_id, ordinal) = 1")
def _(spark, d):
    r = network.admissible(T.relations(spark, d), T.membership(spark, d)).select(F.concat("source", F.lit(">"), "target").alias("id"), "patent_id", "relation", F.struct("patent_id", "ordinal").alias("at"))
    return compare.first_by_id(r, "at").select("id", "patent_id", "relation")


@query("adjacent_nodes", FACTS + ", c as (select min(a) as id from pairs), n as (select distinct case when a = c.id then b else a end as id from pairs join c on c.id in (a, b)) select id from n order by id limit 12")
def _(spark, d):
    p = network.cooccurrence(T.membership(spark, d)).select(F.col("a").alias("from"), F.col("b").alias("to"))
    nodes = network.concept_frequency(T.membership(spark, d)).select(F.col("concept").alias("id"))
    return subgraph.adjacent(nodes, p, p.agg(F.min("from")).first()[0])


@query("export_counts", PARTS + """, pat as (select o_orderkey as patent_id, o_custkey as applicant from orders where o_orderpriority = '1-URGENT'), mc as (select distinct l_orderkey as patent_id, l_partkey as concept from lineitem join pat on patent_id = l_orderkey),
freq as (select concept, count(*) as f from mc group by 1), pr as (select x.concept as a, y.concept as b from mc x join mc y on x.patent_id = y.patent_id and x.concept < y.concept group by 1, 2 having count(*) >= 2),
ins as (select x.applicant as a, y.applicant as b from held x join held y on x.concept = y.concept and x.applicant < y.applicant group by 1, 2 having count(*) >= 2)
select 'concept' as mode, 'nodes' as part, count(*) as n from freq union all select 'concept', 'edges', count(*) from pr having count(*) > 0 union all select 'context', 'nodes', (select count(distinct applicant) from pat) + (select count(*) from pat) + (select count(*) from freq where f >= 2)
union all select 'context', 'edges', (select count(*) from pat) + (select count(*) from mc join freq using (concept) where f >= 2) union all select 'institution', 'nodes', count(*) from (select a from ins union select b from ins) having count(*) > 0 union all select 'institution', 'edges', count(*) from ins having count(*) > 0""")
def _(spark, d):
    rows = views.export_rows(_part_graph(spark, d), ViewOptions(min_support=2, source_files=("1-URGENT",)))
    return rows.groupBy("mode", "part").agg(F.count(F.lit(1)).alias("n"))


def _catalog(spark, d):
    o = T.read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    analyses = o.select(F.col("o_orderkey").cast("string").alias("analysis_id"), (F.col("o_custkey") * 2).cast("string").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    users = T.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("owner"), F.col("c_name").alias("name"))
    return analyses, users


@query("history_owners", "select cast(o_orderkey as varchar) as analysis_id, c_name as owner_name from (select * from orders order by o_orderdate desc, cast(o_orderkey as varchar) limit 200) left join customer on c_custkey = o_custkey * 2")
def _(spark, d):
    return catalog.history_with_owners(*_catalog(spark, d), most=500).select("analysis_id", "owner_name")


@query("catalog_counters", "select (select count(*) from customer) as users, count(*) as analyses, count(*) filter (o_orderstatus = 'F') as completed, count(*) filter (o_orderstatus = 'P') as failed, count(*) filter (o_orderstatus not in ('F', 'P')) as running from orders")
def _(spark, d):
    return catalog.counters(*_catalog(spark, d))


@query("linked_uploads", "with u as (select cast(l_orderkey as varchar) as analysis_id, cast(l_partkey as varchar) as upload_id, 'file ' || cast(l_linenumber as varchar) as name from lineitem) select analysis_id, upload_id, min(name) as original_name from u where cast(upload_id as bigint) in (select p_partkey from part where p_size % 2 = 0) group by 1, 2")
def _(spark, d):
    w = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("analysis_id")).agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("u"), F.concat(F.lit("file "), F.col("l_linenumber").cast("string")).alias("n"))).alias("x"))
    wanted = w.select("analysis_id", F.col("x.u").alias("upload_ids"), F.col("x.n").alias("names"))
    return catalog.linked_uploads(wanted, T.read(spark, d, "part").filter(F.col("p_size") % 2 == 0).select(F.col("p_partkey").cast("string").alias("upload_id"))).select("analysis_id", "upload_id", "original_name")
