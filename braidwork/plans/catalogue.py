"""Registered queries of the reference's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audits, graphs, intervals, prefixes, state, tiers
from . import code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _registered(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Microseconds since 1970, whatever the session's time zone; the tables' times have none.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({} as timestamp_ntz))"


@_registered("""
select d.source, count(*) as n_docs, sum(d.n_chars)::bigint as n_chars, count(*) filter (where l.toxic = 1) as n_toxic,
       count(*) filter (where l.quality = 0) as n_low, count(*) filter (where l.doc_id is null) as n_unlabelled
from documents d left join (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by 1) l using (doc_id) group by 1
""")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project summary and severity counts: sums and conditional counts by source."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    return docs.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_chars").alias("n_chars"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
        F.count_if(F.col("quality") == 0).alias("n_low"),
        F.count_if(F.col("labelled").isNull()).alias("n_unlabelled"),
    )


@_registered("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
o as (select doc_id, line_no, strlen(line) as n, sum(strlen(line) + 1) over (partition by doc_id order by line_no) as upto from l)
select doc_id, line_no::bigint as line_no, (upto - n - 1)::bigint as byte_start, (upto - 1)::bigint as byte_end from o
""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their byte ranges: running sums within each document of its lines' sizes, without the texts."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.octet_length(x).cast("long"))
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sizes).alias("k", "n"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), before.alias("byte_start"), (before + F.col("n")).alias("byte_end"))


@_registered("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as n_lines, count(*) filter (where contains(line, '%%%')) as n_percent, count(*) filter (where contains(line, '###')) as n_hash
from l where contains(line, '%%%') or contains(line, '###') group by 1
""")
def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with markers, by document: higher-order filters within the row, no explode."""
    lines = F.split("text", "\n", -1)
    has = lambda mark: lambda x: x.contains(mark)
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("%%%") | F.col("text").contains("###"))
    count = lambda f: F.size(F.filter(lines, f)).cast("long")
    return docs.select("doc_id", count(lambda x: x.contains("%%%") | x.contains("###")).alias("n_lines"), count(has("%%%")).alias("n_percent"), count(has("###")).alias("n_hash"))


_HREF = 'href="([^"]*)"'
_HOST = "^[a-z]+://([^/?#]+)"


@_registered(f"""
with p as (select page_id, regexp_extract(url, '{_HOST}', 1) as host, case when starts_with(url, 'https:') then 'https' when starts_with(url, 'http:') then 'http' else 'other' end as scheme,
  case when contains(url, '?') then 'query' when contains(url, '#') then 'fragment' else 'plain' end as form, list_distinct(regexp_extract_all(html, '{_HREF}', 1)) as hrefs from pages),
known as (select distinct host || '/' || string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+/?', ''), '[?#].*$', ''), '/')[1] as target from p join pages using (page_id)),
e as (select page_id, host, scheme, form, unnest(hrefs) as href from p)
select e.page_id, e.scheme, e.form, e.href, e.host || case when starts_with(href, '/') then href else '/' || href end as target, case when k.target is null then 'missing_target' else 'resolved' end as resolution
from e left join known k on k.target = e.host || case when starts_with(href, '/') then href else '/' || href end
""")
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, with the form of the page's URL, and whether their targets are known: edge extraction and a left join."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", _HOST, 1)
    scheme = F.when(F.col("url").startswith("https:"), "https").when(F.col("url").startswith("http:"), "http").otherwise("other")
    form = F.when(F.col("url").contains("?"), "query").when(F.col("url").contains("#"), "fragment").otherwise("plain")
    edges = pages.select("page_id", host.alias("host"), scheme.alias("scheme"), form.alias("form"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), 1))).alias("href"))
    target = F.concat("host", F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(F.lit("/"), "href")))
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]+/?", ""), "[?#].*$", "")
    known = pages.select(F.concat(host, F.lit("/"), F.split(path, "/")[0]).alias("target")).distinct().withColumn("known", F.lit(True))
    out = edges.withColumn("target", target).join(known, "target", "left")
    return out.select("page_id", "scheme", "form", "href", "target", F.when(F.col("known"), "resolved").otherwise("missing_target").alias("resolution"))


@_registered("""
select sha256(lower(text)) as content, count(*) as n_rows, case when count(*) = 1 then 'unique' when min(text) = max(text) then 'identical' else 'conflicting' end as status,
       case when min(text) = max(text) then min(doc_id) end as kept_id
from documents where text is not null group by lower(text)
""")
def duplicate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of one name (here: the text's digest without case): unique, identical or conflicting. Texts are compared by digests."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.lower("text"), 256).alias("content"), F.sha2("text", 256).alias("own"))
    return audits.resolve_duplicates(docs, ["content"], "own", "doc_id")


@_registered("""
with c as (select c_custkey, c_nationkey, n.n_regionkey from customer join nation n on c_nationkey = n_nationkey),
s as (select s_suppkey, s_nationkey, n.n_regionkey, s_acctbal from supplier join nation n on s_nationkey = n_nationkey where s_acctbal >= 8000),
k as (select c_custkey, 0 as tier, s_suppkey from c join s on c_nationkey = s_nationkey union all select c_custkey, 1, s_suppkey from c join s on c.n_regionkey = s.n_regionkey),
g as (select c_custkey, tier, count(distinct s_suppkey) as n, min(s_suppkey) as s_suppkey from k group by 1, 2),
b as (select *, row_number() over (partition by c_custkey order by tier) as rn from g)
select c.c_custkey, b.tier, coalesce(b.n, 0) as n_candidates, case when b.n = 1 then b.s_suppkey end as s_suppkey, case when b.n is null then 'not_visible' when b.n = 1 then 'resolved' else 'ambiguous' end as status
from customer c left join b on b.c_custkey = c.c_custkey and rn = 1
""")
def tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's well-funded supplier: of the same nation first, else of the same region; no fall-through.

    Candidates meet by nation and by region; they are first counted there, so that the join to customers
    is of one row for each nation, not of each pair.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal >= 8000").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    places = nation.select("n_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("n_nationkey").alias("at")), F.struct(F.lit(1).alias("tier"), F.col("n_regionkey").alias("at")))).alias("p")).select("n_nationkey", "p.*")
    offered = supplier.select("s_suppkey", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("s_nationkey").alias("at")), F.struct(F.lit(1).alias("tier"), F.col("n_regionkey").alias("at")))).alias("p")).select("s_suppkey", "p.*")
    by_nation = tiers.first_tier(nation.select("n_nationkey"), places.join(offered, ["tier", "at"]), ["n_nationkey"], "tier", "s_suppkey", "not_visible")
    out = customer.join(F.broadcast(by_nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # a row for each nation
    return out.select("c_custkey", "tier", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "s_suppkey", F.coalesce("status", F.lit("not_visible")).alias("status"))


_SCOPES = """
e as (select event_id, user_id, event_type, epoch_us(ts) as t from events),
i as (select user_id, event_type as kind, event_id as scope_id, t as lo, lead(t) over (partition by user_id, event_type order by t, event_id) as hi from e where event_type in ('signup', 'error'))
"""


@_registered(f"""
with {_SCOPES},
j as (select p.event_id, i.kind, i.scope_id, i.hi - i.lo as len, row_number() over (partition by p.event_id order by i.hi - i.lo, i.lo desc, i.scope_id) as rn
  from e p join i on p.user_id = i.user_id and p.t >= i.lo and p.t < i.hi where p.event_type = 'purchase')
select p.event_id, j.kind, j.scope_id, j.len as scope_micros, case when j.kind is null then 'missing' else 'resolved' end as status
from e p left join j on p.event_id = j.event_id and rn = 1 where p.event_type = 'purchase'
""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost scope, from one signup or error of a user to the next, around each purchase."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(MICROS.format("ts")).alias("t"))
    w = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    scopes = events.where("event_type in ('signup', 'error')").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("scope_id"), F.col("t").alias("lo"), F.lead("t").over(w).alias("hi"))
    points = events.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    found = intervals.innermost(points, scopes, ["user_id"], ["event_id"], "t", "lo", "hi", ["scope_id"])
    out = points.select("event_id").join(found.select("event_id", "kind", "scope_id", (F.col("hi") - F.col("lo")).alias("scope_micros")), "event_id", "left")
    return out.withColumn("status", F.when(F.col("kind").isNull(), "missing").otherwise("resolved"))


@_registered(f"""
with {_SCOPES}
select i.kind, i.scope_id, count(p.event_id) as n_events, count(distinct p.event_type) as n_types
from i left join e p on p.user_id = i.user_id and p.t >= i.lo and p.t < i.hi group by 1, 2
""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events fall into each scope: an interval join that keeps empty scopes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(MICROS.format("ts")).alias("t"))
    w = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    scopes = events.where("event_type in ('signup', 'error')").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("scope_id"), F.col("t").alias("lo"), F.lead("t").over(w).alias("hi"))
    inside = intervals.containing(events, scopes, ["user_id"], "t", "lo", "hi").groupBy("kind", "scope_id").agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scopes.select("kind", "scope_id").join(inside, ["kind", "scope_id"], "left").select("kind", "scope_id", zero("n_events"), zero("n_types"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@_registered(f"""
with p as (select page_id, {_PATH} as path from pages),
k as (select distinct array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') as root from p where contains(path, '/en/')),
a as (select page_id, unnest(range(1, len(string_split(path, '/')))) as depth, path from p),
j as (select page_id, depth, root from a join k on root = array_to_string(string_split(path, '/')[1:depth], '/')),
b as (select *, row_number() over (partition by page_id order by depth desc) as rn from j)
select p.page_id, p.path, b.root from p left join b on p.page_id = b.page_id and rn = 1
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest known directory above each page; known are the directories of English pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    parts = F.split("path", "/")
    known = pages.where(F.col("path").contains("/en/")).select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("root")).distinct()
    return prefixes.nearest(pages, known, "path", "root")


@_registered("""
with u as (select l_partkey, count(*) as n from lineitem where l_returnflag = 'R' and l_quantity > 45 group by 1)
select 'declared' as side, p_partkey as partkey, coalesce(u.n, 0) as use_count, case when u.n is null then 'declared_but_unused' else 'used' end as status from part left join u on p_partkey = l_partkey
union all select 'used', l_partkey, n, 'used_but_undeclared' from u where l_partkey not in (select p_partkey from part where p_type <> 'ECONOMY')
""")
def declared_vs_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against their large returned items: unused declarations, and uses of what a stricter declaration lacks."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_type")
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("partkey"))
    declared = audits.use_counts(part.select("partkey"), used, ["partkey"])
    strict = part.where("p_type <> 'ECONOMY'").select("partkey")
    missing = audits.undeclared(strict, used, ["partkey"])
    one = declared.select(F.lit("declared").alias("side"), "partkey", "use_count", F.when(F.col("use_count") == 0, "declared_but_unused").otherwise("used").alias("status"))
    return one.union(missing.select(F.lit("used"), "partkey", "use_count", F.lit("used_but_undeclared")))


_EDGES = """
o as (select o_custkey as src, lead(o_custkey) over (partition by date_trunc('month', o_orderdate), o_orderstatus order by o_orderdate, o_orderkey) as dst, o_orderpriority as prio from orders),
edges as (select distinct o.src, o.dst, o.prio from o join customer a on a.c_custkey = o.src join customer b on b.c_custkey = o.dst where a.c_nationkey = b.c_nationkey and o.src <> o.dst),
roots as (select c_custkey as node from (select c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn from customer) where rn <= 3)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation whose orders of one status follow each other within a month, with the first order's priority."""
    w = Window.partitionBy(F.date_trunc("month", "o_orderdate"), "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    follows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(w).alias("dst"), F.col("o_orderpriority").alias("prio"))
    nation = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    a, b = nation.withColumnsRenamed({"c_custkey": "src", "c_nationkey": "na"}), nation.withColumnsRenamed({"c_custkey": "dst", "c_nationkey": "nb"})
    return follows.where("src <> dst").join(a, "src").join(b, "dst").where("na = nb").select("src", "dst", "prio").distinct()


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers of each nation with the highest balances (a top-k report)."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select(F.col("c_custkey").alias("node"))


@_registered(f"""
with recursive {_EDGES},
r(node) as (select node from roots union select e.dst from edges e join r on e.src = r.node)
select c_custkey as node, c_custkey not in (select node from r) as orphan from customer
""")
def reachability_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers no entry point reaches."""
    edges = graphs.written(_edges(spark, sf_dir).select("src", "dst").distinct(), "edges")
    reached = graphs.reachable(edges, _roots(spark, sf_dir)).select("node").withColumn("orphan", F.lit(False))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return nodes.join(reached, "node", "left").select("node", F.coalesce("orphan", F.lit(True)).alias("orphan"))


@_registered(f"""
with recursive {_EDGES},
r(node) as (select node from roots union select e.src from edges e join r on e.dst = r.node)
select node from r
""")
def reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends, over any number of steps, on a changed node: invalidation."""
    edges = graphs.written(_edges(spark, sf_dir).select("src", "dst").distinct(), "edges")
    return graphs.affected(edges, edges.limit(0), _roots(spark, sf_dir)).select("node")


@_registered(f"""
with recursive {_EDGES},
r(prio, node) as (select p.prio, node from roots, (select distinct prio from edges) p union select r.prio, e.dst from edges e join r on e.src = r.node and e.prio = r.prio)
select prio, node from r
""")
def export_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability for each name along the edges that let the name through."""
    edges = graphs.written(_edges(spark, sf_dir), "edges")
    names = edges.select("prio").distinct()
    roots = _roots(spark, sf_dir).join(F.broadcast(names))  # a few entry points for each of five priorities
    return graphs.reachable(edges, roots, ["prio"]).select("prio", "node")


@_registered("""
with c as (select o_custkey, list(o_orderpriority order by o_orderkey) filter (where o_orderstatus = 'F') as f, list(o_orderpriority order by o_orderkey) filter (where o_orderstatus = 'O') as o from orders group by 1)
select o_custkey, coalesce(array_to_string(list_filter(coalesce(f, []), lambda x: not list_contains(coalesce(o, []), x)), ','), '') as missing,
       coalesce(array_to_string(list_filter(coalesce(o, []), lambda x: not list_contains(coalesce(f, []), x)), ','), '') as unexpected from c
""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of a customer's finished orders that open ones lack, and the reverse, in order and with repeats."""
    orders = table(spark, sf_dir, "orders")
    of = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == s, F.struct("o_orderkey", "o_orderpriority")))), lambda x: x["o_orderpriority"])
    c = orders.groupBy("o_custkey").agg(of("F").alias("f"), of("O").alias("o"))  # one customer's orders
    return c.select("o_custkey", F.array_join(audits.ordered_difference("f", "o"), ",").alias("missing"), F.array_join(audits.ordered_difference("o", "f"), ",").alias("unexpected"))


_PATTERNS = [("http://", "prefix", "error"), ("https://blog.", "prefix", "warning"), ("https://spam-farm.", "prefix", "error"), ("https://m.", "prefix", "info")]
_PATTERN_ROWS = ", ".join(f"('{p}', '{k}', '{s}')" for p, k, s in _PATTERNS)


@_registered(f"""
with f(pattern, kind, severity) as (values {_PATTERN_ROWS})
select 'forbidden_import' as rule_id, severity, page_id, pattern from pages join f on (kind = 'prefix' and starts_with(url, pattern)) or (kind = 'exact' and url = pattern)
""")
def forbidden_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL a forbidden pattern matches: the patterns are a configuration, so they become one expression, not a join."""
    url = F.col("url")
    found = [F.when(url.startswith(p) if k == "prefix" else url == p, F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"))) for p, k, s in _PATTERNS]
    hits = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_compact(F.array(*found))).alias("h"))
    return hits.select(F.lit("forbidden_import").alias("rule_id"), "h.severity", "page_id", "h.pattern")


@_registered("""
with e as (select distinct n1.n_regionkey as src, n2.n_regionkey as dst, l_orderkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey join nation n1 on c_nationkey = n1.n_nationkey join nation n2 on s_nationkey = n2.n_nationkey)
select src, dst, count(*) as n_orders, min(l_orderkey) as first_order from e where dst > src group by 1, 2
""")
def layer_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cross a boundary between layers (regions) in the denied direction, and the first of each."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = lines.select("l_orderkey", "dst").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("dst > src")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order"))


@_registered("""
select 'part' as kind, p_partkey as id, p_name as name from part where not regexp_matches(p_name, '^[a-z][a-z0-9]*( [a-z]{4,5})*$')
union all select 'nation', n_nationkey, n_name from nation where not regexp_matches(n_name, '^[A-Z][A-Z_]*$')
""")
def naming_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that break their kind's convention."""
    part = table(spark, sf_dir, "part").where(~F.col("p_name").rlike("^[a-z][a-z0-9]*( [a-z]{4,5})*$")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    nation = table(spark, sf_dir, "nation").where(~F.col("n_name").rlike("^[A-Z][A-Z_]*$")).select(F.lit("nation"), F.col("n_nationkey").cast("long"), "n_name")
    return part.union(nation)


@_registered(f"""
with f(pattern, kind, severity) as (values {_PATTERN_ROWS}),
d as (select 'forbidden_import' as rule_id, severity, page_id as id from pages join f on starts_with(url, pattern)
union select 'naming_convention', 'warning', p_partkey from part where not regexp_matches(p_name, '^[a-z][a-z0-9]*( [a-z]{{4,5}})*$')
union select 'naming_convention', 'warning', n_nationkey from nation where not regexp_matches(n_name, '^[A-Z][A-Z_]*$'))
select rule_id, count(*) as n, count(*) filter (where severity = 'error') as n_error, count(*) filter (where severity = 'warning') as n_warning, count(*) filter (where severity = 'info') as n_info from d group by 1
""")
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules' findings, each once, counted by severity."""
    one = forbidden_patterns(spark, sf_dir).select("rule_id", "severity", F.col("page_id").alias("id"))
    two = naming_rule(spark, sf_dir).select(F.lit("naming_convention"), F.lit("warning"), "id")
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return one.union(two).distinct().groupBy("rule_id").agg(F.count("*").alias("n"), n("error"), n("warning"), n("info"))


@_registered("""
select l_orderkey, count(*) as n_lines, string_agg(l_partkey::varchar || ':' || l_suppkey::varchar, ',' order by l_linenumber, l_partkey, l_suppkey) as lines from lineitem group by 1
""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's ordered lines as one string: a group's dependency fingerprint. An order has few lines."""
    part = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    text = F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), text.alias("lines"))


@_registered("""
with e as (select *, lag(event_type) over w as p, row_number() over (partition by user_id order by event_id desc) as rn, row_number() over w as k from events window w as (partition by user_id order by event_id)),
n as (select user_id, count(*) filter (where k > 1 and event_type is not distinct from p) as n_noop, count(*) as n_updates from e group by 1)
select e.user_id, e.event_id as generation, e.event_type as state, n.n_updates, n.n_noop from e join n using (user_id) where rn = 1
""")
def incremental_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's state after all upserts, and how many of those changed nothing."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = state.latest(events, ["user_id"], "event_id")
    noop = state.changes(events, ["user_id"], "event_id", ["event_type"]).groupBy("user_id").agg(F.count("*").alias("n_updates"), F.count_if("is_noop").alias("n_noop"))
    return last.join(noop, "user_id").select("user_id", F.col("event_id").alias("generation"), F.col("event_type").alias("state"), "n_updates", "n_noop")


@_registered("""
select user_id, count(*) as n, count(*) filter (where event_type = 'error') as n_error, max(event_id) as last_id from events group by 1
""")
def incremental_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates kept from before a cut, refreshed for the users that changed after it: equal to a full rebuild."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    built = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.max("event_id").alias("last_id"))
    cut = F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))
    kept, affected = built(events.where(F.col("ts") < cut)), events.where(F.col("ts") >= cut).select("user_id").distinct()
    return state.refreshed(kept, built(events.join(affected, "user_id", "left_semi")), affected, ["user_id"])


@_registered("""
select event_id, '{"schema":"event","version":1,"data":{"user_id":' || user_id || ',"event_type":"' || event_type || '","k":' || coalesce(json_extract_string(props, '$.k'), 'null') || '}}' as doc from events
""")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned envelopes, with nulls kept."""
    props = F.from_json("props", "k long")
    data = F.struct("user_id", "event_type", props["k"].alias("k"))
    doc = F.to_json(F.struct(F.lit("event").alias("schema"), F.lit(1).alias("version"), data.alias("data")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


@_registered("""
with v as (select p_partkey, p_size // 10 as major, p_size % 10 as minor from part)
select p_partkey, major::bigint as major, minor::bigint as minor, case when major = 0 then '0.' || (minor + 1) else (major + 1) || '.0' end as upper,
       (major = 1 and minor >= 2) or (major = 2) as supported, major = 0 as unstable from v
""")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caret ranges of versions made of sizes, and whether they meet the supported range >=1.2 <3.0."""
    major, minor = F.expr("p_size div 10"), F.col("p_size").cast("long") % 10
    upper = F.when(major == 0, F.concat(F.lit("0."), (minor + 1).cast("string"))).otherwise(F.concat((major + 1).cast("string"), F.lit(".0")))
    return table(spark, sf_dir, "part").select("p_partkey", major.alias("major"), minor.alias("minor"), upper.alias("upper"), (((major == 1) & (minor >= 2)) | (major == 2)).alias("supported"), (major == 0).alias("unstable"))


@_registered("""
select o_custkey, o_orderpriority from orders where o_orderstatus = 'F' except all select o_custkey, o_orderpriority from orders where o_orderstatus = 'O'
""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished minus open orders by customer and priority, as multisets."""
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority")
    return of("F").exceptAll(of("O"))


_CODE_EDGES = _EDGES + """,
d as (select distinct src, dst from edges),
i as (select src, dst, 'c' || dst || '.dart' as uri, sum(strlen('import ''c' || dst || '.dart'';') + 1) over (partition by src order by dst) - strlen('import ''c' || dst || '.dart'';') - 1 as byte_start from d)
"""


def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer graph as a source tree: a file for each customer, with an import for each edge and a class."""
    edges = _edges(spark, sf_dir).select("src", "dst").distinct()
    lines = F.transform(F.sort_array(F.collect_list("dst")), lambda x: F.concat(F.lit("import 'c"), x.cast("string"), F.lit(".dart';\n")))
    imports = edges.groupBy("src").agg(F.array_join(lines, "").alias("imports"))  # one file's own
    files = table(spark, sf_dir, "customer").select("c_custkey").join(imports, F.col("c_custkey") == F.col("src"), "left")
    source = F.concat(F.coalesce("imports", F.lit("")), F.lit("class C"), F.col("c_custkey").cast("string"), F.lit(" {}\n"))
    return files.select(F.lit("customers").alias("project_id"), F.lit("dart").alias("kind"), F.concat(F.lit("lib/c"), "c_custkey", F.lit(".dart")).alias("path"), source.alias("source"))


@_registered(f"""
with {_CODE_EDGES}
select 'lib/c' || src || '.dart' as source_path, uri, 'import' as kind, byte_start::bigint as byte_start, 'resolved' as resolution, 'lib/' || uri as target_path from i
""")
def code_uri_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text to resolved import edges: masking, directives, relative URIs, spans."""
    inputs = _project(spark, sf_dir)
    facts = code.written(code.extracted(inputs), "facts")
    return code.uri_edges(facts, inputs).select("source_path", "uri", "kind", F.col("span.byte_start").alias("byte_start"), "resolution", "target_path")


@_registered(f"""
with {_CODE_EDGES}
select 'lib/c' || c_custkey || '.dart' as source_path, 'C' || name as name, case when c_custkey = name then 'resolved' when d.src is not null then 'resolved' else 'not_visible' end as status,
       case when c_custkey = name then 'same_file' when d.src is not null then 'direct_import' end as basis
from (select c_custkey, c_custkey as name from customer union select src, dst from d union select dst, src from d) q left join d on d.src = q.c_custkey and d.dst = q.name
""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved through files, libraries and imports: own classes, imported ones, and those of importers."""
    inputs = _project(spark, sf_dir)
    facts = code.written(code.extracted(inputs), "facts")
    edges = code.written(code.uri_edges(facts, inputs), "uri-edges")
    key = lambda c: F.regexp_extract(c, r"c(\d+)\.dart$", 1)
    pairs = edges.select(F.col("source_path").alias("a"), F.col("target_path").alias("b"))
    own = facts.select(F.col("path").alias("a"), F.col("path").alias("b"))
    asked = own.union(pairs).union(pairs.select("b", "a")).distinct()
    queries = asked.select(F.lit("customers").alias("project_id"), F.col("a").alias("source_path"), F.concat(F.lit("C"), key("b")).alias("name"), F.lit(None).cast("string").alias("prefix"))
    return code.resolve(facts, edges, queries).select("source_path", "name", "status", "basis")


@_registered(f"""
with recursive {_CODE_EDGES},
r(node) as (select node from roots union select d.dst from d join r on d.src = r.node)
select 'orphan_file' as rule_id, 'error' as severity, 'lib/c' || c_custkey || '.dart' as path from customer where c_custkey not in (select node from r)
""")
def code_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lint rules over the same tree; only files that no entry point reaches are to be found."""
    inputs = _project(spark, sf_dir)
    facts = code.written(code.extracted(inputs), "facts")
    edges = code.written(code.uri_edges(facts, inputs), "uri-edges")
    entry = [f"lib/c{r['node']}.dart" for r in _roots(spark, sf_dir).collect()]  # three for each nation
    config = {"enabled_rules": ["naming_convention", "unresolved_part", "orphan_file", "forbidden_import"], "severity_overrides": {"orphan_file": "error"}, "forbidden_imports": [{"pattern": "dart:", "kind": "prefix"}], "orphan_files": {"entry_points": entry}}
    return code.lint(facts, edges, config).select("rule_id", "severity", "path")
