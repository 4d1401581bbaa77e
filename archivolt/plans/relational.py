"""List queries, joins, aggregates and windows on the test tables.

Roles: part is a place, lineitem its pages (l_orderkey the document, l_linenumber the
page), orders the documents, supplier an entity, customer and nation the folder levels.
Status P of an order stands for null, F for removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import windows as W
from ..sources.tables import table
from .registry import query

ACTIVE = "nullif(o_orderstatus, 'P') is distinct from 'F'"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(P.active(F.col("status"), "F"))


@query(f"""
with x as (
  select p_partkey, p_name, l_orderkey, l_linenumber, l_quantity, strftime(l_shipdate, '%Y-%m-%d') d
  from part join lineitem on l_partkey = p_partkey join orders on o_orderkey = l_orderkey
  where {ACTIVE} and list_contains(string_split(p_name, ' '), 'small') and l_shipdate >= date '1996-01-01' and l_shipdate < date '2000-01-01')
select p_partkey, p_name, count(distinct l_orderkey)::bigint doc_count, count(*)::bigint page_count, min(d) first_date, max(d) last_date,
  (array_agg(l_orderkey order by l_quantity desc, l_orderkey, l_linenumber))[1] rep_doc,
  (array_agg(l_linenumber order by l_quantity desc, l_orderkey, l_linenumber))[1] rep_page
from x group by all order by page_count desc, p_partkey limit 500""")
def buildings_by_substance(spark: SparkSession, d: str) -> DataFrame:
    """Q1: active documents, array filter, half-open dates, representative page, most pages first, 500 at most."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    lines = table(spark, d, "lineitem").where("l_shipdate >= date '1996-01-01' and l_shipdate < date '2000-01-01'")
    parts = table(spark, d, "part").where(F.array_contains(F.split("p_name", " "), "small")).select("p_partkey", "p_name")
    x = lines.join(parts, lines.l_partkey == parts.p_partkey).join(_live(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
    rep = A.best(F.struct("l_orderkey", "l_linenumber"), A.descending(F.col("l_quantity")), F.col("l_orderkey"), F.col("l_linenumber"))
    g = x.groupBy("p_partkey", "p_name").agg(F.countDistinct("l_orderkey").alias("doc_count"), F.count("*").alias("page_count"), day(F.min("l_shipdate")).alias("first_date"), day(F.max("l_shipdate")).alias("last_date"), rep.alias("rep"))
    return W.page(g.select("p_partkey", "p_name", "doc_count", "page_count", "first_date", "last_date", F.col("rep.l_orderkey").alias("rep_doc"), F.col("rep.l_linenumber").alias("rep_page")), [F.desc("page_count"), F.asc("p_partkey")], 500)


@query("""
with t as (select l_orderkey, l_linenumber, unnest(string_split(p_name, ' ')) v from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#2')
select v as value, count(distinct (l_orderkey, l_linenumber))::bigint pages, count(distinct l_orderkey)::bigint docs from t group by v""")
def values_by_building(spark: SparkSession, d: str) -> DataFrame:
    """Values of an array column, pages as tuples."""
    parts = table(spark, d, "part").where("p_brand = 'Brand#2'").select("p_partkey", F.explode(F.split("p_name", " ")).alias("value"))
    x = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("value").agg(F.countDistinct(F.struct("l_orderkey", "l_linenumber")).alias("pages"), F.countDistinct("l_orderkey").alias("docs"))


@query("""
select s_suppkey, s_name, count(distinct l_orderkey)::bigint docs from lineitem join supplier on s_suppkey = l_suppkey
where l_partkey in (select p_partkey from part where p_type = 'ECONOMY' and p_size <= 5) group by all""")
def labs_by_substance(spark: SparkSession, d: str) -> DataFrame:
    """Q3: entities on pages of chosen places."""
    parts = table(spark, d, "part").where("p_type = 'ECONOMY' and p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    x = table(spark, d, "lineitem").join(parts, "l_partkey", "left_semi").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return x.groupBy("s_suppkey", "s_name").agg(F.countDistinct("l_orderkey").alias("docs"))


@query("""
select l_suppkey, count(*)::bigint pages, count(distinct l_orderkey)::bigint docs from lineitem l
where exists (select 1 from lineitem k join part on p_partkey = k.l_partkey where k.l_orderkey = l.l_orderkey and k.l_linenumber = l.l_linenumber and p_size = 7)
group by all""")
def entities_by_place_semi(spark: SparkSession, d: str) -> DataFrame:
    """Entities on pages that a place set touches."""
    lines = table(spark, d, "lineitem")
    parts = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    pages = lines.join(parts, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")
    return lines.join(pages, ["l_orderkey", "l_linenumber"], "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("pages"), F.countDistinct("l_orderkey").alias("docs"))


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, (select min(l_linenumber) from lineitem where l_orderkey = o_orderkey) as first_page
from orders where o_orderpriority = '1-URGENT' and o_orderdate >= date '1998-01-01' and o_orderdate < date '1998-04-01'
 and (o_totalprice > 200000 or exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'))
order by day, o_orderkey limit 500""")
def documents_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Q5: type and half-open dates, a correlated minimum, a condition or an existing child; one pre-aggregate serves both."""
    kids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("first_page"), F.bool_or(F.col("l_returnflag") == "R").alias("has"))
    x = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= date '1998-01-01' and o_orderdate < date '1998-04-01'").join(kids, "o_orderkey", "left")
    kept = x.where((F.col("o_totalprice") > 200000) | F.coalesce("has", F.lit(False)))
    return W.page(kept.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "first_page"), [F.asc("day"), F.asc("o_orderkey")], 500)


@query("select s_nationkey, s_name, count(*)::bigint n from supplier where s_name ilike '%#00000000%' group by all")
def officials_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Q6, F9."""
    return table(spark, d, "supplier").where(P.contains(F.col("s_name"), "#00000000")).groupBy("s_nationkey", "s_name").agg(F.count("*").alias("n"))


@query("select o_orderkey, nullif(o_orderstatus, 'P') as status from orders where nullif(o_orderstatus, 'P') is distinct from 'F'")
def active_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2."""
    return _live(spark, d).select("o_orderkey", "status")


@query("""
select r_name, n_name, nullif(c_mktsegment, 'BUILDING') as segment, count(*)::bigint n, round(sum(c_acctbal), 2) as total
from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
where r_name = 'ASIA' and nullif(c_mktsegment, 'BUILDING') is null group by all order by r_name, n_name, segment nulls last""")
def hierarchy_browse(spark: SparkSession, d: str) -> DataFrame:
    """Levels of a tree; one level asks for null."""
    x = table(spark, d, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    x = x.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    out = x.where(P.path({"r_name": "ASIA", "segment": None})).groupBy("r_name", "n_name", "segment")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).orderBy("r_name", "n_name", F.asc_nulls_last("segment"))


@query("""
select l_partkey from lineitem group by l_partkey
having bool_or(l_shipdate >= date '1996-02-01' and l_shipdate < date '1996-03-01') and bool_or(strftime(l_shipdate, '%Y') = '1999')""")
def array_any_range(spark: SparkSession, d: str) -> DataFrame:
    """any element of a date array in a range."""
    x = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("dates"))
    return x.where(P.any_date_in(F.col("dates"), "1996-02-01", "1996-03-01") & P.in_year(F.col("dates"), 1999)).select("l_partkey")


@query("""
with f as (select s_suppkey as bbl, s_nationkey + 1000 as bin, s_name as address from supplier),
p as (select c_custkey, case when c_custkey % 2 = 0 then 'bbl' else 'bin' end kind, case when c_custkey % 2 = 0 then c_custkey else c_nationkey + 1000 end::varchar as key from customer)
select c_custkey, kind, key, min(address) as address from p left join f on (kind = 'bbl' and bbl::varchar = key) or (kind = 'bin' and bin::varchar = key) group by all""")
def theta_join_as_union(spark: SparkSession, d: str) -> DataFrame:
    """An either-key join as one equi-join, one row a left row."""
    facts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bbl"), (F.col("s_nationkey") + 1000).alias("bin"), F.col("s_name").alias("address"))
    even = F.col("c_custkey") % 2 == 0
    places = table(spark, d, "customer").select("c_custkey", F.when(even, "bbl").otherwise("bin").alias("kind"), F.when(even, F.col("c_custkey")).otherwise(F.col("c_nationkey") + 1000).cast("string").alias("key"))
    return J.either_key(places, facts, "kind", "key", {"bbl": "bbl", "bin": "bin"}, ["address"])


_LATEST = """
select c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from customer {how} join lateral
 (select o_orderkey, o_orderdate from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 1) o on true"""


def _latest(spark: SparkSession, d: str, childless: bool) -> DataFrame:
    kids = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    out = J.with_first(table(spark, d, "customer").select("c_custkey"), kids, "c_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], keep_childless=childless)
    return out.select("c_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(_LATEST.format(how="inner"))
def lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    return _latest(spark, d, False)


@query(_LATEST.format(how="left"))
def lateral_top1_left(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    return _latest(spark, d, True)


@query("""
select b.l_partkey, count(distinct (b.l_orderkey, b.l_linenumber))::bigint n_pages, count(distinct b.l_orderkey)::bigint n_docs
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.l_suppkey = 7 and b.l_suppkey <> 7 group by all""".replace("b.l_partkey", "b.l_suppkey"))
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """J13, A6."""
    return J.cooccurring(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], 7)


@query("""
select b.l_partkey, count(distinct b.l_orderkey)::bigint n_lists from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
where a.l_partkey = 3 and b.l_partkey <> 3 group by all""")
def cocitation(spark: SparkSession, d: str) -> DataFrame:
    """J14."""
    return J.cocited(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 3)


@query("""
with e as (select event_id, user_id, event_type, epoch_us(ts) t from events),
p as (select p.event_id, v.event_id as other, abs(v.t - p.t) gap, row_number() over (partition by p.event_id order by abs(v.t - p.t), v.t, v.event_id) k
 from e p join e v on p.user_id = v.user_id and v.event_type = 'view' and abs(v.t - p.t) <= 3600000000 where p.event_type = 'purchase')
select event_id, other, gap from p where k = 1""")
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's nearest view within an hour; views meet purchases in hour cells, not all of a user's."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = 3_600_000_000
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("at"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("t") / hour) + i)).alias("cell"))
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("other"), "t", F.floor(F.col("t") / hour).alias("cell"))
    pairs = bought.join(views, ["user_id", "cell"]).withColumn("gap", F.abs(F.col("t") - F.col("at"))).where(F.col("gap") <= hour)
    best = pairs.groupBy("event_id").agg(F.min(F.struct("gap", "t", "other")).alias("x"))
    return best.select("event_id", F.col("x.other").alias("other"), F.col("x.gap").alias("gap"))


@query("""
with g as (select l_orderkey, list(l_linenumber) filter (l_returnflag = 'R') a, list(l_linenumber) filter (l_returnflag = 'A') b from lineitem group by all)
select l_orderkey, coalesce(len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 1)) > 0)) > 0, false) as near from g""")
def proximity_flag(spark: SparkSession, d: str) -> DataFrame:
    """Some two of two kinds are close on one document."""
    of = lambda f: F.collect_list(F.when(F.col("l_returnflag") == f, F.col("l_linenumber")))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(of("R").alias("a"), of("A").alias("b"))
    return x.select("l_orderkey", J.any_close(F.col("a"), F.col("b"), 1).alias("near"))


@query("""
with r as (select p_partkey, p_partkey * 1000 as lo, p_partkey * 1000 + 400 + p_size * 20 as hi from part),
h as (select o_orderkey, p_partkey, row_number() over (partition by o_orderkey order by lo, hi) k from orders join r on o_totalprice::bigint between lo and hi)
select o_orderkey, p_partkey from h where k = 1""".replace("o_totalprice::bigint", "floor(o_totalprice)::bigint"))
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """J17."""
    lo = F.col("p_partkey") * 1000
    ranges = table(spark, d, "part").select("p_partkey", lo.alias("lo"), (lo + 400 + F.col("p_size") * 20).alias("hi"))
    points = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    return J.in_range(points, "v", ranges, "lo", "hi", 1000).select("o_orderkey", "p_partkey")


@query("""
with t as (select s_suppkey as k, 0 tier, s_name v from supplier where s_acctbal > 0 union all select c_custkey, 1, c_name from customer),
m as (select k, min(tier) tier from t group by k) select t.k, t.v, t.tier from t join m on t.k = m.k and t.tier = m.tier""")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first lookup that has the key."""
    a = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return J.first_tier([a, b], ["k"])


@query("""
with p as (select l_orderkey a, l_suppkey b, max(l_quantity) s from lineitem group by all),
u as (select a, b, s from p union all select b, a, s from p) select a, b, max(s) s from u where a <> b group by all""")
def copies_and_versions(spark: SparkSession, d: str) -> DataFrame:
    """J23."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("s"))
    return J.both_ways(p, "a", "b", "s")


@query("""
with x as (select distinct l_orderkey d, l_partkey p, l_suppkey s from lineitem),
a as (select y.d, count(distinct y.s)::bigint n from x join x y on x.s = y.s where x.d = 11 and y.d <> 11 group by all),
b as (select y.d, count(distinct y.p)::bigint n from x join x y on x.p = y.p where x.d = 11 and y.d <> 11 group by all)
select coalesce(a.d, b.d) as doc, coalesce(a.n, 0) as shared_entities, coalesce(b.n, 0) as shared_topics from a full join b on a.d = b.d""")
def related_records(spark: SparkSession, d: str) -> DataFrame:
    """Shared items of two kinds as pre-aggregated semi-joins."""
    x = table(spark, d, "lineitem")
    a = J.shared_counts(x, "l_orderkey", "l_suppkey", 11).withColumnRenamed("n_shared", "shared_entities")
    b = J.shared_counts(x, "l_orderkey", "l_partkey", 11).withColumnRenamed("n_shared", "shared_topics")
    return a.join(b, "l_orderkey", "full").select(F.col("l_orderkey").alias("doc"), F.coalesce("shared_entities", F.lit(0)).alias("shared_entities"), F.coalesce("shared_topics", F.lit(0)).alias("shared_topics"))


@query("""
select coalesce(nullif(o_orderstatus, 'P'), '(null)') as status, count(*)::bigint documents, sum(floor(o_totalprice)::bigint)::bigint bytes from orders group by all""")
def catalog_tally(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return A.tally(_orders(spark, d).withColumn("bytes", F.floor("o_totalprice")), "status", bytes="bytes")


@query("""
select count(*)::bigint documents, count(distinct l_orderkey)::bigint distinct_keys, (count(*) - count(distinct l_orderkey))::bigint duplicates,
 sum(l_linenumber)::bigint pages, max(l_linenumber)::bigint max_pages, count(distinct nullif(l_returnflag, 'N'))::bigint boxes, count(*) filter (l_returnflag = 'N')::bigint blank_boxes from lineitem""")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    box = F.nullif("l_returnflag", F.lit("N"))
    n, k = F.count("*"), F.countDistinct("l_orderkey")
    return table(spark, d, "lineitem").agg(n.alias("documents"), k.alias("distinct_keys"), (n - k).alias("duplicates"), F.sum("l_linenumber").alias("pages"), F.max("l_linenumber").cast("long").alias("max_pages"), F.countDistinct(box).alias("boxes"), F.count_if(box.isNull()).alias("blank_boxes"))


@query("""
with s as (select list(n_chars order by n_chars) x, count(*) n from documents)
select x[1 + floor(0.5 * (n - 1))::bigint] as median, x[1 + floor(0.99 * (n - 1))::bigint] as p99, x[1 + least(n - 1, floor(95 / 100.0 * n)::bigint)] as p95 from s""")
def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4: two index rules."""
    return A.order_statistics(table(spark, d, "documents"), "n_chars", {"median": A.lower_neighbour(0.5), "p99": A.lower_neighbour(0.99), "p95": A.nearest_index(95)})


@query("""
with i as (select o_orderpriority g, o_orderkey a, o_orderkey + (o_custkey % 3) b from orders where o_orderstatus <> 'F'),
s as (select g, a - lag(b) over (partition by g order by a, b) - 1 as step from i)
select g, count(*) filter (step > 0)::bigint gaps, coalesce(sum(step) filter (step > 0), 0)::bigint gap_numbers, count(*) filter (step < 0)::bigint "overlaps" from s where step is not null group by g""")
def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A5, W4."""
    i = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("b"))
    return A.gap_summary(A.interval_steps(i, "a", "b", ["g"]), ["g"])


@query("""
with c as (select l_suppkey, l_returnflag, count(*) n, min(l_shipdate) f from lineitem group by all),
r as (select *, row_number() over (partition by l_suppkey order by n desc, f, l_returnflag) k from c) select l_suppkey, l_returnflag, n::bigint n from r where k = 1""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return A.modal(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_shipdate")


@query("""
with c as (select p_type, p_brand, sum(p_size) n from part group by all), r as (select *, row_number() over (partition by p_type order by n desc, p_brand desc) k from c)
select p_type, p_brand, n::bigint n from r where k = 1""")
def seed_value(spark: SparkSession, d: str) -> DataFrame:
    """Ties to the greatest."""
    return A.greatest_modal(table(spark, d, "part"), ["p_type"], "p_brand", "p_size")


@query("""
with u as (select l_suppkey, l_linestatus, l_returnflag, count(*) n, min(l_orderkey) f from lineitem group by all),
m as (select *, row_number() over (partition by l_suppkey, l_linestatus order by n desc, f, l_returnflag) k from u)
select l.l_suppkey, l.l_linestatus, count(distinct (l_orderkey, l_linenumber))::bigint pages, count(*)::bigint readings, strftime(min(l_shipdate), '%Y-%m-%d') first_day, strftime(max(l_shipdate), '%Y-%m-%d') last_day,
 max(l_quantity) filter (l.l_returnflag = m.l_returnflag) max_value, max(m.l_returnflag) unit, bool_or(l_discount > 0.09) any_above
from lineitem l join m on l.l_suppkey = m.l_suppkey and l.l_linestatus = m.l_linestatus and k = 1 group by all""")
def modal_unit_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest value in the group's most frequent unit."""
    x = table(spark, d, "lineitem").withColumns({"day": F.date_format("l_shipdate", "yyyy-MM-dd"), "above": F.col("l_discount") > 0.09})
    return A.measured_rollup(x, ["l_suppkey", "l_linestatus"], page=F.struct("l_orderkey", "l_linenumber"), value="l_quantity", unit="l_returnflag", day="day", above="above", first="l_orderkey")


@query("""
with c as (select p_type, p_brand, count(*)::bigint n from part group by all), r as (select *, row_number() over (partition by p_type order by n desc, p_brand) as rank from c) select * from r where rank <= 20""")
def top_variants(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return A.top_values(table(spark, d, "part"), ["p_type"], "p_brand", 20).withColumn("rank", F.col("rank").cast("long"))


@query("""
select l_partkey, case min(case l_returnflag when 'R' then 1 when 'A' then 2 when 'N' then 3 end) when 1 then 'R' when 2 then 'A' else 'N' end as method,
 avg((l_linestatus = 'F')::int) >= 0.5 as majority, list_sort(list(distinct l_returnflag))::varchar as flags from lineitem group by all""".replace("::varchar as flags", " as flags").replace("list_sort(list(distinct l_returnflag)) as flags", "array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags"))
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A13, A18, A21."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(A.strongest(F.col("l_returnflag"), ["R", "A", "N"]).alias("method"), A.majority(F.col("l_linestatus") == "F").alias("majority"), F.array_join(A.sorted_set(F.col("l_returnflag")), ",").alias("flags"))


@query("""
with f as (select l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') lo, strftime(max(l_shipdate), '%Y-%m-%d') hi, l_orderkey from lineitem group by l_partkey, l_orderkey)
select l_partkey, count(*)::bigint n_docs, min(lo) first_date, max(hi) last_date from f group by all""")
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """Dates by document first, then by entity."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    docs = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return docs.groupBy("l_partkey").agg(F.count("*").alias("n_docs"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


@query("""
with t as (select l_suppkey, count(*) n_pages, count(distinct l_orderkey) n_docs from lineitem group by all),
r as (select l_suppkey, count(*) n_pages, count(distinct l_orderkey) n_docs from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' group by all)
select t.l_suppkey, greatest(0, t.n_pages - coalesce(r.n_pages, 0))::bigint n_pages, greatest(0, t.n_docs - coalesce(r.n_docs, 0))::bigint n_docs from t left join r on t.l_suppkey = r.l_suppkey""")
def residual_counts(spark: SparkSession, d: str) -> DataFrame:
    """Totals less what removed documents had."""
    x = table(spark, d, "lineitem")
    of = lambda df: df.groupBy("l_suppkey").agg(F.count("*").alias("n_pages"), F.countDistinct("l_orderkey").alias("n_docs"))
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.residual(of(x), of(x.join(gone, "l_orderkey", "left_semi")), "l_suppkey", "n_pages", "n_docs")


@query("""
with f as (select date_trunc('day', min(ts)) p, user_id from events group by user_id), n as (select p, count(*) k from f group by p)
select strftime(p, '%Y-%m-%d') as day, k::bigint n_new, (sum(k) over (order by p))::bigint n_total from n""")
def first_seen_cohort(spark: SparkSession, d: str) -> DataFrame:
    """A24, W5."""
    out = A.first_seen(table(spark, d, "events"), "user_id", "ts", "day")
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("day"), "n_new", "n_total")


@query("""
with y as (select distinct l_orderkey, l_linenumber, l_suppkey, date_trunc('week', l_shipdate) w, case when p_type in ('ECONOMY', 'SMALL') then 'light' else 'other' end f from lineitem join part on p_partkey = l_partkey)
select strftime(w, '%Y-%m-%d') as week, f as family, count(distinct (l_orderkey, l_linenumber))::bigint pages, count(distinct l_suppkey)::bigint buildings from y group by all""")
def timeline_week_family(spark: SparkSession, d: str) -> DataFrame:
    """Week and family."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    family = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "light").otherwise("other")
    return x.groupBy(F.date_format(F.date_trunc("week", "l_shipdate"), "yyyy-MM-dd").alias("week"), family.alias("family")).agg(F.countDistinct(F.struct("l_orderkey", "l_linenumber")).alias("pages"), F.countDistinct("l_suppkey").alias("buildings"))


@query("""
with top as (select l_suppkey from lineitem group by all order by count(*) desc, l_suppkey limit 14)
select strftime(l_shipdate, '%Y-%m') as month, l_suppkey, count(*)::bigint n from lineitem where l_suppkey in (from top) group by all""")
def timeline_month_top(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    return A.top_crosstab(table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), "month", "l_suppkey", 14)


@query("""
with recursive m as (select l_partkey p, date_trunc('month', l_shipdate)::date mo, count(*)::bigint n from lineitem group by all),
g as (select p, mo, n, lag(mo) over (partition by p order by mo) pm from m),
h as (select p, mo, (pm + interval 1 month)::date f, datediff('month', pm, mo) - 1 as e from g where pm is not null)
select p, strftime(mo, '%Y-%m-%d') as month, n, false as is_break from m
union all select p, strftime(unnest(generate_series(f, (mo - interval 1 month)::date, interval 1 month)), '%Y-%m-%d'), 0, false from h where e between 1 and 12
union all select p, strftime(f, '%Y-%m-%d'), null, true from h where e > 12""")
def month_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    return W.month_series(m, ["p"]).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query(f"""
with x as (select o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') pr from orders where {ACTIVE})
select o_orderkey, o_custkey, pr, lead(o_orderkey) over (partition by o_custkey, pr order by o_orderkey) as "next" from x""")
def next_in_folder(spark: SparkSession, d: str) -> DataFrame:
    """Null is a folder like others; removed rows are out before."""
    x = _live(spark, d).select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("pr"))
    return W.next_in_group(x, ["o_custkey", "pr"], "o_orderkey")


@query("select p_partkey, p_name, (select count(*) from part where p_name ilike 's%')::bigint total from part where p_name ilike 's%' order by p_name, p_partkey limit 50 offset 20")
def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    """A page of rows with the number of all."""
    x = table(spark, d, "part").where(P.initial(F.col("p_name"), "S")).select("p_partkey", "p_name")
    return W.page(W.with_total(x), [F.asc("p_name"), F.asc("p_partkey")], 50, 20)


@query("select c_custkey, c_name from customer where c_custkey > 100 order by c_custkey limit 26")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """T2."""
    return W.keyset_page(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 25)


@query("""
with p as (select 'a' as tier, l_partkey as k, min(l_orderkey) as o from lineitem where l_suppkey = 3 group by all union all select 'b', p_partkey, p_size from part where p_brand = 'Brand#1'),
r as (select *, row_number() over (partition by k order by tier, o) n from p)
select k, o, (tier = 'b')::int as arm from r where n = 1 order by arm, o, k limit 100""")
def also_read(spark: SparkSession, d: str) -> DataFrame:
    """A union in which the first arm wins."""
    a = table(spark, d, "lineitem").where("l_suppkey = 3").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("o"))
    b = table(spark, d, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("o"))
    return W.first_wins([a, b], "k", "o", 100)


@query("""
with v as (select event_type, count(*) n from events where ts >= timestamp '2024-01-20' group by all), r as (select event_type, row_number() over (order by event_type) k from (select distinct event_type from events))
select r.event_type, (coalesce(n, 0) + greatest(0, 200 - k))::bigint as score from r left join v on r.event_type = v.event_type""")
def reading_list(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    e = table(spark, d, "events")
    v = e.where("ts >= timestamp_ntz '2024-01-20'").groupBy("event_type").agg(F.count("*").alias("n"))
    r = e.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")))
    return r.join(v, "event_type", "left").select("event_type", W.blended(F.col("n"), F.col("k")).cast("long").alias("score"))


@query("""
with s as (select p_type, p_partkey, p_size, row_number() over (partition by p_type order by p_size, p_partkey) - 1 i, count(*) over (partition by p_type) n from part),
r as (select *, row_number() over (partition by p_type order by abs(i - n // 2), i) k from s) select p_type, p_partkey, p_size from r where k <= 2""")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    """T10."""
    return W.middle_of_strata(table(spark, d, "part").select("p_type", "p_partkey", "p_size"), "p_type", "p_size", "p_partkey", 2)


@query("""
with l as (select l_orderkey, list(l_returnflag) a, list(l_linestatus) b from lineitem group by all)
select l_orderkey, (list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) for x in list_distinct(list_intersect(a, b))]))::int as n from l
where len(list_intersect(a, b)) > 0""".replace("l_linestatus) b", "case l_linestatus when 'F' then 'A' else 'R' end) b"))
def multiset_retention(spark: SparkSession, d: str) -> DataFrame:
    """U4."""
    b = F.when(F.col("l_linestatus") == "F", "A").otherwise("R")
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(b).alias("b"))
    return x.select("l_orderkey", W.multiset_overlap(F.col("a"), F.col("b")).alias("n")).where("n > 0")


@query("""
with listed as (select 'flag' as field, l_returnflag as key, count(*) + max((l_returnflag = 'R')::int) n from lineitem where l_returnflag <> 'N' group by all),
actual as (select 'flag' as field, case when l_returnflag = 'N' then '' else l_returnflag end as key, count(*) n from lineitem group by all),
left_ as (select * from listed union all select 'flag', '', (select count(*) from lineitem) - (select sum(n) from listed))
select coalesce(l.field, a.field) as field, coalesce(l.key, a.key) as key, l.n::bigint listed, a.n::bigint actual, l.n is distinct from a.n as differs from left_ l full join actual a on l.field = a.field and l.key = a.key""")
def reconcile_facets(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    x = table(spark, d, "lineitem")
    n = x.groupBy(F.lit("flag").alias("field"), F.nullif("l_returnflag", F.lit("N")).alias("key")).agg(F.count("*").alias("n"))
    listed = n.where("key is not null").withColumn("n", F.col("n") + (F.col("key") == "R").cast("int"))
    return A.reconciled(listed, n, x.agg(F.count("*").alias("n")).select(F.lit("flag").alias("field"), "n"))
