"""Composite queries: panels, summaries, maps, trees and pivots (§2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import resolve as R
from ..operators import windows as W
from ..sources.tables import table
from .registry import query


@query("""
with x as (select l_suppkey s, l_partkey p, l_orderkey o, l_linenumber n, l_quantity q, l_returnflag = 'R' t, strftime(l_shipdate, '%Y-%m-%d') d from lineitem join orders on o_orderkey = l_orderkey where nullif(o_orderstatus, 'P') is distinct from 'F')
select s as place, s_name as label, count(distinct o)::bigint docs, count(*)::bigint pages, count(distinct (o, n)) filter (t)::bigint tests, count(distinct p)::bigint substances, min(d) first_date, max(d) last_date, (array_agg(o order by q desc, o, n))[1] rep_doc
from x join supplier on s_suppkey = s group by all""")
def map_places(spark: SparkSession, d: str) -> DataFrame:
    """Map: documents are folded first, so that no distinct count multiplies the rows; substances are counted beside."""
    o = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P"))).where(P.active(F.col("status"), "F")).select("o_orderkey")
    x = table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    rep = F.struct((-F.col("l_quantity")).alias("q"), "l_orderkey", "l_linenumber")
    docs = x.groupBy("l_suppkey", "l_orderkey").agg(
        F.count("*").alias("n"), F.size(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("tests"),
        F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"), F.min(rep).alias("rep"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    places = docs.groupBy("l_suppkey").agg(
        F.count("*").alias("docs"), F.sum("n").alias("pages"), F.sum("tests").alias("tests"), day(F.min("lo")).alias("first_date"), day(F.max("hi")).alias("last_date"), F.min("rep")["l_orderkey"].alias("rep_doc")
    )
    substances = x.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("substances"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("label"))
    return places.join(substances, "l_suppkey").join(names, "l_suppkey").withColumnRenamed("l_suppkey", "place")


@query("""
with t as (select l_suppkey s, count(*) filter (l_returnflag = 'R') n from lineitem group by all), b as (select s from t order by n desc, s limit 1),
c as (select l_partkey p, count(*) n from lineitem where l_suppkey = (from b) group by all)
select (from b) as place, p as substance, n::bigint n from c order by n desc, p limit 1""")
def most_tested(spark: SparkSession, d: str) -> DataFrame:
    """The place of most tests, and its most frequent substance."""
    x = table(spark, d, "lineitem")
    place = x.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(1).select(F.col("l_suppkey").alias("place"))
    own = x.join(F.broadcast(place), F.col("l_suppkey") == F.col("place"))
    return own.groupBy("place", F.col("l_partkey").alias("substance")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "substance").limit(1)


@query("select distinct unnest(string_split(p_name, ' ')) as substance from part")
def distinct_substances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("substance")).distinct()


@query("""
with x as (select l_orderkey o, l_linenumber n, l_partkey p, strftime(l_shipdate, '%Y-%m') m from lineitem where l_suppkey = 12), pages as (select distinct o, n from x)
select (select count(*) from pages)::bigint pages, (select count(distinct o) from pages)::bigint docs, (select count(distinct p) from x)::bigint places,
 (select max(c) from (select count(*) c from (select distinct o, n, m from x) group by m))::bigint busiest, (select count(distinct m) from x)::bigint "months", (select min(m) from x) first_month""")
def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Six aggregates of one entity: what is read twice is small and joined by a broadcast of one row."""
    x = table(spark, d, "lineitem").where("l_suppkey = 12").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("m"))
    a = x.agg(F.countDistinct(F.struct("l_orderkey", "l_linenumber")).alias("pages"), F.countDistinct("l_orderkey").alias("docs"), F.countDistinct("l_partkey").alias("places"), F.countDistinct("m").alias("months"), F.min("m").alias("first_month"))
    b = x.groupBy("m").agg(F.countDistinct(F.struct("l_orderkey", "l_linenumber")).alias("c")).agg(F.max("c").alias("busiest"))
    return a.crossJoin(F.broadcast(b))


@query("""
select l_returnflag, l_linestatus, strftime(l_shipdate, '%Y') as "year", count(*)::bigint n, count(distinct l_orderkey)::bigint docs from lineitem where l_suppkey = 12 group by all""")
def entity_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings of an entity by several columns."""
    x = table(spark, d, "lineitem").where("l_suppkey = 12")
    return x.groupBy("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("docs"))


@query("""
with k as (select o_custkey, nullif(o_orderpriority, '5-LOW') p from orders where o_orderkey = 0),
s as (select o_orderkey, o_orderdate from orders o, k where o.o_custkey = k.o_custkey and nullif(o.o_orderpriority, '5-LOW') is not distinct from k.p)
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(min(l_shipdate), '%Y-%m-%d') lo, strftime(max(l_shipdate), '%Y-%m-%d') hi from s left join lineitem on l_orderkey = o_orderkey group by all order by o_orderkey limit 500""")
def folder_records(spark: SparkSession, d: str) -> DataFrame:
    """Siblings by a null-safe key, with the span of their children's dates."""
    o = table(spark, d, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    k = o.where("o_orderkey = 0").select(F.col("o_custkey").alias("kc"), F.col("p").alias("kp"))
    s = o.join(F.broadcast(k.limit(1)), F.col("o_custkey").eqNullSafe(F.col("kc")) & F.col("p").eqNullSafe(F.col("kp")))
    x = s.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return W.page(x.groupBy("o_orderkey", day("o_orderdate").alias("day")).agg(day(F.min("l_shipdate")).alias("lo"), day(F.max("l_shipdate")).alias("hi")), [F.asc("o_orderkey")], 500)


_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query("""
with x as (select l_orderkey, count(*) pages, min(l_linenumber) first_page, bool_or(l_returnflag = 'R') tested, min(l_shipdate) d from lineitem group by all)
select o_orderkey, coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], o_orderpriority), 5)::int as kind, pages::bigint pages, first_page, tested, strftime(d, '%Y-%m-%d') as day from x join orders on o_orderkey = l_orderkey""")
def building_documents(spark: SparkSession, d: str) -> DataFrame:
    """Places' documents: a fold of its pages, and the type's place in a fixed order, unknown ones last."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.min("l_linenumber").alias("first_page"), F.bool_or(F.col("l_returnflag") == "R").alias("tested"), F.min("l_shipdate").alias("d"))
    at = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("o_orderpriority")).cast("int")
    out = x.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return out.select("o_orderkey", F.when(at > 0, at).otherwise(5).alias("kind"), "pages", "first_page", "tested", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("""
select strftime(l_shipdate, '%Y') as "year", count(distinct (l_orderkey, l_linenumber)) filter (l_returnflag = 'A')::bigint "A", count(distinct (l_orderkey, l_linenumber)) filter (l_returnflag = 'N')::bigint "N", count(distinct (l_orderkey, l_linenumber)) filter (l_returnflag = 'R')::bigint "R"
from lineitem group by all""")
def tests_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Dates by substances, distinct pages."""
    x = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("year"), "l_returnflag", F.struct("l_orderkey", "l_linenumber").alias("page"))
    return x.groupBy("year").agg(*(F.countDistinct(F.when(F.col("l_returnflag") == f, F.col("page"))).alias(f) for f in "ANR"))


@query("""
with d as (select r_name, n_name, c_mktsegment, count(*) n, count(distinct o_custkey) k from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey left join orders on o_custkey = c_custkey group by all)
select r_name, n_name, c_mktsegment, n::bigint n, k::bigint k, sum(n) over (partition by r_name)::bigint region_n from d""")
def browse_tree(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a level, with those of the level above."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    x = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("k"))
    return x.join(x.groupBy("r_name").agg(F.sum("n").alias("region_n")), "r_name")


@query("""
with s as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') base from part)
select p_partkey, case when k = 1 then base else base || '-' || k end as slug from (select *, row_number() over (partition by base order by p_partkey) k from s) t""")
def entity_slugs(spark: SparkSession, d: str) -> DataFrame:
    """No natural slug of these names ends in a number."""
    return W.slugs(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("""
select p_partkey, trim(substr(md5(p_name), 1, 12)) as code, '1' || lpad((p_partkey % 700)::varchar, 5, '0') || lpad(p_size::varchar, 4, '0') as lot, (p_partkey % 700)::int as block from part""")
def key_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """§1.5: lot keys and the block back out of them."""
    lot = R.lot_key(F.col("p_partkey") % 700, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.substring(F.md5("p_name"), 1, 12).alias("code"), lot.alias("lot"), R.block_of(lot).alias("block"))


@query("""
select 'documents' as "table", 'lang' as field, count(lang)::bigint n_known from documents union all select 'orders', 'status', count(nullif(o_orderstatus, 'P'))::bigint from orders""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A29."""
    a = A.coverage(table(spark, d, "documents"), "lang").select(F.lit("documents").alias("table"), "field", "n_known")
    b = A.coverage(table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P"))), "status").select(F.lit("orders").alias("table"), "field", "n_known")
    return a.union(b)


@query("""
with l as (select l_orderkey k, min(l_suppkey) lab from lineitem group by all)
select o_orderkey, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) as name, coalesce(nullif(trim(o_orderpriority), '5-LOW'), 'none') as label, lab from orders join customer on c_custkey = o_custkey left join l on k = o_orderkey""")
def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """E34, §2.8: preferred labels and title case."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("lab"))
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.select("o_orderkey", T.title_case(F.col("c_name")).alias("name"), R.preferred_label(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("label"), "lab")


@query("""select 'part' as kind, count(*)::bigint n from part union all select 'supplier', count(*) from supplier union all select 'topic', count(distinct lang) from documents union all select 'page', 1""")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    """A union of several sources and one row."""
    a = table(spark, d, "part").agg(F.lit("part").alias("kind"), F.count("*").alias("n"))
    b = table(spark, d, "supplier").agg(F.lit("supplier").alias("kind"), F.count("*").alias("n"))
    c = table(spark, d, "documents").agg(F.lit("topic").alias("kind"), F.countDistinct("lang").alias("n"))
    return a.union(b).union(c).union(spark.range(1).select(F.lit("page").alias("kind"), F.lit(1).cast("long").alias("n")))


@query("""
with e as (select user_id, date_trunc('day', ts) d, props from events), x as (select user_id, d, regexp_extract(props, '"k": ([0-9]+)', 1)::int k from e)
select user_id, strftime(d, '%Y-%m-%d') as day, sum(k)::bigint spent, count(*)::bigint n from x group by all""")
def spend_by_day(spark: SparkSession, d: str) -> DataFrame:
    """A34, §2.8: numbers out of JSON, added up by day."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(k).alias("spent"), F.count("*").alias("n"))


@query("""
with r as (select *, row_number() over (partition by l_suppkey, l_orderkey, l_linenumber order by l_shipdate, l_partkey) k from lineitem) select l_suppkey, l_orderkey, l_linenumber, l_partkey from r where k = 1""")
def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity and page, the first by start."""
    from ..operators.joins import first_by

    x = table(spark, d, "lineitem")
    return first_by(x, ["l_suppkey", "l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_partkey")]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
select l_returnflag as kind, l_suppkey as key, count(distinct l_orderkey)::bigint docs, count(*)::bigint pages, count(*) filter (l_discount > 0.05)::bigint tests, strftime(min(l_shipdate), '%Y-%m-%d') lo, strftime(max(l_shipdate), '%Y-%m-%d') hi, min(l_partkey) as label from lineitem group by all""")
def place_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("key")).agg(F.countDistinct("l_orderkey").alias("docs"), F.count("*").alias("pages"), F.count_if(F.col("l_discount") > 0.05).alias("tests"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.min("l_partkey").alias("label"))


@query("""
select o_orderpriority as folder, count(*)::bigint docs, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as boxes, count(distinct o_custkey)::bigint agencies from orders group by all""")
def folder_tallies(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("folder")).agg(F.count("*").alias("docs"), F.array_join(A.sorted_set(F.col("o_orderstatus")), ",").alias("boxes"), F.countDistinct("o_custkey").alias("agencies"))


@query("""
with f as (select p_partkey, p_name from part where p_size > 49 and p_brand = 'none'), a as (select p_partkey, p_name from part where p_size > 48)
select p_partkey, p_name, false as relaxed from f union all select p_partkey, p_name, true from a where (select count(*) from f) = 0""")
def relaxed_search(spark: SparkSession, d: str) -> DataFrame:
    """Filters that leave nothing are dropped."""
    from ..operators.search import or_unfiltered

    p = table(spark, d, "part")
    every = p.where("p_size > 48").select("p_partkey", "p_name")
    return or_unfiltered(p.where("p_size > 49 and p_brand = 'none'").select("p_partkey", "p_name"), every)


@query("""
with w as (select p_partkey k, unnest(string_split(p_name, ' ')) term, p_size::double weight from part),
u as (select k, term, max(weight) weight from w group by all), o as (select term, weight w from u where k = 5 order by weight desc, term limit 25)
select k, round(sum(weight * w), 9) as score from u join o using (term) where k <> 5 group by k order by score desc, k limit 10""")
def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    """X12, on words weighted by size."""
    from ..operators.search import more_like

    w = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.split("p_name", " ")).alias("term"), F.col("p_size").cast("double").alias("weight"))
    return more_like(w.groupBy("k", "term").agg(F.max("weight").alias("weight")), "k", 5)


@query("""
select o_orderstatus as release, count(*)::bigint n, count(distinct o_orderkey)::bigint keys from orders where o_orderkey in (select l_orderkey from lineitem where l_suppkey = 4) group by all""")
def published_by_release(spark: SparkSession, d: str) -> DataFrame:
    """O30."""
    from ..operators.sequences import by_release

    o = table(spark, d, "orders").withColumn("release", F.col("o_orderstatus"))
    pub = table(spark, d, "lineitem").where("l_suppkey = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return by_release(o, pub, "o_orderkey", "release")
