"""Catalog versions, folds, queues and streams on the test tables.

Snapshots of a catalog are made from orders: A has the older ones, B leaves out those of
status F and has other prices and priorities for some, C is orders as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators import versions as V
from ..sources.shared import Shared
from ..sources.tables import table
from ..streaming import counters
from .registry import query

FIELDS = ["o_custkey", "o_orderpriority", "price"]
_SNAPSHOTS = """
a as (select o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') o_orderpriority, floor(o_totalprice)::bigint price from orders where o_orderdate < date '2000-01-01'),
b as (select o_orderkey, o_custkey, case when o_orderpriority = '2-HIGH' then '1-URGENT' else nullif(o_orderpriority, '5-LOW') end o_orderpriority, (floor(o_totalprice) + case when o_totalprice > 200000 then 1 else 0 end)::bigint price from orders where o_orderstatus <> 'F'),
c as (select o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') o_orderpriority, floor(o_totalprice)::bigint price from orders)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), F.floor("o_totalprice").alias("price"))
    b = o.where("o_orderstatus <> 'F'").withColumns({"o_orderpriority": F.when(F.col("o_orderpriority") == "2-HIGH", "1-URGENT").otherwise(F.col("o_orderpriority")), "price": F.col("price") + (F.col("o_totalprice") > 200000).cast("int")})
    own = ["o_orderkey", *FIELDS]
    return o.where("o_orderdate < date '2000-01-01'").select(own), b.select(own), o.select(own)


@query(f"""
with {_SNAPSHOTS}
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' else 'changed' end as kind,
 case when a.o_orderkey is not null and b.o_orderkey is not null then concat_ws(',', case when a.o_custkey is distinct from b.o_custkey then 'o_custkey' end, case when a.o_orderpriority is distinct from b.o_orderpriority then 'o_orderpriority' end, case when a.price is distinct from b.price then 'price' end) end as fields,
 case when a.price <> b.price then a.price::varchar || '>' || b.price::varchar end as shown
from a full join b on a.o_orderkey = b.o_orderkey
where a.o_orderkey is null or b.o_orderkey is null or a.o_custkey is distinct from b.o_custkey or a.o_orderpriority is distinct from b.o_orderpriority or a.price is distinct from b.price""")
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    """Names of changed fields; values only of printable ones."""
    a, b, _ = _snapshots(spark, d)
    out = V.diff(a, b, "o_orderkey", FIELDS, ["price"])
    price = F.col("values")["price"]
    return out.select("o_orderkey", "kind", F.array_join("fields", ",").alias("fields"), F.concat(price["from"], F.lit(">"), price["to"]).alias("shown"))


@query(f"""
with {_SNAPSHOTS}, x as (select a.o_orderkey ak, b.o_orderkey bk, coalesce(b.price, 0) - coalesce(a.price, 0) dp,
 case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.o_custkey is distinct from b.o_custkey or a.o_orderpriority is distinct from b.o_orderpriority or a.price is distinct from b.price then 'changed' end as kind
 from a full join b on a.o_orderkey = b.o_orderkey)
select kind, count(*)::bigint n, sum(dp)::bigint as price_delta from x where kind is not null group by kind""")
def catalog_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """O1: counts and deltas by kind."""
    a, b, _ = _snapshots(spark, d)
    return V.diff_counts(V.diff(a, b, "o_orderkey", FIELDS), price_delta="price")


def _history(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for snapshot, day in zip(_snapshots(spark, d), ("2024-01-01", "2024-01-02", "2024-01-03"), strict=True):
        out = V.merged_history(out, snapshot, "o_orderkey", FIELDS, day)
    return out


@query(f"""
with {_SNAPSHOTS}, k as (select o_orderkey from orders),
x as (select k.o_orderkey, a.o_orderkey is not null ia, b.o_orderkey is not null ib, a, b, c,
  a.o_orderkey is not null and b.o_orderkey is not null and (a.o_custkey is distinct from b.o_custkey or a.o_orderpriority is distinct from b.o_orderpriority or a.price is distinct from b.price) ab,
  case when b.o_orderkey is not null then b.o_orderpriority else a.o_orderpriority end lp, case when b.o_orderkey is not null then b.price else a.price end lx
 from k left join a on a.o_orderkey = k.o_orderkey left join b on b.o_orderkey = k.o_orderkey left join c on c.o_orderkey = k.o_orderkey),
y as (select *, (ia or ib) and (lp is distinct from c.o_orderpriority or lx is distinct from c.price) bc from x)
select o_orderkey, 'present' as status, case when ia then '2024-01-01' when ib then '2024-01-02' else '2024-01-03' end as first_seen, '2024-01-03' as last_seen,
 case when ia and not ib then '2024-01-03' end as reappeared_at, case when ia and not ib then '2024-01-02' end as previously_removed_at,
 case when bc then '2024-01-03' when ab then '2024-01-02' end as changed_at from y""")
def scd_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots folded; changed_at stays until the next change."""
    return _history(spark, d).select("o_orderkey", "status", "first_seen", "last_seen", "reappeared_at", "previously_removed_at", "changed_at")


@query(f"""
with {_SNAPSHOTS}, x as (select c.o_orderkey, a.o_orderkey is not null ia, case when b.o_orderkey is null then 'added' else 'changed' end as kind from c left join b on b.o_orderkey = c.o_orderkey left join a on a.o_orderkey = c.o_orderkey
 where b.o_orderkey is null or b.o_orderpriority is distinct from c.o_orderpriority or b.price <> c.price)
select o_orderkey, case when kind = 'added' and ia then 'reappeared' else kind end as kind from x""")
def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What came back is not new."""
    _, b, c = _snapshots(spark, d)
    changes = V.diff(b, c, "o_orderkey", FIELDS).select("o_orderkey", "kind")
    return V.change_kinds(changes, _history(spark, d), "o_orderkey", "2024-01-03")


@query("""
with s as (select 's1' as snapshot, count(*) n from orders union all select 's2', count(*) filter (o_orderpriority <> '5-LOW') from orders union all select 's3', count(*) filter (o_totalprice > 5000) from orders),
r as (select snapshot, n::bigint documents, (select n from s where snapshot = 's1') base from s)
select snapshot, documents, case when snapshot <> 's1' and documents < base * 0.95 then 'fell from ' || base || ' to ' || documents else '' end as reasons from r""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """O3: each snapshot against the last accepted one."""
    o = table(spark, d, "orders").agg(F.count("*").alias("s1"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("s2"), F.count_if(F.col("o_totalprice") > 5000).alias("s3"))
    stats = o.select(F.explode(F.array(*(F.struct(F.lit(s).alias("snapshot"), F.col(s).alias("documents"), F.lit(0).cast("long").alias("duplicates")) for s in ("s1", "s2", "s3")))).alias("x")).select("x.*")
    return V.quarantine(stats).select("snapshot", "documents", F.array_join("reasons", "; ").alias("reasons"))


@query("""
with recursive h as (select user_id, epoch_us(ts) t, row_number() over (partition by user_id order by ts) k from events),
r as (select user_id, t, k, t + 3600000000 as reset, 1 as n from h where k = 1
 union all select h.user_id, h.t, h.k, case when r.reset <= h.t then h.t + 3600000000 else r.reset end, case when r.reset <= h.t then 1 else least(r.n + 1, 3) end from r join h on h.user_id = r.user_id and h.k = r.k + 1)
select user_id, t as at_us, n <= 2 as ok, case when n <= 2 then 0 else greatest(1, ceil((reset - t) / 1000000.0))::bigint end as retry_after from r""")
def rate_limit_fold(spark: SparkSession, d: str) -> DataFrame:
    """Windows that start at a user's first hit."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.rate_limited(e, "user_id", "ts", 2, 3600).select("user_id", F.unix_micros("ts").alias("at_us"), "ok", "retry_after")


@query("""
with recursive i as (select lang, doc_id, n_chars s, row_number() over (partition by lang order by doc_id) k from documents),
r as (select lang, doc_id, s, k, s as held, 0 as shard from i where k = 1
 union all select i.lang, i.doc_id, i.s, i.k, case when r.held > 0 and r.held + i.s > 50000 then i.s else r.held + i.s end, r.shard + (r.held > 0 and r.held + i.s > 50000)::int from r join i on i.lang = r.lang and i.k = r.k + 1)
select lang, doc_id, s::bigint as size, shard from r""")
def bin_pack_fold(spark: SparkSession, d: str) -> DataFrame:
    """O12, S18."""
    return S.packed(table(spark, d, "documents"), "lang", "doc_id", "n_chars", 50_000)


@query("""
with recursive e as (select conv_id * 1000 + turn as node, case when turn > 0 then conv_id * 1000 + turn - 1 end as parent from conversations),
r as (select node, node as root, 0 as depth from e where parent is null union all select e.node, r.root, r.depth + 1 from r join e on e.parent = r.node) select node, root, depth from r""")
def chain_root(spark: SparkSession, d: str) -> DataFrame:
    """O14, O15."""
    node = F.col("conv_id") * 1000 + F.col("turn")
    e = table(spark, d, "conversations").select(node.alias("node"), F.when(F.col("turn") > 0, node - 1).alias("parent"))
    return S.roots(e, "node", "parent")


@query("""
with x as (select *, sum(n_chars) over (order by source, doc_id rows unbounded preceding) u from documents where lang = 'de') select doc_id, n_chars from x where u <= 100000""")
def budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order up to a budget."""
    return S.within_budget(table(spark, d, "documents").where("lang = 'de'"), ["source", "doc_id"], "n_chars", 100_000).select("doc_id", "n_chars")


@query("""
with b as (select l_orderkey as k, min(l_linenumber) as rank from lineitem where l_suppkey = 5 group by all), f as (select l_orderkey as k, min(l_linenumber) + 10 as rank from lineitem where l_suppkey = 9 group by all)
select coalesce(b.k, f.k) as k, case when b.k is not null and f.k is not null then 0 when b.k is not null then 1 else 2 end as tier, coalesce(b.rank, f.rank) as rank from b full join f on b.k = f.k order by tier, rank, k limit 12""")
def boost_merge(spark: SparkSession, d: str) -> DataFrame:
    """O18."""
    x = table(spark, d, "lineitem")
    arm = lambda s: x.where(F.col("l_suppkey") == s).groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("rank"))
    return S.merged_pages(arm(5), arm(9).withColumn("rank", F.col("rank") + 10), ["k"])


@query("""
with c as (select l_partkey as k, l_suppkey % 4 as g, l_linenumber * 1000000 + l_orderkey as r from lineitem),
o as (select *, row_number() over (partition by k order by g, r) n from c), b as (select k, g, r, row_number() over (partition by g order by r, k) n from o where o.n = 1)
select k, g, r from b where n <= 25""")
def claimed_once(spark: SparkSession, d: str) -> DataFrame:
    """O13, W9."""
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 4).alias("g"), (F.col("l_linenumber") * 1_000_000 + F.col("l_orderkey")).alias("r"))
    return S.claimed(c, "k", "g", "r", 25)


@query("""
with p as (select doc_id, len(string_split(text, chr(10))) n from documents), s as (select doc_id, 1 + doc_id % 40 as page, 'ok' as status from documents where lang = 'en'),
u as (select doc_id, unnest(generate_series(1, n)) page from p union select doc_id, page from s)
select u.doc_id, u.page::int as page, status, u.page <= n as image_ready from u join p on p.doc_id = u.doc_id left join s on s.doc_id = u.doc_id and s.page = u.page""")
def page_universe(spark: SparkSession, d: str) -> DataFrame:
    """O32."""
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    pages = table(spark, d, "documents").where("lang = 'en'").select("doc_id", (1 + F.col("doc_id") % 40).cast("int").alias("page"), F.lit("ok").alias("status"))
    return S.page_universe(docs, pages, "doc_id", "n")


@query("""
with w as (select doc_id, md5(text) as hash from documents), p as (select doc_id, case when doc_id % 5 = 0 then 'old' else md5(text) end h, case when doc_id % 4 > 0 then 'r' || doc_id end r from documents where lang <> 'de'),
c as (select md5(text) h, min('c' || doc_id) r from documents where lang = 'fr' group by all)
select w.doc_id, w.hash, case when p.h = w.hash and p.r is not null then p.r else coalesce(c.r, p.r) end as result,
 case when p.h = w.hash and p.r is not null then 'kept' when c.r is not null then 'cache' when p.h is null then 'new' else 'again' end as source
from w left join p on p.doc_id = w.doc_id left join c on c.h = w.hash""")
def three_tier_reuse(spark: SparkSession, d: str) -> DataFrame:
    """O24, O31."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), "lang")
    k = F.col("doc_id")
    p = docs.where("lang <> 'de'").select("doc_id", F.when(k % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(k % 4 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("result"))
    c = docs.where("lang = 'fr'").select("hash", F.concat(F.lit("c"), k.cast("string")).alias("result"))
    return S.reused(docs.select("doc_id", "hash"), p, c, "doc_id")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*)::bigint n from events group by all")
def daily_views_stream(spark: SparkSession, d: str) -> DataFrame:
    """The counters as a stream that reads what is there; every day's state is closed by the last row's watermark or read here from the sink.

    The stream writes its updates by batch; the rows of the last batch win.
    """
    source = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet*" if d.endswith("/") else "*").parquet(f"{d}/events.parquet*")
    counts = counters.daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], late="60 days")
    run = Shared(spark).path()

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{run}/out/part={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{run}/out")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("""
with c as (select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) n from events group by all) select event_type, sum(n)::bigint n from c where day > '2024-01-08' and day <= '2024-01-15' group by all""")
def trailing_week(spark: SparkSession, d: str) -> DataFrame:
    """The trailing sum."""
    return counters.trailing(counters.daily_counts(table(spark, d, "events"), "ts", ["event_type"]), ["event_type"], "2024-01-15")
