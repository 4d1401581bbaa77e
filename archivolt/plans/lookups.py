"""Lookups, filters, screens and small joins on the test tables, each against its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import extract as E
from ..operators import filters as P
from ..operators import joins as J
from ..operators import resolve as R
from ..operators import screening as C
from ..operators import search as X
from ..operators import sequences as S
from ..operators import vectors as V
from ..operators import versions as O
from ..operators import windows as W
from ..sources import catalog, sinks, tables
from ..sources.tables import table
from .registry import query


@query("""
with r as (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) k from lineitem)
select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from r where k = 1 order by l_extendedprice desc, l_orderkey, l_linenumber limit 40""")
def best_line_per_supplier(spark: SparkSession, d: str) -> DataFrame:
    """T5, T7."""
    out = W.best_per(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), [F.col("l_orderkey"), F.col("l_linenumber")], 40)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("select doc_id, lang from documents order by md5('11:' || doc_id), doc_id limit 50")
def shuffled_documents(spark: SparkSession, d: str) -> DataFrame:
    """T9."""
    return W.shuffled_head(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 11, 50)


@query("""
select l_orderkey, max(l_shipdate)::date::varchar as latest from lineitem where l_returnflag <> 'N' group by l_orderkey order by max(strftime(l_shipdate, '%Y-%m-%d')) desc, l_orderkey limit 30""")
def orders_by_latest(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the last of their days."""
    days = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("days"))
    return W.by_latest(days, "days", "l_orderkey").limit(30).select("l_orderkey", F.array_max("days").alias("latest"))


@query("select l_suppkey, count(*) filter (l_returnflag = 'R')::bigint as returned, count(*)::bigint as n from lineitem group by l_suppkey having count(*) filter (l_returnflag = 'R') >= 0.26 * count(*)")
def much_returned(spark: SparkSession, d: str) -> DataFrame:
    """Groups by a count of some of their rows."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"))
    return g.where("returned >= 0.26 * n")


@query("""
select distinct kind, key from (select 'rush' kind, o_custkey key from orders where o_orderpriority like '1%' union all select 'rush', o_custkey from orders where o_totalprice > 300000 union all select 'open', o_custkey from orders where o_orderstatus = 'O') x""")
def changes_once(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several feeds, each once."""
    o = table(spark, d, "orders")
    arm = lambda kind, c: o.where(c).select(F.lit(kind).alias("kind"), F.col("o_custkey").alias("key"))
    return arm("rush", "o_orderpriority like '1%'").union(arm("rush", "o_totalprice > 300000")).union(arm("open", "o_orderstatus = 'O'")).distinct().orderBy("kind", "key")


@query("""
select strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey as doc, case when o_orderstatus = 'F' then 'removed' else 'changed' end as kind, c_name as title
from orders left join customer on c_custkey = o_custkey and c_acctbal >= 0 where o_orderdate >= timestamp '1998-01-01' order by day desc, doc""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """The change log: what changed since a day, with a title where there is one, newest first."""
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    title = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"))
    kind = F.when(F.col("o_orderstatus") == "F", "removed").otherwise("changed")
    return o.join(title, "o_custkey", "left").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").alias("doc"), kind.alias("kind"), "title").orderBy(F.desc("day"), "doc")


_CITED = [(1, 1), (1, 1), (2, 2), (3, 1), (5, 9), (7, 3), (999_999_999, 1)]


@query(f"select l_orderkey as doc, l_linenumber as page, l_partkey from lineitem where (l_orderkey, l_linenumber) in (values {', '.join(map(str, _CITED))})")
def resolved_citations(spark: SparkSession, d: str) -> DataFrame:
    """Batch citation resolve: the rows of cited pages; what is cited twice once, what is not there not at all."""
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), "l_partkey")
    return J.cited(pages, _CITED, "doc", "page")


@query("select doc_id, coalesce(source = (select source from documents where doc_id = 1), false) as same from documents where doc_id <> 1")
def same_box(spark: SparkSession, d: str) -> DataFrame:
    """The flag."""
    return J.same_value(table(spark, d, "documents"), "doc_id", "source", 1).select("doc_id", "same")


@query("""
with w as (select a.doc_id, list_intersect(regexp_extract_all(lower(a.text), '[a-z]{4,}'), regexp_extract_all(lower(b.text), '[a-z]{4,}')) x from documents a join documents b on b.doc_id = a.doc_id + 1)
select doc_id, len(list_distinct(x)) >= 10 as holds from w""")
def corroborated_texts(spark: SparkSession, d: str) -> DataFrame:
    """A document and the next one have 10 words in common."""
    w = table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("w"))
    other = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("o"))
    return w.join(other, "doc_id").select("doc_id", W.corroborated(F.col("w"), F.col("o")).alias("holds"))


_PHRASES = ["the and", "de la", "und der", "in the", "la de"]


@query("select doc_id, (" + " + ".join(f"regexp_matches(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '(^|[^0-9.]){p}($|[^0-9.]|\\.$|\\.[^0-9])')::int" for p in _PHRASES) + ")::int as n from documents")
def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """E28."""
    return table(spark, d, "documents").select("doc_id", E.phrase_recall(F.col("text"), _PHRASES).cast("int").alias("n"))


@query("select l_partkey, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber)) filter (l_returnflag <> 'N') as flag from lineitem group by l_partkey")
def first_known_flag(spark: SparkSession, d: str) -> DataFrame:
    """The first return flag that is one."""
    x = table(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return x.groupBy("l_partkey").agg(A.first_known(F.col("flag"), F.col("l_orderkey"), F.col("l_linenumber")).alias("flag"))


@query("select o_orderkey, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as after from orders where o_orderstatus = 'O' and upper(left(o_orderpriority, 3)) = '1-U'")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """A parameter that is given, one that is not, a prefix in any case, the day after."""
    o = table(spark, d, "orders").where(P.optional("O", lambda v: F.col("o_orderstatus") == v) & P.optional(None, lambda v: F.col("o_custkey") == v) & P.loose(F.col("o_orderpriority"), "1-u"))
    return o.select("o_orderkey", P.day_after(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("after"))


@query("select l_orderkey, l_linenumber, case when l_quantity > 40 then 'test' when l_returnflag in ('A', 'R') then 'inspection' else 'mention' end as kind from lineitem")
def record_kinds(spark: SparkSession, d: str) -> DataFrame:
    """F12."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.record_kind(F.col("l_quantity") > 40, F.col("l_returnflag"), ["A", "R"]).alias("kind"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select distinct c_custkey from customer where c_mktsegment = 'BUILDING' order by 1 limit 1000)")
def restricted_orders(spark: SparkSession, d: str) -> DataFrame:
    """at most 1,000 ids, the smallest."""
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.restricted(table(spark, d, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query("select event_id, event_type = 'error' or regexp_matches(event_type, '(?i)curl/|bot') as bot, regexp_matches(event_type, '(?i)\\b(view|click)\\b') as listed from events")
def readers(spark: SparkSession, d: str) -> DataFrame:
    """events as agents; an error has no agent."""
    agent = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", P.is_bot(agent).alias("bot"), P.whole_words(F.col("event_type"), "view", "click").alias("listed"))


@query("select doc_id, n_chars * case when lang = 'de' then 0.5 else 1 end::double as score, lang is distinct from 'de' as kept from documents")
def penalised_scores(spark: SparkSession, d: str) -> DataFrame:
    """half the score where shown, out where not."""
    half, _ = P.penalised(F.col("n_chars").cast("double"), F.col("lang"), "de", True)
    _, kept = P.penalised(F.col("n_chars").cast("double"), F.col("lang"), "de", False)
    return table(spark, d, "documents").select("doc_id", half.alias("score"), kept.alias("kept"))


@query("select doc_id, max(score) score from (select doc_id, n_chars::double score from documents where lang = 'en' union all select doc_id, n_chars * 0.5 from documents where source < 'src5' union all select doc_id, 1e9 from documents where doc_id = 7) x group by all")
def best_of_fields(spark: SparkSession, d: str) -> DataFrame:
    """The best field's score; the exact id first."""
    x = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    found = X.best_field([(x.where("lang = 'en'"), 1.0), (x.where("source < 'src5'"), 0.5)], "doc_id")
    return X.lookup_first(x.where("doc_id = 7"), found, "doc_id")


@query("select count(*) filter (lang is distinct from 'en')::bigint as hidden from documents where text ilike '%tion%'")
def hidden_matches(spark: SparkSession, d: str) -> DataFrame:
    """X14."""
    return X.hidden_rows(table(spark, d, "documents").where(P.contains(F.col("text"), "tion")), F.col("lang") == "en")


@query("""
select vec_id, label, word from embeddings, (values ('zebra crossing'), ('tion')) w(word) where exists (select 1 from documents where text ilike '%' || word || '%')""")
def gated_arm(spark: SparkSession, d: str) -> DataFrame:
    """No lexical hit, no semantic arm."""
    docs, semantic = table(spark, d, "documents"), table(spark, d, "embeddings").select("vec_id", "label")
    none, some = (X.gated(semantic.withColumn("word", F.lit(w)), docs.where(P.contains(F.col("text"), w))) for w in ("zebra crossing", "tion"))
    return none.union(some)


@query("""
with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) w from documents)
select w as word, list_filter([w, case when w like '%ies' then left(w, -3) || 'y' end, case when w like '%es' then left(w, -2) end, case when w like '%s' then left(w, -1) end], lambda x: x is not null) as stems from w where w like '%s'""")
def plural_stems(spark: SparkSession, d: str) -> DataFrame:
    """X17."""
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))).alias("word")).distinct()
    return w.where(F.col("word").endswith("s")).select("word", X.stems(F.col("word")).alias("stems"))


@query("""
with s as (select conv_id, turn, text, role, row_number() over (partition by role, conv_id order by turn desc) k from conversations)
select role, conv_id, turn from s where k = 1 and length(text) > 100""")
def accepted_of_the_day(spark: SparkSession, d: str) -> DataFrame:
    """Of each day the last snapshot that was accepted; a conversation is a day, a turn a name."""
    c = table(spark, d, "conversations").select(F.concat_ws("/", "role", "conv_id").alias("day"), "role", "conv_id", F.col("turn").alias("name"), F.lit(True).alias("accepted"), "text")
    return O.accepted_snapshots(c).where(F.length("text") > 100).select("role", "conv_id", F.col("name").alias("turn"))


@query("""
select event_id as id from events where event_type = 'view' and ts >= timestamp '2024-01-20' - interval 30 days and event_id % 3 > 0 and event_id % 5 > 0 order by ts desc, event_id limit 1""")
def newest_cached_answer(spark: SparkSession, d: str) -> DataFrame:
    """A question asked before in other case and blanks; not a follow-up, not superseded."""
    e = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit(" "), F.upper("event_type")).alias("question"), F.when(F.col("event_id") % 3 == 0, 1).alias("parent_id"), F.when(F.col("event_id") % 5 == 0, 1).alias("superseded_by"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    return S.newest_answer(e, F.lit("View  "), F.lit("2024-01-20").cast("timestamp")).select("id")


@query("select distinct p_type as content, substr(sha256(p_type), 1, 16) as code from part where p_type not in (select p_type from part where p_partkey <= 2)")
def new_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents without a code yet, each once."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("content"))
    known = p.where("p_partkey <= 2").select(F.substring(F.sha2("content", 256), 1, 16).alias("code"))
    return S.stored_once(p, known, "content")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'")
def current_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The state is the build."""
    return S.current(table(spark, d, "orders").withColumn("build_id", F.col("o_orderstatus")), "P").select("o_orderkey", "o_totalprice")


@query("select strftime(o_orderdate, '%Y-%m-%d') as day, o_orderstatus as kind, o_orderkey as document from orders where strftime(o_orderdate, '%Y-%m-%d') >= '1997-06-01' order by day desc, kind, document limit 25 offset 5")
def changes_since(spark: SparkSession, d: str) -> DataFrame:
    """O21."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("document"))
    return O.since(o, "1997-06-01", 25, 5)


@query("""
with n as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) v from embeddings)
select n.vec_id, round(list_dot_product(n.v, q.v), 6) as score from n, (select v from n where vec_id = 3) q order by round(list_dot_product(n.v, q.v), 9) desc, vec_id limit 20""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """V2, V3: the nearest to one vector, of unit length."""
    e = table(spark, d, "embeddings")
    dim = e.select(F.size("embedding")).first()[0]
    n = e.select("vec_id", V.normalised(F.col("embedding"), dim).alias("v"))
    return V.nearest_to(n, "v", n.where("vec_id = 3").first()["v"], 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("""
with m as (select label, i, avg(x::double) x from (select label, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings) t group by all),
c as (select label, list(x order by i) v from m group by all), n as (select label, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) u from c),
r as (select vec_id, e.label, row_number() over (partition by e.label order by round(list_dot_product(embedding::double[], u), 9) desc, vec_id) k from embeddings e join n on n.label = e.label)
select label, vec_id, k::int as rank from r where k <= 3""")
def central_vectors(spark: SparkSession, d: str) -> DataFrame:
    """V13."""
    return V.central(table(spark, d, "embeddings"), "label", "embedding", "vec_id", 3).select("label", "vec_id", "rank")


@query("select o_orderkey from orders where (o_orderstatus, o_orderpriority) in (select (o_orderstatus, o_orderpriority) from orders where o_orderkey <= 3 and o_orderstatus <> 'O')")
def folder_siblings(spark: SparkSession, d: str) -> DataFrame:
    """An order of status O has no folder, and so no siblings."""
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("box"), "o_orderpriority")
    return J.siblings(o, ["box", "o_orderpriority"], o.where("o_orderkey <= 3")).select("o_orderkey")


@query("""
with e as (select user_id, event_id, floor(epoch(ts) - epoch(timestamp '2024-01-01'))::bigint s, event_type from events where user_id <= 20), c as (select user_id, s, min(event_id) id from e where event_type = 'click' group by all),
p as (select e.user_id, e.event_id, c.s cs, abs(c.s - e.s) gap, row_number() over (partition by e.event_id order by abs(c.s - e.s), c.s) k from e left join c on c.user_id = e.user_id and abs(c.s - e.s) <= 40000 where event_type = 'error')
select event_id, cs as click_at from p where k = 1""")
def nearest_click(spark: SparkSession, d: str) -> DataFrame:
    """Of each error the click of its user that is nearest in time, the earlier of equals."""
    s = F.floor(F.col("ts").cast("timestamp").cast("double") - F.lit("2024-01-01").cast("timestamp").cast("double")).cast("long")
    e = table(spark, d, "events").where("user_id <= 20").select("user_id", "event_id", "event_type", s.alias("start"))
    clicks = e.where("event_type = 'click'").groupBy("user_id").agg(F.collect_set(F.struct("start")).alias("c"))
    out = e.where("event_type = 'error'").join(clicks, "user_id", "left").withColumn("x", J.nearest(F.col("start"), F.col("c"), 40_000))
    return out.select("event_id", F.col("x.start").alias("click_at"))


@query("select n_nationkey, n_name, s_n::bigint as suppliers from nation join (select s_nationkey, count(*) s_n from supplier group by all) s on s_nationkey = n_nationkey")
def filled_in(spark: SparkSession, d: str) -> DataFrame:
    """New values only where there are none yet: half the nations have theirs."""
    n = table(spark, d, "nation")
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    old = counts.withColumn("suppliers", F.when(F.col("n_nationkey") % 2 == 0, F.col("suppliers")))
    new = counts.withColumn("suppliers", F.when(F.col("n_nationkey") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("suppliers")))
    return n.select("n_nationkey", "n_name").join(R.filled(new, old, "n_nationkey", "suppliers"), "n_nationkey")


@query("select lot as key, min(b)::bigint as building from (select l_orderkey lot, l_partkey b from lineitem) x where lot % 7 = 0 and b in (select p_partkey from part where p_size > 25) group by all")
def lot_redirects(spark: SparkSession, d: str) -> DataFrame:
    """A lot to the smallest of its buildings that has rows."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lot"), F.col("l_partkey").alias("building"))
    asked = l.where("lot % 7 = 0").select(F.col("lot").alias("key")).distinct()
    return R.redirects(asked, l, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("building")))


@query("""
select 'dup' as rule, count(*)::bigint as n from customer where c_custkey % 10 = 0 union all select 'poor', count(*) from customer where c_acctbal < 0 union all select 'no-name', count(*) from customer where c_name is null having count(*) > 0""")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break rules, by rule."""
    c = table(spark, d, "customer")
    return sinks.violations(c, {"dup": F.col("c_custkey") % 10 == 0, "poor": F.col("c_acctbal") < 0, "no-name": F.col("c_name").isNull()}, "c_custkey").groupBy("rule").agg(F.count("*").alias("n"))


@query("""
with e as (select p_partkey k, p_size s, md5(p_name) h from part where p_partkey % 11 > 0), a as (select p_partkey k, p_size + (p_partkey % 13 = 0)::int s, md5(p_name || case when p_partkey % 17 = 0 then 'x' else '' end) h from part where p_partkey % 19 > 0)
select case when a.k is null then 'missing' when e.k is null then 'extra' when e.s <> a.s then 'size' when e.h <> a.h then 'hash' else 'ok' end as state, count(*)::bigint as n from e full join a on e.k = a.k group by all""")
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    """S17."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    expected = p.where("p_partkey % 11 > 0").select("p_partkey", F.col("p_size").alias("bytes"), F.md5("p_name").alias("sha256"))
    actual = p.where("p_partkey % 19 > 0").select("p_partkey", (F.col("p_size") + (k % 13 == 0).cast("int")).alias("bytes"), F.md5(F.concat("p_name", F.when(k % 17 == 0, "x").otherwise(""))).alias("sha256"))
    return sinks.verify_report(expected, actual, "p_partkey")


@query("select p_name as path, p_size as size, p_partkey as mtime from part where p_partkey % 3 > 0 or p_size = 7")
def files_to_pack(spark: SparkSession, d: str) -> DataFrame:
    """New files, and those whose time has changed."""
    f = table(spark, d, "part").select(F.col("p_name").alias("path"), F.col("p_size").alias("size"), F.col("p_partkey").alias("mtime"))
    return sinks.changed_files(f, f.where("mtime % 3 = 0").withColumn("mtime", F.when(F.col("size") == 7, -1).otherwise(F.col("mtime"))))


@query("""
with r as (select o_orderkey, '2024-01-' || lpad((o_orderkey % 9 + 1)::varchar, 2, '0') as day, md5(o_orderpriority) as sha256 from orders where o_orderkey <= 400),
known as (select distinct '2024-01-' || lpad((o_orderkey % 4 + 1)::varchar, 2, '0') as day, md5('1-URGENT') as sha256 from orders)
select distinct r.day, r.sha256, case when k.day is not null then r.day || '.csv' when d.day is not null then r.day || 'T191530.csv' else r.day || '.csv' end as name, k.day is not null as reused
from r left join known k on k.day = r.day and k.sha256 = r.sha256 left join (select distinct day from known) d on d.day = r.day""")
def named_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Equal content of a day keeps its name, other content of the day gets the time of day in New York."""
    o = table(spark, d, "orders")
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad((F.col("o_orderkey") % n + 1).cast("string"), 2, "0"))
    new = o.where("o_orderkey <= 400").select(day(9).alias("day"), F.md5("o_orderpriority").alias("sha256"), F.lit("2024-01-02 00:15:30").cast("timestamp").alias("fetched_at")).distinct()
    known = o.select(day(4).alias("day"), F.md5(F.lit("1-URGENT")).alias("sha256")).distinct().withColumn("name", F.concat("day", F.lit(".csv")))
    return catalog.snapshot_names(new, known)


@query("select c_custkey, c_name, null::double as rating, c_acctbal::varchar as balance from customer")
def conformed_customers(spark: SparkSession, d: str) -> DataFrame:
    """Declared columns, absent ones as typed nulls, whatever the case of the names."""
    from pyspark.sql import types as Y

    schema = Y.StructType([Y.StructField("C_CUSTKEY", Y.LongType()), Y.StructField("c_name", Y.StringType()), Y.StructField("rating", Y.DoubleType()), Y.StructField("c_acctbal", Y.StringType())])
    return tables.conformed(table(spark, d, "customer"), schema).toDF("c_custkey", "c_name", "rating", "balance")


@query("""
with o as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders)
select o_orderkey, substr(day, 1, 7) as month, day < '1995-01-01' as early, (2000 + o_orderkey // 12)::int || '-' || lpad((o_orderkey % 12 + 1)::varchar, 2, '0') as indexed, true as valid from o where o_orderkey < 5000""")
def day_functions(spark: SparkSession, d: str) -> DataFrame:
    """§2.8: months of days, months by index, whole dates."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").where("o_orderkey < 5000").select("o_orderkey", D.month_of(day).alias("month"), (day < "1995-01-01").alias("early"), D.month_index(F.col("o_orderkey"), 2000).alias("indexed"), (D.is_date(day) & ~D.is_date(F.concat(day, F.lit("x")))).alias("valid"))


@query("""
select p_partkey, p_partkey as back from part""")
def short_codes(spark: SparkSession, d: str) -> DataFrame:
    """There and back."""
    p = table(spark, d, "part").select("p_partkey", T.short_code(F.col("p_partkey") * 7919, F.col("p_size")).alias("code"), "p_size")
    number, page = T.from_short_code(F.col("code"))
    return p.where(F.col("code").isNull() | page.eqNullSafe(F.col("p_size"))).select("p_partkey", number.cast("long").alias("n")).selectExpr("p_partkey", "n div 7919 as back")


@query("""
with o as (select o_orderkey, md5(o_orderpriority) fingerprint, o_custkey % 4 s from orders), d as (select o_orderkey, case when o_orderkey % 5 = 0 then 'old' else md5(o_orderpriority) end f, case o_custkey % 4 when 0 then 'done' when 1 then 'error' when 2 then 'later' end s, o_orderkey % 2 = 0 r from orders where o_orderkey % 3 > 0)
select o.o_orderkey, o.fingerprint, case when d.f is distinct from o.fingerprint then 'due' when d.s = 'done' then 'done' when d.r then 'deferred' when d.s = 'error' then 'error' else 'due' end as state from o left join d on d.o_orderkey = o.o_orderkey""")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """O10."""
    o, k, s = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 4
    now = F.lit("2024-01-01").cast("timestamp")
    done = o.where(k % 3 > 0).select("o_orderkey", F.when(k % 5 == 0, "old").otherwise(F.md5("o_orderpriority")).alias("fingerprint"), F.when(s == 0, "done").when(s == 1, "error").when(s == 2, "later").alias("state"), F.when(k % 2 == 0, F.lit("2024-02-01").cast("timestamp")).otherwise(F.lit("2023-02-01").cast("timestamp")).alias("retry_at"))
    return S.queue_state(o.select("o_orderkey", F.md5("o_orderpriority").alias("fingerprint")), done, "o_orderkey", now)


@query("""
with h as (select c_custkey, (c_custkey % 90)::varchar || case when c_custkey % 4 = 0 then '-' || (c_custkey % 7)::varchar else '' end house, case when c_custkey % 3 = 0 then '1' || lpad((c_custkey % 400)::varchar, 5, '0') || '0007' end lot, case c_custkey % 5 when 0 then true when 1 then false end on_roll from customer)
select c_custkey, case when lot is not null or coalesce(on_roll, true) then 'Manhattan' when house like '%-%' then 'Queens' else 'Outside Manhattan' end as borough, case when lot is not null then c_custkey % 400 < 196 else coalesce(on_roll, false) end as downtown from h""")
def boroughs(spark: SparkSession, d: str) -> DataFrame:
    """E15."""
    k = F.col("c_custkey")
    house = F.concat((k % 90).cast("string"), F.when(k % 4 == 0, F.concat(F.lit("-"), (k % 7).cast("string"))).otherwise(""))
    lot, on_roll = F.when(k % 3 == 0, R.lot_key(k % 400, F.lit(7))), F.when(k % 5 == 0, True).when(k % 5 == 1, False)
    return table(spark, d, "customer").select("c_custkey", R.borough(house, lot, on_roll).alias("borough"), R.is_downtown(lot, on_roll).alias("downtown"))


@query("""
with l as (select n_nationkey k, n_name n from nation) select k as n_nationkey, case when k % 4 = 0 then false when k % 4 = 1 then true when k % 4 = 2 then false else true end as personal from l""")
def personal_labels(spark: SparkSession, d: str) -> DataFrame:
    """E31, the acronyms: agencies and street names are no persons; initials and family names are."""
    k = F.col("n_nationkey") % 4
    label = F.when(k == 0, "DCAS").when(k == 1, "J. Smith").when(k == 2, "Chambers Street").otherwise("DOE, JANE")
    return table(spark, d, "nation").select("n_nationkey", C.names_a_person(label).alias("personal"))


@query("""
with c as (select o_orderkey, (o_totalprice / 1000)::int / 100.0 v, case when o_orderkey % 3 > 0 then 'Action Level: ' || (o_custkey % 9 + 1) || '.5 f/cc' else 'no level given' end t from orders),
d as (select *, case when o_orderkey % 2 = 0 then 40 else 400 end gap from c)
select o_orderkey, case when o_orderkey % 3 > 0 and gap = 40 then (o_custkey % 9 + 1) + 0.5 end::double as level, case when o_orderkey % 3 > 0 and gap = 40 then case when 3.0 <= o_custkey % 9 + 1.5 then 'below' else 'above' end end as result from d join orders using (o_orderkey)""")
def limits_near(spark: SparkSession, d: str) -> DataFrame:
    """The limit within 250 characters of a reading, and on which side of it the reading is."""
    k = F.col("o_orderkey")
    level = F.when(k % 3 > 0, F.concat(F.lit("Action Level: "), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(".5 f/cc"))).otherwise("no level given")
    gap = F.when(k % 2 == 0, F.repeat(F.lit("x "), F.lit(20))).otherwise(F.repeat(F.lit("x "), F.lit(200)))
    text = F.concat(F.lit("3.0 f/cc "), gap, level)
    x = table(spark, d, "orders").select("o_orderkey", E.limit_near(text, F.lit(0)).alias("x"))
    return x.select("o_orderkey", F.col("x.limit").alias("level"), E.compared(F.lit(3.0), F.col("x.limit")).alias("result"))
