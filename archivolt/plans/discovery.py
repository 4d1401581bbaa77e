"""Search, vectors, text and extraction on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.distance import osa_distance
from ..operators import aggregates as A
from ..operators import extract as E
from ..operators import joins as J
from ..operators import resolve as R
from ..operators import search as X
from ..operators import vectors as V
from ..sources.sinks import row_hash
from ..sources.tables import table
from .registry import query

QUERY = ["the", "tion", "ation", "and"]
_BM25 = """
t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') t from documents),
r as (select doc_id, len(t) n, t from t where len(t) > 0),
tot as (select count(*) n, avg(n) m from r),
c as (select doc_id, n, unnest(['and', 'ation', 'the', 'tion']) w, t from r),
f as (select doc_id, n, w, len(list_filter(t, lambda x: x = w)) tf from c),
df as (select w, count(*) filter (tf > 0) df from f group by w),
bm as (select doc_id, sum(ln(1 + (tot.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * f.n / m))) score from f join df on f.w = df.w, tot group by doc_id having sum(tf) > 0)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return X.bm25(table(spark, d, "documents", spread=True), "doc_id", "text", QUERY)


@query(f"with {_BM25} select doc_id, round(score, 6) as score from bm order by score desc, doc_id limit 50")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    return _bm25(spark, d).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(50)


_VECTOR = """
q as (select embedding e from embeddings where vec_id = 0),
v as (select vec_id as doc_id, round(list_dot_product(embedding::double[], e::double[]), 9) score from embeddings, q)"""


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), F.round(V.dot(F.col("embedding"), F.col("q")), 9).alias("score"))


@query(f"""
with {_BM25}, {_VECTOR},
a as (select doc_id, row_number() over (order by round(score, 9) desc, doc_id) k from bm), b as (select doc_id, row_number() over (order by score desc, doc_id) k from v)
select doc_id, round(sum(1.0 / (60 + k)), 9) as score from (select * from a where k <= 200 union all select * from b where k <= 200) u group by doc_id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    lexical = _bm25(spark, d).withColumn("score", F.round("score", 9))
    return X.reciprocal_ranks([lexical, _semantic(spark, d)], "doc_id", 200).withColumn("score", F.round("score", 9))


@query(f"""
with {_BM25}, {_VECTOR},
a as (select doc_id, round(score, 9) s from bm order by s desc, doc_id limit 100), b as (select doc_id, score s from v order by s desc, doc_id limit 100),
u as (select doc_id, 0.4 * (s - (select min(s) from a)) / (select max(s) - min(s) from a) p from a union all select doc_id, 0.6 * (s - (select min(s) from b)) / (select max(s) - min(s) from b) from b)
select doc_id, round(sum(p), 6) as score from u group by doc_id""")
def minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Pool 100; an arm without the row gives 0."""
    lexical = _bm25(spark, d).withColumn("score", F.round("score", 9))
    return X.weighted_scores([(lexical, 0.4), (_semantic(spark, d), 0.6)], "doc_id", 100).withColumn("score", F.round("score", 6))


@query("""
with x as (select 'lang' as field, lang as value from documents union all select 'source', source from documents union all
 select 'word', w from (select unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: len(x) > 2))) w from documents) t),
c as (select field, value, count(*)::bigint n from x where value is not null group by all), r as (select *, row_number() over (partition by field order by n desc, value)::int as rank from c)
select * from r where rank <= 15""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    """Three fields, one of many values."""
    x = table(spark, d, "documents").select("lang", "source", F.filter(F.split("text", " "), lambda w: F.length(w) > 2).alias("word"))
    return X.facets(x, ["lang", "source", "word"])


@query("""
with p as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) term from documents),
tf as (select doc_id, lang, term, count(*) tf from p group by all), n as (select count(*) n from documents), df as (select term, count(*) df from tf group by all),
w as (select doc_id, lang, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1.0 + df)) + 1) w from tf join df on tf.term = df.term, n where df >= least(3, greatest(1, n // 50)) and df <= 0.5 * n),
u as (select *, w / sqrt(sum(w * w) over (partition by doc_id)) x from w),
g as (select lang, count(*) ng from documents group by all), s as (select lang, term, sum(x) s from u group by all), a as (select term, sum(s) sa from s group by all),
l as (select s.lang, s.term, round(s / ng - sa / n, 9) lift from s join g on g.lang = s.lang join a on a.term = s.term, n), r as (select *, row_number() over (partition by lang order by lift desc, term) k from l)
select lang, term, lift from r where k <= 8""")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms by language."""
    docs = table(spark, d, "documents", spread=True)
    return X.distinctive(X.tfidf(docs, "doc_id", "text"), docs, "doc_id", "lang", 8).select("lang", "term", "lift")


@query()
def best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """X11."""
    return table(spark, d, "documents", spread=True).select("doc_id", X.excerpt(F.col("text"), ["shtion", "ênoi", "mente"], 200).alias("excerpt"))


_FLAGGED = ", ".join(f"'{w}'" for w in X.QUESTION_WORDS)


@query(f"""
with b as (select conv_id, turn, trim(text) q, list_filter([lower(regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) for w in regexp_split_to_array(trim(text), '\\s+')], lambda w: w <> '') t from conversations),
f as (select unnest([{_FLAGGED}]) f), u as (select conv_id, turn, unnest(t) w from b),
g as (select distinct conv_id, turn from u join f on w = f or (len(w) >= 3 and len(f) >= 3 and abs(len(w) - len(f)) <= 1 and damerau_levenshtein(w, f) <= 1))
select b.conv_id, b.turn, case when q = '' then 'keyword' when regexp_matches(q, '^[0-9]{{6,9}}$') then 'id' when not contains(q, '?') and len(t) between 1 and 4 and g.turn is null then 'keyword' else 'model' end as route
from b left join g on g.conv_id = b.conv_id and g.turn = b.turn""")
def query_route(spark: SparkSession, d: str) -> DataFrame:
    """O19. At a distance of one, the unrestricted distance of the SQL is the same."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.route(F.col("text")).alias("route"))


@query("""
with r as (select a.vec_id, b.vec_id as other, a.label <> b.label as cross, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a join embeddings b on a.vec_id <> b.vec_id),
k as (select *, (row_number() over (partition by vec_id order by score desc, other) - 1)::int as rank from r) select vec_id, other, score, rank, "cross" from k where rank < 20""".replace("as cross,", 'as "cross",'))
def related_topk(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of rows multiplied, the best 20 of each row."""
    e = table(spark, d, "embeddings")
    pairs = V.related(e, "vec_id", "embedding", block=256)
    labels = e.select("vec_id", "label")
    other = labels.select(F.col("vec_id").alias("other"), F.col("label").alias("o_label"))
    return pairs.join(labels, "vec_id").join(other, "other").select("vec_id", "other", "score", F.col("rank").cast("int").alias("rank"), (F.col("label") != F.col("o_label")).alias("cross"))


@query("""
with r as (select a.vec_id, b.vec_id as other, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a join embeddings b on a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by vec_id order by score desc, other) k from r) select vec_id, other, score from k where k <= 20 and score >= 0.35 and vec_id < other""")
def near_dupes_cosine(spark: SparkSession, d: str) -> DataFrame:
    """V5: only among the best 20, and from the smaller key's list. The tables' vectors call for a lower threshold than .97."""
    pairs = V.related(table(spark, d, "embeddings"), "vec_id", "embedding", block=256)
    return V.near_within_top(pairs, "vec_id", 0.35)


@query("""
with h as (select sha256(text) h, min(doc_id) as first, count(*) n from documents group by all) select doc_id, first as kept_doc, n::bigint copies from documents join h on h = sha256(text) where n > 1""".replace("min(doc_id) as first", 'min(doc_id) as "first"').replace("first as kept_doc", '"first" as kept_doc'))
def near_dupes_exact(spark: SparkSession, d: str) -> DataFrame:
    """Equal content by hash."""
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    g = x.groupBy("h").agg(F.min("doc_id").alias("kept_doc"), F.count("*").alias("copies")).where("copies > 1")
    return x.join(g, "h").select("doc_id", "kept_doc", "copies")


@query("""
with m as (select label, i, avg(x::double) x from (select label, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings) t group by all),
c as (select label, list(x order by i) v from m group by all), n as (select label, [y / sqrt(list_dot_product(v, v)) for y in v] u from c),
s as (select vec_id, e.label, list_dot_product(embedding::double[], u) s from embeddings e join n on n.label = e.label), d as (select *, 1 - s dd from s),
r as (select vec_id, label, s, greatest(0.05, least(1.0, 1 - dd / max(dd) over (partition by label))) p, row_number() over (partition by label order by round(s, 9) desc, vec_id) k from d)
select vec_id, label, round(s, 6) as score, round(p, 6) as probability, k::int as rank from r""")
def centroid_membership(spark: SparkSession, d: str) -> DataFrame:
    """A30, V11; the rank of V13 over all rows."""
    e = table(spark, d, "embeddings")
    mean = A.mean_vector(e, ["label"], "embedding").withColumnRenamed("embedding", "u")
    s = e.join(mean, "label").withColumn("s", V.dot(F.col("embedding"), F.col("u")))
    p = s.withColumn("p", V.probability(1 - F.col("s"), ["label"]))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("s", 9)), "vec_id"))
    return p.select("vec_id", "label", F.round("s", 6).alias("score"), F.round("p", 6).alias("probability"), rank.alias("rank"))


@query("""
with p as (select unnest([1, 5, 9]) vec_id, unnest([0, 1, 2]) place), r as (select b.vec_id as item, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) score, place from p join embeddings a on a.vec_id = p.vec_id join embeddings b on b.vec_id <> a.vec_id),
k as (select r.*, row_number() over (partition by place order by score desc, item) n from r), f as (select * from k where n <= 20 and item not in (1, 5, 9)), g as (select item, max(score) score from f group by all)
select g.item, g.score, min(place)::int as place from g join f on f.item = g.item and f.score = g.score group by g.item, g.score order by g.score desc, place, item limit 8""")
def pooled_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """V8."""
    pairs = V.neighbours_of(table(spark, d, "embeddings"), "vec_id", "embedding", [1, 5, 9])
    saved = spark.createDataFrame([(1, 0), (5, 1), (9, 2)], "vec_id long, place int")
    return V.pooled_suggestions(saved, pairs, "vec_id").select("item", "score", "place")


@query("""
with n as (select doc_id, text, len(text) n from documents), s as (select doc_id, text, n, unnest(generate_series(0, case when n <= 3000 then 0 else (ceil((n - 3000) / 2700.0) * 2700)::bigint end, 2700)) as start from n)
select doc_id, start::int as start, least(start + 3000, n)::int as "end", (start // 2700)::int as chunk, md5(substr(text, (start + 1)::bigint, (least(start + 3000, n) - start)::bigint)) as digest from s""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """V1."""
    return V.chunks(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "start", "end", "chunk", F.md5("piece").alias("digest"))


_LINES = "l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line, unnest(string_split(text, chr(10))) t from documents)"


@query(f"""
with {_LINES}, c as (select doc_id, line, trim(regexp_replace(t, '\\s+', ' ', 'g')) s, line % 5 = 0 ours from l)
select doc_id, line::int as line, case when len(s) < 80 then 'empty' when ours then 'ocr' when len(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) / greatest(len(s), 1) < 0.25 then 'junk' else 'ok' end as status from c""")
def page_status(spark: SparkSession, d: str) -> DataFrame:
    """E3."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("line", F.col("i") + 1)
    return x.select("doc_id", "line", T.page_status(F.col("t"), F.col("line") % 5 == 0).alias("status"))


@query("""
with x as (select doc_id, case when doc_id % 3 = 0 then substr(text, 1, 40) else text end o, case when doc_id % 2 = 0 then text end c, case doc_id % 5 when 0 then true when 1 then false end a from documents),
y as (select *, coalesce(case when a then true when not a then false else len(trim(regexp_replace(o, '\\s+', ' ', 'g'))) < 80 and len(trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'))) >= 80 end, false) ours from x)
select doc_id, ours, md5(case when ours then coalesce(c, '') else o end) as digest from y""")
def text_selection(spark: SparkSession, d: str) -> DataFrame:
    """Three states of acceptance."""
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", F.when(k % 3 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("o"), F.when(k % 2 == 0, F.col("text")).alias("c"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("a"))
    text, ours = E.chosen_text(F.col("o"), F.col("c"), F.col("a"))
    return x.select("doc_id", ours.alias("ours"), F.md5(text).alias("digest"))


@query()
def whole_text_selection(spark: SparkSession, d: str) -> DataFrame:
    """A document's whole text or that of the page of the same number; its label is the acceptance, none leaves it open."""
    page = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), T.html_text(F.col("html")).alias("c"))
    label = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("a"))
    x = table(spark, d, "documents").select("doc_id", F.col("text").alias("o")).join(page, "doc_id", "left").join(label, "doc_id", "left")
    text, ours = E.chosen_text(F.col("o"), F.col("c"), F.col("a"))
    return x.select("doc_id", ours.alias("ours"), F.md5(text).alias("digest"))


@query("""
select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'))::int as n_mail, len(regexp_extract_all(text, '[0-9]+\\.[0-9]+'))::int as n_decimal, len(regexp_extract_all(lower(text), '\\b(the|des|und|los)\\b'))::int as n_listed from documents""")
def pii_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of patterns and of listed words."""
    n = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), 1))
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", n(t, "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)").alias("n_mail"), n(t, r"([0-9]+\.[0-9]+)").alias("n_decimal"), n(F.lower(t), r"(?<![A-Za-z0-9_])(the|des|und|los)(?![A-Za-z0-9_])").alias("n_listed"))


@query()
def gazetteer_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with offsets in texts that a rule makes from orders."""
    return E.mention_rows(_reports(spark, d), ["doc", "page"], "text", agencies=("DEP", "EPA"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Small lab reports: one page an order."""
    o = table(spark, d, "orders")
    day = F.date_format(F.add_months("o_orderdate", 24), "M/d/yyyy")
    unit = F.element_at(F.array(*map(F.lit, ("f/cc", "mg/kg", "ppm"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    sub = F.element_at(F.array(*map(F.lit, ("asbestos", "lead", "mercury", "dust"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    text = F.concat_ws("\n", F.concat(F.lit("Reviewed by: John Smith, Chief Engineer, "), F.lit("EPA")), F.concat(F.lit("Date: "), day), F.concat(sub, F.lit(" result "), F.format_string("%.2f", F.col("o_totalprice") / 10000), F.lit(" "), unit))
    return o.select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), text.alias("text"))


@query()
def role_mentions(spark: SparkSession, d: str) -> DataFrame:
    """E6."""
    return E.role_rows(_reports(spark, d), ["doc", "page"], "text")


@query("""
select o_orderkey as doc, (array['asbestos', 'lead', 'mercury', 'dust'])[1 + o_custkey % 4] as substance, 0.5::double as confidence from orders where o_totalprice >= 0
""".replace("array['asbestos', 'lead', 'mercury', 'dust']", "['asbestos', 'lead', 'mercury', 'dust']"))
def fact_pairing(spark: SparkSession, d: str) -> DataFrame:
    """One substance and one reading of a page belong together."""
    m = E.mention_rows(_reports(spark, d), ["doc", "page"], "text")
    return E.paired_readings(m, ["doc", "page"]).select("doc", "substance", "confidence")


@query("""
with x as (select doc_id, case doc_id % 6 when 0 then 'Chain of custody record' when 1 then 'Invoice no. 12' when 2 then 'From: A' || chr(10) || 'To: B' when 3 then 'Dear Sir' when 4 then 'Laboratory report; sample id: 4' else substr(text, 1, 30) end t from documents)
select doc_id, case doc_id % 6 when 0 then 'chain_of_custody' when 1 then 'invoice' when 2 then 'memo_letter' when 3 then 'memo_letter' when 4 then 'lab_report' else 'other' end as doc_type,
 case doc_id % 6 when 0 then 0.85 when 1 then 0.7 when 2 then 0.75 when 3 then 0.75 when 4 then 0.65 else 0.0 end::double as confidence from x""")
def doc_type_cascade(spark: SparkSession, d: str) -> DataFrame:
    """E9."""
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "Chain of custody record").when(k == 1, "Invoice no. 12").when(k == 2, "From: A\nTo: B").when(k == 3, "Dear Sir").when(k == 4, "Laboratory report; sample id: 4").otherwise(F.substring("text", 1, 30))
    x = table(spark, d, "documents").select("doc_id", E.without_watermark(t).alias("t"))
    kind = E.doc_type(F.col("t"), F.col("t"), F.lit(1))
    return x.select("doc_id", kind.alias("x")).select("doc_id", "x.doc_type", "x.confidence")


@query()
def whole_text_types(spark: SparkSession, d: str) -> DataFrame:
    """E9 on the whole text of every document; form feeds part its pages."""
    t = E.without_watermark(F.coalesce("text", F.lit("")))
    # The texts are columns of a step before, so that the rules do not make them anew.
    x = table(spark, d, "documents", spread=True).select("doc_id", t.alias("t"))
    x = x.select("doc_id", F.split("t", "\f").alias("pages"), F.replace("t", F.lit("\f"), F.lit("\n")).alias("full"))
    x = x.select("doc_id", F.element_at("pages", 1).alias("first"), "full", F.size("pages").alias("n"))
    return x.select("doc_id", E.doc_type(F.col("first"), F.col("full"), F.col("n"), reason=True).alias("x")).select("doc_id", "x.*")


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """§2.8: text of pages."""
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""
with a as (select c_custkey as k, (c_custkey % 7 + 1) || ' ' || case c_custkey % 5 when 0 then 'Chambers St' when 1 then 'CHAMBERS STREET' when 2 then 'Chambres Street' when 3 then 'W. Broadway' else 'Warren Pl.' end as raw from customer)
select distinct raw, (regexp_extract(raw, '^([0-9]+)', 1)) as house, case when raw like '%Cham%' or raw like '%CHAM%' then 'CHAMBERS STREET' when raw like '%Bro%' then 'WEST BROADWAY' else 'WARREN PLACE' end as street from a""".replace("'CHAMBERS STREET' when raw like '%Bro%'", "case when raw like '%Chambres%' then 'CHAMBRES STREET' else 'CHAMBERS STREET' end when raw like '%Bro%'"))
def street_normaliser(spark: SparkSession, d: str) -> DataFrame:
    """§2.8: house numbers and street names."""
    return _addresses(spark, d).select("raw").distinct().select("raw", T.house_number(F.col("raw")).alias("house"), T.street(T.after_house_number(F.col("raw"))).alias("street"))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "Chambers St").when(k == 1, "CHAMBERS STREET").when(k == 2, "Chambres Street").when(k == 3, "W. Broadway").otherwise("Warren Pl.")
    return table(spark, d, "customer").select(F.concat_ws(" ", (F.col("c_custkey") % 7 + 1).cast("string"), name).alias("raw"), F.lit(10).alias("n"))


@query("""
with a as (select (c_custkey % 7 + 1) || ' ' || case c_custkey % 5 when 0 then 'Chambers St' when 1 then 'CHAMBERS STREET' when 2 then 'Chambres Street' when 3 then 'W. Broadway' else 'Warren Pl.' end as raw from customer)
select distinct raw, 'address:' || regexp_extract(raw, '^([0-9]+)', 1) || '-' || case when raw ilike '%cham%' then 'chambers-street' when raw like '%Bro%' then 'west-broadway' else 'warren-place' end as key,
 case when raw like '%Chambres%' then 0.9 else 1.0 end::double as confidence from a""")
def osa_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    """Spellings to the seed of their house number and street type."""
    return R.canonical_addresses(_addresses(spark, d)).select("raw", "key", "confidence")


@query()
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """§2.8: alignment distance of pairs of one block; tests hold it against a table of all prefixes."""
    x = table(spark, d, "part").select("p_type", "p_name").distinct()
    pairs = x.withColumnRenamed("p_name", "a").join(x.withColumnRenamed("p_name", "b"), "p_type").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("d", osa_distance("a", "b"))


@query("""
with c as (select conv_id, list(turn) filter (role = 'assistant') a, list(turn) filter (turn < 3) b from conversations group by all)
select conv_id, coalesce(len(a) > 0 and len(list_filter(a, lambda x: not list_contains(coalesce(b, []), x))) = 0, false) as valid from c""")
def citation_subset(spark: SparkSession, d: str) -> DataFrame:
    """O17."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"), F.collect_list(F.when(F.col("turn") < 3, F.col("turn"))).alias("b"))
    return c.select("conv_id", X.citations_hold(F.col("a"), F.col("b")).alias("valid"))


@query("""select count(*)::bigint documents, count(*) filter (c = 0)::bigint no_text, count(*) filter (c < 50 * p)::bigint thin, sum(b)::bigint blank_pages from
 (select doc_id, sum(len(t)) c, count(*) p, count(*) filter (len(t) = 0) b from (select doc_id, unnest(string_split(text, chr(10))) t from documents) x group by all) y""")
def text_layer(spark: SparkSession, d: str) -> DataFrame:
    """A33."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).withColumn("chars", F.length("t"))
    return A.text_layer(x, "doc_id", "chars")


@query()
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose hash has not been sent."""
    from ..sources.sinks import changed_rows as changed
    docs = table(spark, d, "documents")
    sent = docs.where("lang = 'en'").withColumn("hash", row_hash(docs))
    return changed(docs, sent, "doc_id").select("doc_id", "hash")


@query("""
with t as (select quality, toxic, count(*)::bigint n from documents left join labels on labels.doc_id = documents.doc_id group by all) select * from t""")
def classification_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Labels and their absence."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""
with x as (select c_custkey, '1' || lpad((c_custkey % 400)::varchar, 5, '0') || lpad((c_nationkey)::varchar, 4, '0') as lot, c_nationkey + 500 as bin from customer), f as (select distinct lot, bin from x)
select count(*)::bigint n from f""")
def footprint_expansion(spark: SparkSession, d: str) -> DataFrame:
    """J21, §1.5: lots and buildings expanded both ways, pairs once."""
    lot = R.lot_key(F.col("c_custkey") % 400, F.col("c_nationkey"))
    f = table(spark, d, "customer").select(lot.alias("lot"), (F.col("c_nationkey") + 500).alias("bin")).distinct()
    rows = f.select("lot", F.lit(None).cast("int").alias("bin")).distinct()
    return J.expanded(rows, "lot", "bin", f).agg(F.count("*").alias("n"))


@query("""
select o_orderkey as doc, (['lead', 'mercury', 'asbestos'])[1 + o_custkey % 4] as substance, v as value, 'mg/kg' as unit, 20.0::double as limit_value, case when v <= 20 then 'below' else 'above' end as result
from (select *, floor(o_totalprice / 10000)::double v from orders) x where o_custkey % 4 < 3""")
def table_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings out of tables that a rule makes from orders."""
    from ..operators.readings import reading_rows

    o = table(spark, d, "orders")
    name = F.element_at(F.array(*map(F.lit, ("Lead", "Hg", "Asbestos", "Gold"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    row = F.concat_ws("   ", name, F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit("mg/kg"), F.lit("20"))
    pages = o.select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.concat(F.lit("Analyte   Results   Units   MDL\n"), row).alias("text"))
    return reading_rows(pages, ["doc", "page"], "text").select("doc", "substance", "value", "unit", "limit_value", "result")



@query("""
with v as (select unnest(['the', 'and', 'are', 'that', 'les', 'des', 'une', 'der', 'und', 'los']) w),
t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}')) t from documents), u as (select doc_id, unnest(t) w from t),
g as (select doc_id, count(*) n, count(distinct w) k from u where w in (select w from v) group by all)
select t.doc_id, len(t)::int as tokens, coalesce(n, 0)::bigint good, coalesce(k, 0)::bigint as "unique", coalesce(n, 0) / greatest(len(t), 1)::double as ratio from t left join g on g.doc_id = t.doc_id""")
def lexical_quality(spark: SparkSession, d: str) -> DataFrame:
    """Known words; the vocabulary is a table."""
    from ..operators.screening import lexical_rows

    docs = table(spark, d, "documents", spread=True)
    words = spark.createDataFrame([(w,) for w in ("the", "and", "are", "that", "les", "des", "une", "der", "und", "los")], "word string")
    return lexical_rows(docs, ["doc_id"], "text", words).select("doc_id", "tokens", "good", "unique", "ratio")


@query()
def screened_titles(spark: SparkSession, d: str) -> DataFrame:
    """Flags of titles made of a document's first words."""
    from ..operators import screening as C

    x = table(spark, d, "documents", spread=True).select("doc_id", "source", T.clamp_words(F.col("text"), 6).alias("title"), T.clamp_chars(F.col("text")).alias("summary"), "text")
    flags = C.title_flags(F.col("title"), F.col("summary"), F.col("source"), F.lit(0.8), F.col("text"))
    return x.select("doc_id", F.array_join(flags, ",").alias("flags"), C.names_a_person(F.col("title")).alias("personal"))


@query()
def topic_treemap(spark: SparkSession, d: str) -> DataFrame:
    """Languages as boxes, one picture per label."""
    from ..operators.layout import treemap

    x = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("size"))
    return treemap(x, "lang", "source", "size", 1200.0, 800.0).select("lang", "source", *(F.round(c, 6).alias(c) for c in "xywh"))


@query("""
with f as (select c_custkey, c_custkey % 4 k, 'Block: ' || (c_custkey % 400 + 1) || ' Lot: ' || (c_nationkey + 1) lot, 'BIN: ' || (1000000 + c_custkey) bin from customer)
select c_custkey, case when k in (0, 1) then 'bin' else 'bbl' end as kind,
 case when k in (0, 1) then (1000000 + c_custkey)::varchar else '1' || lpad((c_custkey % 400 + 1)::varchar, 5, '0') || lpad(regexp_extract(lot, 'Lot: ([0-9]+)', 1), 4, '0') end as key
from f where k < 3""")
def folder_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Places from labels (building number before block and lot), else from separator sheets; labels that are names have none."""
    k = F.col("c_custkey") % 4
    lot = F.concat(F.lit("Block: "), (F.col("c_custkey") % 400 + 1).cast("string"), F.lit(" Lot: "), (F.col("c_nationkey") + 1).cast("string"))
    number = F.concat(F.lit("BIN: "), (F.lit(1_000_000) + F.col("c_custkey")).cast("string"))
    label = F.when(k == 0, F.concat_ws(" ", lot, number)).when(k == 1, "misc").when(k == 2, lot).otherwise("Ann Lee")
    folders = table(spark, d, "customer").select("c_custkey", label.alias("label"), F.when(k.isin(1, 3), number).alias("sheet"))
    return R.folder_table(folders, "c_custkey")


@query("""
with x as (select l_orderkey as doc, l_linenumber as page, min(case when l_returnflag = 'R' then l_partkey end) b, max((l_returnflag = 'A')::int) c, max((l_returnflag = 'N')::int) m, max((l_linestatus = 'F')::int) d from lineitem group by all)
select doc, page, 'bin' as kind, b::varchar as key, c = 1 and m = 1 as has_test, round_even((0.4 * (c = 1 and m = 1)::int + 0.15 * d)::double, 2) as confidence from x where b is not null""".replace("round_even((0.4 * (c = 1 and m = 1)::int + 0.15 * d)::double, 2)", "(case when c = 1 and m = 1 then 0.4 else 0.0 end + case when d = 1 then 0.15 else 0.0 end)::double"))
def page_places(spark: SparkSession, d: str) -> DataFrame:
    """Place, test flag and confidence of a page from its mentions; no two of these are near."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("norm"), (F.col("l_partkey") * 1000).alias("start"))
    label = F.element_at(F.create_map(F.lit("R"), F.lit("bin"), F.lit("A"), F.lit("contaminant"), F.lit("N"), F.lit("measurement")), F.col("l_returnflag"))
    one = x.select("doc", "page", F.when(F.col("l_returnflag") == "N", F.col("start") + 500).otherwise(F.col("start")).alias("start"), label.alias("label"), "norm")
    dates = x.where("l_linestatus = 'F'").select("doc", "page", "start", F.lit("date").alias("label"), "norm")
    m = one.union(dates).withColumns({"borough": F.lit(None).cast("string"), "address_role": F.lit(None).cast("string")})
    return R.page_places(m, ["doc", "page"]).select("doc", "page", "kind", "key", "has_test", "confidence")
