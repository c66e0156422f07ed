"""Queries that exercise numerals, joins, windows, trees and sets over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import numerals as N
from quire.functions import text as T
from quire.functions.stats import first_mode
from quire.operators import graph, layout, views
from quire.plans.common import LINES, table, texts
from quire.sources.texts import document_lines, html_blocks, html_links
from quire.streaming.resume import pending

Q, O = {}, {}

#: Words to parse, and what each should give, as rows of one column.
TOKENS = ["IV", "iiii", "VX", "mcmxcix", "12", "007", "twenty-one", "Forty two", "fifty", "one hundred", "xyz", "", "MMXXVI", "seven", "-5", "IX.", "c", "D"]
KEYS = ["1", "12", "123", "1234", "*", "**", "†", "****", "iv", "x", "xlii", "iiii", "viiiiiiii", "a", "q", "IV", "B", "ab", "", "[", "§§"]


def _values(spark: SparkSession, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(items)], "id bigint, token string")


def _rows(items: list[str]) -> str:
    return "v as (select * from (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(items)) + ") as v(id, token))"


_ROMAN = """letters as (select id, token, list_transform(string_split(upper(token), ''), lambda c: case c when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 when 'D' then 500 when 'M' then 1000 end) as v from v where regexp_matches(token, '^(?i)[ivxlcdm]+$')),
    roman as (select id, list_sum(list_transform(v, lambda x, i: case when x < coalesce(v[i + 1], 0) then -x else x end))::bigint as roman from letters)"""
_SPELLED = """words as (select id, list_filter(regexp_split_to_array(lower(token), '[ \t-]+'), lambda w: w <> '') as w from v),
    spelled as (select id, list_transform(w, lambda x: case x """ + " ".join(f"when '{k}' then {v}" for k, v in N.SPELLED.items()) + """ end) as n from words where len(w) > 0)"""

Q["roman_parse"] = lambda spark, sf: _values(spark, TOKENS).select("id", "token", N.roman_value(F.col("token")).cast("bigint").alias("roman"))
O["roman_parse"] = f"with {_rows(TOKENS)}, {_ROMAN} select v.id::bigint as id, token, roman from v left join roman using (id)"

Q["number_parse"] = lambda spark, sf: _values(spark, TOKENS).select("id", "token", N.number_value(F.col("token")).cast("bigint").alias("number"))
O["number_parse"] = f"""with {_rows(TOKENS)}, {_ROMAN}, {_SPELLED} select v.id::bigint as id, token, case when regexp_matches(token, '^[0-9]+$') then token::bigint
    else coalesce(case when len(list_filter(n, lambda x: x is null)) = 0 then list_sum(n) end, roman)::bigint end as number from v left join roman using (id) left join spelled using (id)"""

Q["marker_classes"] = lambda spark, sf: _values(spark, KEYS).select("id", "token", T.marker_class(F.col("token")).alias("class"))
O["marker_classes"] = rf"""with {_rows(KEYS)} select id::bigint as id, token, case when regexp_matches(token, '^[0-9]{{1,3}}$') then 'numeric' when regexp_matches(token, '^(\*{{1,3}}|†{{1,3}}|‡{{1,3}}|§{{1,3}}|¶{{1,3}})$') then 'symbol'
    when length(token) between 1 and 6 and regexp_matches(lower(token), '^[ivxlc]') and regexp_matches(lower(token), '^c{{0,3}}(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})$') then 'roman' when regexp_matches(lower(token), '^[a-z]$') then 'alphabetic' end as class from v"""

Q["text_repair"] = lambda spark, sf: table(spark, sf, "part").select("p_partkey", T.respaced(F.concat("p_name", F.lit(",and more."), F.initcap("p_type"))).alias("fixed"), T.normal_text(F.concat(F.lit("ﬁne "), F.col("p_name"))).alias("normal"))
O["text_repair"] = """select p_partkey, p_name || ', and more. ' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as fixed, 'fine ' || p_name as normal from part"""


def one_edit_pairs(spark, sf):
    """Customer balances' whole parts that differ by one edit, found by the strings with one character left out.

    Every two strings within one edit share such a string, so an equi join on it replaces the comparison of all pairs.
    """
    vals = table(spark, sf, "part").select(F.floor("p_retailprice").cast("string").alias("s")).distinct()
    # The string itself, and each of it with one character out.
    keys = vals.select("s", F.explode(F.array_distinct(F.concat(F.array("s"), F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, F.length("s"))))))).alias("key"))
    pairs = keys.join(keys.select(F.col("s").alias("t"), "key"), "key").where("s < t").select("s", "t").distinct()
    return pairs.where(T.within_one_edit(F.col("s"), F.col("t")))


Q["one_edit_pairs"] = one_edit_pairs
O["one_edit_pairs"] = "with v as (select distinct floor(p_retailprice)::bigint::varchar as s from part) select a.s, b.s as t from v a, v b where a.s < b.s and levenshtein(a.s, b.s) <= 1"


def _pages(spark, sf):
    """Order keys as documents of pages: every line's number printed with an offset of its own order."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), (F.col("l_orderkey") + F.col("l_linenumber") % 3).cast("string").alias("text"))


def page_number_offsets(spark, sf):
    lines = _pages(spark, sf)
    bands = lines.select("doc_id", "page", "text")
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return layout.number_offsets(bands, pages).select("doc_id", F.col("offset").cast("bigint").alias("offset"), "support")


Q["page_number_offsets"] = page_number_offsets
O["page_number_offsets"] = """with l as (select l_orderkey % 50 as doc_id, l_orderkey as page, l_orderkey + l_linenumber % 3 as printed from lineitem where length((l_orderkey + l_linenumber % 3)::varchar) <= 4),
    p as (select l_orderkey % 50 as doc_id, count(distinct l_orderkey) as pages from lineitem group by 1),
    s as (select doc_id, printed - page as "offset", count(distinct page) as support from l group by all),
    d as (select distinct doc_id, printed - page as "offset", page from l),
    g as (select *, page - lag(page) over (partition by doc_id, "offset" order by page) > 2 as fresh from d),
    i as (select *, sum(coalesce(fresh, false)::int) over (partition by doc_id, "offset" order by page) as island from g),
    r as (select doc_id, "offset", max(n) as run from (select doc_id, "offset", island, count(*) as n from i group by all) group by all)
    select s.doc_id, s."offset"::bigint as "offset", support from s join r using (doc_id, "offset") join p using (doc_id) where support >= greatest(4, floor(pages * 0.03 + 0.5)) or (support >= 4 and run >= 4)"""

Q["longest_page_run"] = lambda spark, sf: layout.longest_run(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page")), ["doc_id"])
O["longest_page_run"] = """with d as (select distinct l_suppkey as doc_id, l_orderkey as page from lineitem), g as (select *, page - lag(page) over (partition by doc_id order by page) > 2 as fresh from d),
    i as (select *, sum(coalesce(fresh, false)::int) over (partition by doc_id order by page) as island from g) select doc_id, max(n) as run from (select doc_id, island, count(*) as n from i group by all) group by doc_id"""


#: Lines of a page where documents are taken as books.
BOOK_LINES = 10


def _book_lines(spark, sf):
    lines = document_lines(texts(spark, sf).where("doc_id is not null"))
    return lines.select("doc_id", F.floor(F.col("line_no") / BOOK_LINES).cast("bigint").alias("page"), F.col("line_no").alias("idx"), F.lit(10.0).alias("size"), F.col("line").alias("text"))


def band_recurrence(spark, sf):
    """Documents as books: running heads, lines of a page's edges whose wording recurs in the same band close by."""
    lines = _book_lines(spark, sf)
    em = lines.select("doc_id").distinct().withColumn("em", F.lit(10.0))
    return layout.running_heads(lines, lines.limit(0), em)


Q["band_recurrence"] = band_recurrence
O["band_recurrence"] = rf"""with {LINES}, p as (select doc_id, line_no // {BOOK_LINES} as page, line_no as idx, line as text from lines),
    r as (select *, row_number() over (partition by doc_id, page order by idx) as k, count(*) over (partition by doc_id, page) as n from p),
    t as (select doc_id, page, idx, text, n, case when k <= 2 then 'top' else 'bottom' end as band,
      trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}} ]', '', 'g'), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) as key from r where k <= 2 or k > n - 2)
    select doc_id, page, idx, text, min(other)::bigint as other_page from (select a.doc_id, a.page, a.idx, a.text, b.page as other from t a join t b on a.doc_id = b.doc_id and a.band = b.band and a.key = b.key and b.page - a.page in (-2, -1, 1, 2)
    where a.n >= 8 and length(trim(a.text)) between 3 and 70 and len(regexp_split_to_array(trim(a.text), '\s+')) <= 10 and length(a.key) >= 3) group by all"""


#: Lines of a page where documents are taken as pages.
PAGE_LINES = 4


def band_line_recurrence(spark, sf):
    """Documents as pages: the first and the last line of each, whole, that stand in the same band one or two pages away."""
    # Dealt by document once; pages, bands and neighbours are found where the document is.
    docs = texts(spark, sf).where("doc_id is not null").repartition("doc_id")
    lines = document_lines(docs).withColumn("page", F.floor(F.col("line_no") / PAGE_LINES).cast("bigint"))
    edges = lines.groupBy("doc_id", "page").agg(F.min_by("line", "line_no").alias("top"), F.max_by("line", "line_no").alias("bottom"))
    bands = F.array(*[F.struct(F.lit(band).alias("band"), T.head_key(F.col(band)).alias("key")) for band in ("top", "bottom")])
    w = Window.partitionBy("doc_id", "band", "key").orderBy("page")
    away = F.array(*[F.lag("page", k).over(w) - F.col("page") for k in (2, 1, -1)])
    step = F.array_min(F.filter(away, lambda d: d.between(-2, 2)))
    return edges.select("doc_id", "page", F.inline(bands)).where("key <> ''").withColumn("step", step).where("step is not null")


Q["band_line_recurrence"] = band_line_recurrence
O["band_line_recurrence"] = rf"""with {LINES}, g as (select doc_id, line_no // {PAGE_LINES} as page, arg_min(line, line_no) as top, arg_max(line, line_no) as bottom from lines group by all),
    b as (select doc_id, page, 'top' as band, top as line from g union all select doc_id, page, 'bottom', bottom from g),
    t as (select doc_id, page, band, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '[^\p{{L}}\p{{N}} ]', '', 'g'), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) as key from b)
    select a.doc_id, a.page, a.band, a.key, min(b.page - a.page)::bigint as step from t a join t b on a.doc_id = b.doc_id and a.band = b.band and a.key = b.key and b.page - a.page in (-2, -1, 1, 2) where a.key <> '' group by all"""


def asof_section(spark, sf):
    """The last error event of a user at or before each purchase."""
    ev = table(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = ev.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return graph.as_of(left, right.withColumn("tie", F.col("last_view")), ["user_id"], "ts", "last_view", "tie").select("event_id", "user_id", "last_view")




Q["asof_section"] = asof_section
O["asof_section"] = """with l as (select user_id, ts, event_id from events where event_type = 'purchase'), r as (select user_id, ts, event_id as last_view from events where event_type = 'view')
    select l.event_id, l.user_id, (select max(struct_pack(ts := r.ts, v := r.last_view)) from r where r.user_id = l.user_id and r.ts <= l.ts).v as last_view from l"""


def nearest_line(spark, sf):
    orders = table(spark, sf, "orders")
    left = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("at"))
    right = orders.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("near"))
    return graph.nearest(left, right, ["o_custkey"], "at", "near").select("o_custkey", "at", "near", "distance")


Q["nearest_line"] = nearest_line
O["nearest_line"] = """with l as (select o_custkey, o_orderkey as p from orders where o_orderstatus = 'F'), r as (select o_custkey, o_orderkey as q from orders where o_orderstatus = 'O'),
    c as (select l.o_custkey, p, q from l left join r using (o_custkey) qualify row_number() over (partition by l.o_custkey, p order by abs(q - p), q) = 1)
    select o_custkey, p as "at", q as near, abs(q - p) as distance from c"""



def pending_pages(spark, sf):
    """Users as documents of twenty pages: pages viewed or clicked want recognition, purchases are pages done, some in error."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 20).alias("page"), "event_id", "event_type")
    scan = ev.select("doc_id", "page", F.when(F.col("event_type").isin("view", "click"), "ocr").otherwise("native").alias("method")).distinct()
    done = ev.where("event_type = 'purchase'").select("doc_id", "page", F.when(F.col("event_id") % 3 == 0, "unreadable").alias("error"))
    return pending(scan, done, retry=True)


Q["pending_pages"] = pending_pages
O["pending_pages"] = """with e as (select user_id as doc_id, event_id % 20 as page, event_id, event_type from events)
    select distinct doc_id, page from e where event_type in ('view', 'click') and not exists (select 1 from e d where d.doc_id = e.doc_id and d.page = e.page and d.event_type = 'purchase' and d.event_id % 3 <> 0)"""


def caller_semi(spark, sf):
    """Turns whose role spoke on this turn or the one before it, earlier in the conversation."""
    c = table(spark, sf, "conversations")
    callers = c.select("conv_id", "role", F.col("turn").alias("from_turn")).withColumn("turn", F.explode(F.array(F.col("from_turn") + 1, F.col("from_turn") + 2)))
    return c.join(callers.select("conv_id", "role", "turn").distinct(), ["conv_id", "role", "turn"], "left_semi").select("conv_id", "turn", "role")


Q["caller_semi"] = caller_semi
O["caller_semi"] = "select conv_id, turn, role from conversations a where exists (select 1 from conversations b where b.conv_id = a.conv_id and b.role = a.role and a.turn - b.turn in (1, 2))"

_EVENT_SIGNALS = {"view": "superscript", "click": "bracketed", "purchase": "system-key", "signup": "cue", "error": "math-context", "login": "sequence", "logout": "isolated-typography"}


def _signals(spark, sf):
    kind = F.try_element_at(N.mapped(_EVENT_SIGNALS), F.col("event_type"))
    return table(spark, sf, "events").select("user_id", kind.alias("signal"), "value").where("signal is not null").groupBy("user_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.count("*").alias("n"))


def noisy_or_score(spark, sf):
    return _signals(spark, sf).select("user_id", N.recognition_score(F.col("signals")).alias("score"))


_W = " ".join(f"when '{k}' then {N.SIGNALS[v]}" for k, v in _EVENT_SIGNALS.items())
_SCORES = f"""d as (select user_id, event_type, count(*) as n from events where event_type in ({', '.join(repr(k) for k in _EVENT_SIGNALS)}) group by all),
    w as (select user_id, n, (case event_type {_W} end)::double as w from d),
    scores as (select user_id, sum(n)::bigint as n, floor((1 - product(case when w >= 0 then 1 - w else 1 end)) * (1 - max(case when w < 0 then -w else 0 end)) * 1000 + 0.5) / 1000 as score from w group by user_id)"""
Q["noisy_or_score"] = noisy_or_score
O["noisy_or_score"] = f"with {_SCORES} select user_id, score::double as score from scores"


def recognition_decision(spark, sf):
    s = _signals(spark, sf).withColumn("score", N.recognition_score(F.col("signals")))
    dest = F.when(F.col("user_id") % 3 == 0, 0.9).otherwise(0.0)
    return s.select("user_id", N.decision(F.col("score"), dest, F.col("user_id") % 5 == 0, F.col("n")).alias("decision"))


Q["recognition_decision"] = recognition_decision
O["recognition_decision"] = f"""with {_SCORES} select user_id, case when user_id % 3 = 0 then case when score >= 0.4 then 'accepted' else 'rejected' end
    when (user_id % 5 = 0 and n >= 2 and score >= 0.4) or score >= 0.6 then 'accepted-unresolved' else 'rejected' end as decision from scores"""


def rank_top1_ties(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc())
    ranked = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.rank().over(w).alias("r")).where("r = 1")
    top = ranked.groupBy("l_orderkey").agg(F.count("*").alias("rivals"), F.min("l_linenumber").cast("bigint").alias("best"), F.first("l_quantity").alias("score"))
    return top.select("l_orderkey", "best", "score", "rivals", (F.col("rivals") > 1).alias("ambiguous"))


Q["rank_top1_ties"] = rank_top1_ties
O["rank_top1_ties"] = """with r as (select *, rank() over (partition by l_orderkey order by l_quantity desc) as r from lineitem)
    select l_orderkey, min(l_linenumber)::bigint as best, any_value(l_quantity) as score, count(*) as rivals, count(*) > 1 as ambiguous from r where r = 1 group by l_orderkey"""


def _tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("section_id"), F.lit("root").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    root = spark.createDataFrame([("root", None)], "section_id string, parent string")
    return root.union(r).union(n).union(c).withColumn("doc_id", F.lit(1).cast("bigint"))


Q["section_ancestors"] = lambda spark, sf: graph.ancestors(_tree(spark, sf)).select("section_id", "ancestor", F.col("distance").cast("bigint").alias("distance"))
O["section_ancestors"] = """with recursive t as (select 'root' as section_id, null as parent union all select 'r' || r_regionkey, 'root' from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
    up as (select section_id, section_id as ancestor, parent as next, 0 as distance from t union all select up.section_id, t.section_id, t.parent, distance + 1 from up join t on t.section_id = up.next)
    select section_id, ancestor, distance::bigint as distance from up"""


def _links(li, doc="l_orderkey % 7"):
    return li.select(F.expr(doc).alias("doc_id"), F.concat(F.lit("b"), "l_orderkey").alias("from"), F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("b"), (F.col("l_orderkey") + F.col("l_linenumber") * 7).cast("string"))).alias("to"), F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber").alias("ref_id"), F.col("l_returnflag").alias("type"))


def _edges(spark, sf):
    """Documents of a thousand orders, as many as the table holds."""
    return _links(table(spark, sf, "lineitem"), "l_orderkey div 1000")


def _all_edges(spark, sf):
    """Seven documents, whatever the size of the table."""
    return _links(table(spark, sf, "lineitem"))


def _adjacency(edges):
    return graph.adjacency(edges).select("doc_id", "block_id", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"))


def _counts_by_type(edges):
    types = edges.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("type", F.lit(1))))).alias("m")).select("doc_id", F.array_join(F.map_keys("m"), ",").alias("types"))
    return types.join(edges.groupBy("doc_id").agg(F.count("*").alias("refs"), F.count("to").alias("resolved")), "doc_id")


_EDGES = """e as (select l_orderkey // 1000 as doc_id, 'b' || l_orderkey as src, case when l_linenumber % 4 <> 0 then 'b' || (l_orderkey + l_linenumber * 7) end as dst, 'r-' || l_orderkey || '-' || l_linenumber as ref_id, l_returnflag as type from lineitem)"""
Q["adjacency"] = lambda spark, sf: _adjacency(_edges(spark, sf))
O["adjacency"] = f"""with {_EDGES}, o as (select doc_id, src as block_id, string_agg(ref_id, ',' order by ref_id) as outgoing from e group by all), i as (select doc_id, dst as block_id, string_agg(ref_id, ',' order by ref_id) as incoming from e where dst is not null group by all)
    select coalesce(o.doc_id, i.doc_id) as doc_id, coalesce(o.block_id, i.block_id) as block_id, coalesce(outgoing, '') as outgoing, coalesce(incoming, '') as incoming from o full join i on o.doc_id = i.doc_id and o.block_id = i.block_id"""

Q["counts_by_type"] = lambda spark, sf: _counts_by_type(_edges(spark, sf))
O["counts_by_type"] = f"with {_EDGES} select doc_id, string_agg(distinct type, ',' order by type) as types, count(*) as refs, count(dst) as resolved from e group by doc_id"

_ALL_EDGES = """e as (select l_orderkey % 7 as doc_id, 'b' || l_orderkey as src, case when l_linenumber % 4 <> 0 then 'b' || (l_orderkey + l_linenumber * 7) end as dst, 'r-' || l_orderkey || '-' || l_linenumber as ref_id, l_returnflag as type from lineitem)"""
Q["adjacency_all"] = lambda spark, sf: _adjacency(_all_edges(spark, sf))
O["adjacency_all"] = f"""with {_ALL_EDGES}, o as (select doc_id, src as block_id, string_agg(ref_id, ',' order by ref_id) as outgoing from e group by all), i as (select doc_id, dst as block_id, string_agg(ref_id, ',' order by ref_id) as incoming from e where dst is not null group by all)
    select coalesce(o.doc_id, i.doc_id) as doc_id, coalesce(o.block_id, i.block_id) as block_id, coalesce(outgoing, '') as outgoing, coalesce(incoming, '') as incoming from o full join i on o.doc_id = i.doc_id and o.block_id = i.block_id"""

Q["counts_by_type_all"] = lambda spark, sf: _counts_by_type(_all_edges(spark, sf))
O["counts_by_type_all"] = f"with {_ALL_EDGES} select doc_id, string_agg(distinct type, ',' order by type) as types, count(*) as refs, count(dst) as resolved from e group by doc_id"


def ref_groups(spark, sf):
    o = table(spark, sf, "orders")
    label = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.concat(F.lit("structural · "), "o_orderstatus"))
    groups = o.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "label")).cast("bigint"))


Q["ref_groups"] = ref_groups
O["ref_groups"] = """with g as (select coalesce(case when o_orderstatus <> 'P' then o_orderpriority end, 'structural · ' || o_orderstatus) as label, count(*) as n from orders group by 1) select *, row_number() over (order by n desc, label) as place from g"""


def list_runs(spark, sf):
    """Runs of at least two items in a row in pages' blocks, with each item's edge."""
    blocks = html_blocks(table(spark, sf, "pages"))
    w = Window.partitionBy("page_id").orderBy("ord")
    item = F.col("type") == "list-item"
    marked = blocks.withColumn("item", item).withColumn("island", F.sum((~item).cast("int")).over(w)).where("item")
    g = Window.partitionBy("page_id", "island")
    runs = marked.withColumn("n", F.count("*").over(g)).withColumn("k", F.row_number().over(g.orderBy("ord"))).where("n >= 2")
    return runs.select("page_id", "ord", F.col("n").alias("run"), F.when(F.col("k") == 1, "start").when(F.col("k") == F.col("n"), "end").alias("edge"))


_BLOCKS = r"""body as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') as b from pages),
    cut as (select page_id, regexp_extract_all(b, '(?is)<(?:h[1-3]|p|li|title)(?:\s[^>]*)?>.*?</(?:h[1-3]|p|li|title)>') as raws from body),
    r as (select page_id, unnest(range(len(raws)))::bigint as ord, unnest(raws) as raw from cut),
    blocks as (select page_id, ord, case lower(regexp_extract(raw, '^<([A-Za-z0-9]+)', 1)) when 'h1' then 'heading' when 'h2' then 'heading' when 'h3' then 'heading' when 'p' then 'paragraph' when 'li' then 'list-item' when 'title' then 'title' end as type,
      trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text from r)"""
Q["list_runs"] = list_runs
O["list_runs"] = f"""with {_BLOCKS}, m as (select *, sum((type <> 'list-item')::int) over (partition by page_id order by ord) as island from blocks),
    g as (select *, count(*) over (partition by page_id, island) as run, row_number() over (partition by page_id, island order by ord) as k from m where type = 'list-item')
    select page_id, ord, run, case when k = 1 then 'start' when k = run then 'end' end as edge from g where run >= 2"""

Q["html_blocks"] = lambda spark, sf: html_blocks(table(spark, sf, "pages"))
O["html_blocks"] = f"with {_BLOCKS} select page_id, ord, type, text from blocks"
Q["html_links"] = lambda spark, sf: html_links(table(spark, sf, "pages"))
O["html_links"] = """with l as (select page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) as us from pages), u as (select page_id, unnest(range(len(us)))::bigint as n, unnest(us) as url from l) select *, regexp_matches(url, '^(?i)https?://') as external from u"""


def block_continuation(spark, sf):
    """Conversations as blocks: users' turns are entries that the following turns continue."""
    c = table(spark, sf, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("block_id"), F.col("turn").alias("ord"), F.lit("s0").alias("section"), F.when(F.col("role") == "user", "entry").otherwise("paragraph").alias("type"), F.when(F.col("role") == "user", "k").alias("key"), "text")
    return graph.continuation(blocks).select(F.col("doc_id").alias("conv_id"), F.col("block_id").cast("bigint").alias("turn"), "dest_text")


Q["block_continuation"] = block_continuation
O["block_continuation"] = """with b as (select *, turn - coalesce(lag(turn) over w, -9) > 1 or role = 'user' as fresh from conversations window w as (partition by conv_id order by turn)),
    r as (select *, sum(fresh::int) over (partition by conv_id order by turn) as run from b)
    select conv_id, turn, string_agg(text, chr(10) || chr(10)) over (partition by conv_id, run order by turn rows between current row and unbounded following) as dest_text from r"""


def line_gaps(spark, sf):
    """Gaps between an order's ship dates in days, and the leading: the most frequent gap, of equals the first."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").withColumn("gap", F.datediff("l_shipdate", F.lag("l_shipdate").over(w))).withColumn("pos", F.row_number().over(w)).where("gap > 0 and gap < 60")
    return first_mode(rows, ["l_suppkey"], "gap", "pos", 1.0, "leading").select("l_suppkey", F.col("leading").cast("bigint").alias("leading"))


Q["line_gaps"] = line_gaps
O["line_gaps"] = """with g as (select l_suppkey, date_diff('day', lag(l_shipdate) over w, l_shipdate) as gap, row_number() over w as pos from lineitem window w as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber)),
    m as (select l_suppkey, gap, count(*) as n, min(pos) as first from g where gap > 0 and gap < 60 group by all) select l_suppkey, gap::bigint as leading from m qualify row_number() over (partition by l_suppkey order by n desc, first) = 1"""


def key_resets(spark, sf):
    """How often line numbers restart in a supplier's lines, and breaks in their sequence (a step of 0, less, or over 12)."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    step = F.col("l_linenumber") - F.lag("l_linenumber").over(w)
    rows = table(spark, sf, "lineitem").select("l_suppkey", step.alias("step"))
    return rows.groupBy("l_suppkey").agg(F.count_if(F.col("step") <= 0).alias("resets"), F.count_if((F.col("step") <= 0) | (F.col("step") > 12)).alias("breaks"))


Q["key_resets"] = key_resets
O["key_resets"] = "with s as (select l_suppkey, l_linenumber - lag(l_linenumber) over (partition by l_suppkey order by l_orderkey, l_linenumber) as step from lineitem) select l_suppkey, count(*) filter (step <= 0) as resets, count(*) filter (step <= 0 or step > 12) as breaks from s group by l_suppkey"


def verse_counter(spark, sf):
    """A running number that an explicit one sets anew: every seventh event states its own."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf, "events").withColumn("stated", F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 100)).withColumn("pos", F.row_number().over(w))
    ev = ev.withColumn("base", F.last("stated", ignorenulls=True).over(w)).withColumn("since", F.last(F.when(F.col("stated").isNotNull(), F.col("pos")), ignorenulls=True).over(w))
    return ev.select("event_id", F.coalesce(F.col("base") + F.col("pos") - F.col("since"), F.col("pos")).cast("bigint").alias("line"))


Q["verse_counter"] = verse_counter
O["verse_counter"] = """with e as (select event_id, user_id, case when event_id % 7 = 0 then event_id % 100 end as stated, row_number() over (partition by user_id order by ts, event_id) as pos from events),
    b as (select *, last_value(stated ignore nulls) over w as base, last_value(case when stated is not null then pos end ignore nulls) over w as since from e window w as (partition by user_id order by pos))
    select event_id, coalesce(base + pos - since, pos)::bigint as line from b"""



def page_map_outer(spark, sf):
    """Orders as pages: part numbers as lone numerals taken off them, and a sequence for every third order."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "running-head").otherwise("printed-page-number")
    removed = li.select((F.col("l_orderkey") % 9).alias("doc_id"), F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey")).alias("idx"), F.concat(F.lit("- "), "l_partkey", F.lit(" -")).alias("text"), kind.alias("classification"))
    sequences = o.where("o_custkey % 3 = 0").select((F.col("o_orderkey") % 9).alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_custkey").cast("long").alias("idx"), F.col("o_custkey").cast("int").alias("printed"), F.lit(False).alias("roman"))
    mapped = layout.page_map(removed, sequences)
    return mapped.select("doc_id", "page", F.col("printed").cast("bigint").alias("printed"), "roman")


Q["page_map_outer"] = page_map_outer
O["page_map_outer"] = """with a as (select l_orderkey as page, arg_min(l_partkey, struct_pack(n := l_linenumber, p := l_partkey)) as lone from lineitem where l_linenumber % 2 = 1 and l_partkey between 1 and 5000 group by 1), b as (select o_orderkey as page, min(o_custkey) as seq from orders where o_custkey % 3 = 0 group by 1)
    select page % 9 as doc_id, page, coalesce(seq, lone)::bigint as printed, false as roman from a full join b using (page)"""


def summary_merge(spark, sf):
    """Events as progress updates of their users' documents: the last status, progress and summary entry of each."""
    ev = table(spark, sf, "events")
    up = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value")).cast("int")).alias("progress"), F.lit(None).cast("string").alias("error"), F.create_map(F.col("event_type"), F.col("event_id").cast("string")).alias("summary"), F.struct("ts", "event_id").alias("updated_at"))
    empty = up.limit(0)
    m = graph.merge_updates(empty, up)
    return m.select("id", "status", F.col("progress").cast("bigint").alias("progress"), F.array_join(F.transform(F.map_entries("summary"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("summary"))


Q["summary_merge"] = summary_merge
O["summary_merge"] = """with u as (select user_id as id, event_type, event_id, ts, case when event_id % 3 <> 0 then greatest(0, least(99, floor(value)::int)) end as progress from events),
    s as (select id, event_type as k, arg_max(event_id, struct_pack(ts := ts, e := event_id)) as v from u group by all)
    select id, (select arg_max(event_type, struct_pack(ts := ts, e := event_id)) from u x where x.id = u.id) as status, (select arg_max(progress, struct_pack(ts := ts, e := event_id)) from u y where y.id = u.id and progress is not null)::bigint as progress,
      (select string_agg(k || '=' || v, ',' order by k) from s where s.id = u.id) as summary from u group by id"""



def newest_documents(spark, sf):
    """Orders as documents; the hundred newest."""
    o = table(spark, sf, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("progress"), F.lit(1).alias("page_count"), F.col("o_orderdate").alias("created_at"))
    return views.newest_first(docs).limit(100).select(F.col("doc_id").alias("o_orderkey"), F.col("title").alias("o_orderpriority"))


Q["newest_documents"] = newest_documents
O["newest_documents"] = "select o_orderkey, o_orderpriority from orders order by o_orderdate desc, o_orderkey limit 100"

Q["shared_keys"] = lambda spark, sf: graph.shared_keys(table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("string").alias("key"), (F.col("l_suppkey") % 20).alias("system")))
O["shared_keys"] = "with k as (select distinct l_shipdate as key, l_suppkey % 20 as system from lineitem) select a.system, count(distinct b.system) as shares_with from k a join k b on a.key = b.key and a.system <> b.system group by 1"

Q["first_on_page"] = lambda spark, sf: graph.first_on_page(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("l_partkey", "first_part")
O["first_on_page"] = "select l_orderkey, arg_min(l_partkey, struct_pack(n := l_linenumber, p := l_partkey)) as first_part from lineitem group by 1"
