"""One query per graph operator over the shop graph, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.operators import graph as g, ordered
from tessella.plans.registry import query, table
from tessella.plans.shop import iri, shop_graph
from tessella.sources.clustered import SubjectStore, write_clustered

OF_ORDER = "'order/' || o_orderkey"
OF_CUST = "'customer/' || c_custkey"


def urgent(t: g.Triples) -> DataFrame:
    """Customers with an urgent order."""
    return g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", None, obj="1-URGENT"), ["ord"]).select("cust")


def pending(t: g.Triples) -> DataFrame:
    """Customers with a pending order."""
    return g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "status", "ord", None, obj="P"), ["ord"]).select("cust")


URGENT = "select o_custkey from orders where o_orderpriority = '1-URGENT'"
PENDING = "select o_custkey from orders where o_orderstatus = 'P'"


# ----------------------------------------------------------- scans and filters


@query("Q01_triple_pattern", f"select {OF_ORDER} as ord, 'customer/' || o_custkey as cust from orders")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    return g.pattern(shop_graph(spark, sf), "placedBy", "ord", "cust")


@query("Q02_class_pattern", "select 'supplier/' || s_suppkey as x, 'nation/' || s_nationkey as nation from supplier")
def q2(spark, sf):
    t = shop_graph(spark, sf)
    return g.of_class(g.pattern(t, "inNation", "x", "nation"), t, "x", "Supplier")


STAR_SQL = f"select {OF_ORDER} as ord, 'customer/' || o_custkey as cust, o_orderstatus as status, o_orderpriority as priority from orders"


@query("Q03_star", STAR_SQL)
def q3(spark, sf):
    t = shop_graph(spark, sf)
    return g.star(g.instances(t, "Order", "ord"), t, "ord", {"placedBy": "cust", "status": "status", "priority": "priority"})


@query("Q03_star_one_pass", STAR_SQL)
def q3_wide(spark, sf):
    return g.wide(shop_graph(spark, sf), "ord", {"placedBy": "cust", "status": "status", "priority": "priority"})


@query(
    "Q04_path",
    f"""select {OF_ORDER} as ord, 'customer/' || c_custkey as cust, 'nation/' || n_nationkey as nation,
        'region/' || r_regionkey as region, r_name as regionLabel
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
)
def q4(spark, sf):
    t = shop_graph(spark, sf)
    hops = [("placedBy", "cust"), ("inNation", "nation"), ("inRegion", "region"), (g.LABEL, "regionLabel")]
    return g.path(g.instances(t, "Order", "ord"), t, "ord", hops)


@query("Q05_constant_object", f"select {OF_CUST} as cust from customer where c_mktsegment = 'BUILDING'")
def q5(spark, sf):
    return g.pattern(shop_graph(spark, sf), "segment", "cust", None, obj="BUILDING")


@query(
    "Q06_constant_subject",
    f"""select {OF_CUST} as cust, 'nation/' || c_nationkey as nation from customer join nation on c_nationkey = n_nationkey
        where n_regionkey = (select n_regionkey from nation where n_nationkey = 3)""",
)
def q6(spark, sf):
    t = shop_graph(spark, sf)
    region = g.pattern(t, "inRegion", None, "region", subject="nation/3")
    nations = g.pattern(t, "inRegion", "nation", "region").join(region, ["region"], "left_semi")
    return g.of_class(g.pattern(t, "inNation", "cust", "nation"), t, "cust", "Customer").join(nations, ["nation"], "left_semi").select("cust", "nation")


@query(
    "Q07_all_values",
    "select 'order/' || l_orderkey as ord from lineitem where l_returnflag in ('A', 'R') group by l_orderkey having count(distinct l_returnflag) = 2",
)
def q7(spark, sf):
    return g.with_all_values(shop_graph(spark, sf), "returnFlag", ["A", "R"], "ord")


@query(
    "Q08_class_counts",
    """select * from (select 'Region' as type, count(*) as count from region union all select 'Nation', count(*) from nation
       union all select 'Customer', count(*) from customer union all select 'Supplier', count(*) from supplier
       union all select 'Part', count(*) from part union all select 'Order', count(*) from orders
       union all select 'Document', count(*) from documents)""",
)
def q8(spark, sf):
    return g.class_counts(shop_graph(spark, sf))


@query("Q45_equality", f"select {OF_ORDER} as ord, o_orderstatus as status from orders where o_orderstatus = 'F' or o_orderstatus = 'P'")
def q45(spark, sf):
    return g.pattern(shop_graph(spark, sf), "status", "ord", "status", obj=["F", "P"])


@query("Q46_inequality", "select 'document/' || doc_id as doc, quality::varchar as quality from documents left join labels using (doc_id) where quality <> 1")
def q46(spark, sf):
    t = shop_graph(spark, sf)
    return g.optional(g.instances(t, "Document", "doc"), g.pattern(t, "quality", "doc", "quality"), "doc").filter(F.col("quality") != "1")


@query("Q47_case_normalised", f"select {OF_CUST} as cust, c_mktsegment as segment from customer where lower(c_mktsegment) = 'machinery'")
def q47(spark, sf):
    return g.pattern(shop_graph(spark, sf), "segment", "cust", "segment").filter(g.same_text(F.col("segment"), "Machinery"))


@query("Q48_numeric_range", f"select {OF_ORDER} as ord, year(o_orderdate)::int as y from orders where year(o_orderdate) between 1996 and 1998")
def q48(spark, sf):
    rows = g.pattern(shop_graph(spark, sf), "year", "ord", "year").select("ord", g.as_int(F.col("year")).alias("y"))
    return rows.filter(F.col("y").between(1996, 1998))


@query(
    "Q49_number_and_date",
    f"""select {OF_ORDER} as ord, o_totalprice::decimal(18,2)::varchar as total, o_orderdate::date::varchar as day from orders
        where o_totalprice::decimal(18,2) > 250000 and o_orderdate::date between date '1997-01-01' and date '1997-12-31'""",
)
def q49(spark, sf):
    t = shop_graph(spark, sf)
    dear = g.pattern(t, "total", "ord", "total").filter(g.as_decimal(F.col("total")) > 250000)
    span = g.as_date(F.col("day")).between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return dear.join(g.pattern(t, "date", "ord", "day").filter(span), ["ord"])


@query("Q50_regex_and_language", "select 'document/' || doc_id as doc, length(text) as chars from documents where lang = 'en' and regexp_matches(text, '^(A|T)')")
def q50(spark, sf):
    rows = g.pattern(shop_graph(spark, sf), "text", "doc", "text", lang="en").filter(F.col("text").rlike("^(A|T)"))
    return rows.select("doc", F.length("text").cast("bigint").alias("chars"))


@query(
    "Q51_bound_or_not",
    "select 'document/' || doc_id as doc, quality::varchar as quality, toxic::varchar as toxic from documents left join labels using (doc_id) where quality is null or toxic = 1",
)
def q51(spark, sf):
    t = shop_graph(spark, sf)
    docs = g.optional(g.instances(t, "Document", "doc"), g.pattern(t, "quality", "doc", "quality"), "doc")
    docs = g.optional(docs, g.pattern(t, "toxic", "doc", "toxic"), "doc")
    return docs.filter(F.col("quality").isNull() | (F.col("toxic") == "1"))


@query(
    "Q52_casts",
    """select o_orderstatus as status, count(try_cast(o_orderpriority as int)) as as_int, sum(o_totalprice::decimal(18,4))::decimal(28,4)::varchar as as_decimal
       from orders group by o_orderstatus""",
)
def q52(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.wide(t, "ord", {"status": "status", "priority": "priority", "total": "total"})
    return rows.groupBy("status").agg(
        F.count(g.as_int(F.col("priority"))).alias("as_int"),
        F.sum(g.as_decimal(F.col("total"))).cast("decimal(28,4)").cast("string").alias("as_decimal"),
    )


@query("Q53_concat_value", "select 'part/' || p_partkey as part, p_size || ' units' as shown from part")
def q53(spark, sf):
    rows = g.pattern(shop_graph(spark, sf), "size", "part", "size")
    return rows.select("part", F.concat(g.as_int(F.col("size")).cast("string"), F.lit(" units")).alias("shown"))


# ------------------------------------------------------------------------ joins


@query("Q09_optional", "select 'document/' || doc_id as doc, quality::varchar as quality from documents left join labels using (doc_id)")
def q9(spark, sf):
    t = shop_graph(spark, sf)
    return g.optional(g.instances(t, "Document", "doc"), g.pattern(t, "quality", "doc", "quality"), "doc")


@query("Q09_optional_label", f"select {OF_CUST} as cust, 'nation/' || c_nationkey as nation, n_name as nationLabel from customer left join nation on c_nationkey = n_nationkey")
def q9_label(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.of_class(g.pattern(t, "inNation", "cust", "nation"), t, "cust", "Customer")
    return g.label_of(rows, t, "nation").select("cust", "nation", "nationLabel")


@query(
    "Q10_optional_group",
    """select 'document/' || d.doc_id as doc, quality::varchar as quality, toxic::varchar as toxic
       from documents d left join labels l on d.doc_id = l.doc_id and quality = 1 and toxic = 0""",
)
def q10(spark, sf):
    t = shop_graph(spark, sf)
    clean = g.pattern(t, "quality", "doc", "quality", obj="1").join(g.pattern(t, "toxic", "doc", "toxic", obj="0"), ["doc"])
    return g.optional(g.instances(t, "Document", "doc"), clean, "doc")


@query(
    "Q11_optional_aggregates",
    """select 'order/' || o_orderkey as ord, parts, suppliers from orders
       left join (select l_orderkey, count(distinct l_partkey) as parts from lineitem group by 1) a on o_orderkey = a.l_orderkey
       left join (select l_orderkey, count(distinct l_suppkey) as suppliers from lineitem group by 1) b on o_orderkey = b.l_orderkey""",
)
def q11(spark, sf):
    t = shop_graph(spark, sf)
    orders = g.optional(g.instances(t, "Order", "ord"), g.count_per(g.pattern(t, "hasPart", "ord", "x"), "ord", "x", "parts"), "ord")
    return g.optional(orders, g.count_per(g.pattern(t, "shippedBy", "ord", "x"), "ord", "x", "suppliers"), "ord")


@query("Q12_optional_flag", f"select {OF_CUST} as cust, case when c_custkey in ({URGENT}) then 1 end as has_urgent from customer")
def q12(spark, sf):
    t = shop_graph(spark, sf)
    flagged = urgent(t).distinct().withColumn("has_urgent", F.lit(1))
    return g.optional(g.instances(t, "Customer", "cust"), flagged, "cust")


@query(
    "Q13_shared_value",
    """select distinct x from (select 'customer/' || c_custkey as x, c_nationkey as n from customer union all
       select 'supplier/' || s_suppkey, s_nationkey from supplier)
       where n = (select c_nationkey from customer where c_custkey = 1) and x <> 'customer/1'""",
)
def q13(spark, sf):
    return g.sharing_with(shop_graph(spark, sf), "inNation", "customer/1", "x")


@query("Q16_not_exists", f"select {OF_CUST} as cust from customer where c_custkey not in ({URGENT})")
def q16(spark, sf):
    t = shop_graph(spark, sf)
    return g.without(g.instances(t, "Customer", "cust"), urgent(t), "cust")


@query("Q17_two_not_exists", f"select {OF_CUST} as cust from customer where c_custkey not in ({URGENT}) and c_custkey not in ({PENDING})")
def q17(spark, sf):
    t = shop_graph(spark, sf)
    return g.without(g.without(g.instances(t, "Customer", "cust"), urgent(t), "cust"), pending(t), "cust")


@query("Q18_either_not_exists", f"select {OF_CUST} as cust from customer where c_custkey not in ({URGENT}) or c_custkey not in ({PENDING})")
def q18(spark, sf):
    t = shop_graph(spark, sf)
    return g.lacking_any(g.instances(t, "Customer", "cust"), [urgent(t), pending(t)], "cust")


@query("Q19_exists_value", f"select {OF_CUST} as cust, c_custkey in ({URGENT}) as has_urgent from customer")
def q19(spark, sf):
    t = shop_graph(spark, sf)
    return g.exists_flag(g.instances(t, "Customer", "cust"), urgent(t), "cust", "has_urgent")


@query(
    "Q37_join_of_aggregates",
    """select * from (select year(o_orderdate)::varchar as year, count(distinct o_orderkey) as urgent from orders where o_orderpriority = '1-URGENT' group by 1)
       join (select year(o_orderdate)::varchar as year, count(distinct o_orderkey) as pending from orders where o_orderstatus = 'P' group by 1) using (year)""",
)
def q37(spark, sf):
    t = shop_graph(spark, sf)
    year = g.pattern(t, "year", "ord", "year")
    a = g.count_per(year.join(g.pattern(t, "priority", "ord", None, obj="1-URGENT"), ["ord"]), "year", "ord", "urgent")
    b = g.count_per(year.join(g.pattern(t, "status", "ord", None, obj="P"), ["ord"]), "year", "ord", "pending")
    return a.join(b, ["year"])


@query("Q44_two_different_values", "select 'customer/' || o_custkey as cust from orders group by o_custkey having count(distinct o_orderpriority) >= 2")
def q44(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    return g.with_several(rows, "cust", "priority")


@query("Q44_five_different_values", "select 'customer/' || o_custkey as cust from orders group by o_custkey having count(distinct o_orderpriority) >= 5")
def q44_many(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    return g.with_several(rows, "cust", "priority", 5)


@query(
    "Q55_unlinked_pattern",
    f"select {OF_CUST} as cust from customer where c_mktsegment = 'FURNITURE' and exists (select 1 from lineitem where l_returnflag = 'R')",
)
def q55(spark, sf):
    t = shop_graph(spark, sf)
    return g.if_any(g.pattern(t, "segment", "cust", None, obj="FURNITURE"), g.pattern(t, "returnFlag", "x", None, obj="R"))


# ------------------------------------------------------- sets, order and limits


@query("Q14_union", "select 'part/' || p_partkey as part, p_brand as word from part union all select 'part/' || p_partkey, p_type from part")
def q14(spark, sf):
    t = shop_graph(spark, sf)
    return g.union(g.pattern(t, "brand", "part", "word"), g.pattern(t, "kind", "part", "word"))


@query(
    "Q15_tagged_union",
    """select category, value, count(*) as n from (select 'return' as category, l_returnflag as value from lineitem
       union all select 'line', l_linestatus from lineitem union all select 'order', o_orderstatus from orders) group by 1, 2""",
)
def q15(spark, sf):
    rows = g.tagged(shop_graph(spark, sf), {"returnFlag": "return", "lineStatus": "line", "status": "order"}, "s", "value")
    return rows.groupBy("category", "value").agg(F.count("*").alias("n"))


@query("Q20_distinct", "select distinct c_mktsegment as segment, o_orderpriority as priority from orders join customer on o_custkey = c_custkey")
def q20(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    return rows.join(g.pattern(t, "segment", "cust", "segment"), ["cust"]).select("segment", "priority").distinct()


@query(
    "Q21_order_by",
    """select year, priority, n, row_number() over (order by n desc, year, priority desc) as place from
       (select year(o_orderdate)::varchar as year, o_orderpriority as priority, count(distinct o_orderkey) as n from orders group by 1, 2)
       order by place limit 20""",
)
def q21(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "year", "ord", "year").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    best = g.top_k(g.count_per(rows, ["year", "priority"], "ord"), 20, F.desc("n"), F.asc("year"), F.desc("priority"))
    # numbering the 20 kept rows shows their order in an unordered comparison
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("year"), F.desc("priority"))).cast("bigint"))


@query("Q23_top_k", f"select {OF_ORDER} as ord, o_totalprice::decimal(18,2)::varchar as total from orders order by o_totalprice::decimal(18,2) desc, 1 limit 10")
def q23(spark, sf):
    rows = g.pattern(shop_graph(spark, sf), "total", "ord", "total")
    return g.top_k(rows, 10, g.as_decimal(F.col("total")).desc(), F.asc("ord"))


@query(
    "Q24_ask",
    "select exists (select 1 from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' and p_brand = 'Brand#2') as answer",
)
def q24(spark, sf):
    t = shop_graph(spark, sf)
    parts = g.pattern(t, "hasPart", "ord", "part").join(g.pattern(t, "brand", "part", None, obj="Brand#2"), ["part"], "left_semi")
    return g.ask(parts.join(g.pattern(t, "returnFlag", "ord", None, obj="R"), ["ord"], "left_semi"))


@query("Q25_ask_having", "select exists (select l_orderkey from lineitem group by 1 having count(distinct l_partkey) >= 12) as answer")
def q25(spark, sf):
    counts = g.count_per(g.pattern(shop_graph(spark, sf), "hasPart", "ord", "part"), "ord", "part")
    return g.ask(counts.filter("n >= 12"))


# ------------------------------------------------- aggregation, classification


@query(
    "Q26_group_by",
    "select n_name as nation, c_mktsegment as segment, count(distinct c_custkey) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2",
)
def q26(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.path(g.pattern(t, "segment", "cust", "segment"), t, "cust", [("inNation", "place"), (g.LABEL, "nation")])
    return g.count_per(rows, ["nation", "segment"], "cust")


@query("Q27_count_distinct", "select o_orderpriority as priority, count(distinct o_custkey) as n from orders group by 1")
def q27(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    return g.count_per(rows, "priority", "cust")


@query("Q28_count_bound", "select source, count(quality) as n from documents left join labels using (doc_id) group by source")
def q28(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.optional(g.pattern(t, "source", "doc", "source"), g.pattern(t, "quality", "doc", "quality"), "doc")
    return rows.groupBy("source").agg(F.count("quality").alias("n"))


def labelled(t: g.Triples) -> DataFrame:
    """Documents with their source and an optional flag for toxic ones."""
    flag = g.pattern(t, "toxic", "doc", None, obj="1").withColumn("toxic", F.lit(1))
    return g.optional(g.pattern(t, "source", "doc", "source"), flag, "doc")


TOXIC = "documents left join (select doc_id, 1 as toxic from labels where toxic = 1) using (doc_id)"


@query("Q29_sum_of_flags", f"select source, sum(coalesce(toxic, 0))::bigint as n from {TOXIC} group by source")
def q29(spark, sf):
    return labelled(shop_graph(spark, sf)).groupBy("source").agg(g.flag_sum("toxic").alias("n"))


@query(
    "Q30_max_of_counts",
    """select 'nation/' || c_nationkey as nation, max(n) as most from customer join
       (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey group by 1""",
)
def q30(spark, sf):
    t = shop_graph(spark, sf)
    counts = g.pattern(t, "placedBy", "ord", "cust").groupBy("cust").agg(F.count("ord").alias("n"))
    return counts.join(g.pattern(t, "inNation", "cust", "nation"), ["cust"]).groupBy("nation").agg(F.max("n").alias("most"))


@query("Q31_average", "select o_orderpriority as priority, round(sum(o_totalprice::decimal(18,4))::double / count(*), 4) as mean from orders group by 1")
def q31(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "priority", "ord", "priority").join(g.pattern(t, "total", "ord", "total"), ["ord"])
    total = F.sum(g.as_decimal(F.col("total")))
    return rows.groupBy("priority").agg(F.round(total.cast("double") / F.count("*"), 4).alias("mean"))


@query(
    "Q32_sample",
    "select 'nation/' || c_nationkey as nation, min(c_mktsegment) as segment, min('customer/' || c_custkey) as cust from customer group by c_nationkey",
)
def q32(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "inNation", "cust", "nation").join(g.pattern(t, "segment", "cust", "segment"), ["cust"])
    return rows.groupBy("nation").agg(g.sample("segment").alias("segment"), g.sample("cust").alias("cust"))


@query(
    "Q33_group_concat",
    """select ord, coalesce(string_agg(p_brand, '; ' order by p_brand), '') as words from
       (select distinct 'order/' || o_orderkey as ord, p_brand from orders left join lineitem on l_orderkey = o_orderkey left join part on l_partkey = p_partkey) group by ord""",
)
def q33(spark, sf):
    t = shop_graph(spark, sf)
    brands = g.pattern(t, "hasPart", "ord", "part").join(g.pattern(t, "brand", "part", "brand"), ["part"]).select("ord", "brand")
    rows = g.optional(g.instances(t, "Order", "ord"), brands, "ord")
    return g.group_concat(rows, "ord", "brand", "words", "; ")


@query("Q34_having", "select 'nation/' || s_nationkey as nation, count(distinct s_suppkey) as n from supplier group by 1 having count(distinct s_suppkey) >= 4")
def q34(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.of_class(g.pattern(t, "inNation", "x", "nation"), t, "x", "Supplier")
    return g.count_per(rows, "nation", "x").filter("n >= 4")


@query("Q35_share", f"select source, round(100.0::double * sum(coalesce(toxic, 0))::double / count(*), 6) as pct from {TOXIC} group by source")
def q35(spark, sf):
    return labelled(shop_graph(spark, sf)).groupBy("source").agg(F.round(g.share("toxic"), 6).alias("pct"))


@query(
    "Q36_dedup_then_count",
    "select priority, count(*) as n from (select distinct o_custkey, o_orderpriority as priority from orders) group by priority",
)
def q36(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    return rows.select("cust", "priority").distinct().groupBy("priority").agg(F.count("*").alias("n"))


@query(
    "Q38_most_frequent_with_members",
    """with c as (select p_brand as brand, p_type as kind, count(distinct p_partkey) as n from part group by 1, 2),
       top as (select * from c where n = (select max(n) from c))
       select brand, kind, n, (select string_agg('part/' || p_partkey, ', ' order by 'part/' || p_partkey) from part where p_brand = brand and p_type = kind) as members from top""",
)
def q38(spark, sf):
    t = shop_graph(spark, sf)
    rows = g.pattern(t, "brand", "part", "brand").join(g.pattern(t, "kind", "part", "kind"), ["part"])
    top = g.most_frequent(g.count_per(rows, ["brand", "kind"], "part"))
    members = g.group_concat(rows.join(top, ["brand", "kind"], "left_semi"), ["brand", "kind"], "part", "members")
    return top.join(members, ["brand", "kind"])


DECADE_SQL = "(floor(year(o_orderdate) / 10.0) * 10)::int || 's'"


def frequent_segments(t: g.Triples) -> DataFrame:
    """Per decade of the order date, the segments ordering most often, ties kept."""
    rows = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "year", "ord", "year"), ["ord"])
    rows = rows.join(g.pattern(t, "segment", "cust", "segment"), ["cust"])
    rows = rows.withColumn("decade", g.decade(g.as_int(F.col("year"))))
    return g.most_frequent(g.count_per(rows, ["decade", "segment"], "ord"), within="decade")


@query(
    "Q39_most_frequent_per_group",
    f"""with c as (select {DECADE_SQL} as decade, c_mktsegment as segment, count(distinct o_orderkey) as n
        from orders join customer on o_custkey = c_custkey group by 1, 2)
        select decade, segment, n from c qualify rank() over (partition by decade order by n desc) = 1""",
)
def q39(spark, sf):
    return frequent_segments(shop_graph(spark, sf))


FLAGS_SQL = """select 'order/' || l_orderkey as ord, max(case when l_returnflag = 'A' then 1 else 0 end) as has_a,
    max(case when l_returnflag = 'N' then 1 else 0 end) as has_n, max(case when l_returnflag = 'R' then 1 else 0 end) as has_r
    from lineitem group by l_orderkey"""


def return_flags(t: g.Triples) -> DataFrame:
    rows = g.pattern(t, "returnFlag", "ord", "flag")
    return g.flags_per(rows, "ord", "flag", {"A": "has_a", "N": "has_n", "R": "has_r"})


@query("Q40_flag_pivot", FLAGS_SQL)
def q40(spark, sf):
    return return_flags(shop_graph(spark, sf))


@query(
    "Q41_classify",
    f"""select ord, case when has_a = 1 and has_r = 1 then 'both' when has_a = 1 then 'accepted only'
        when has_r = 1 then 'returned only' else 'neither' end as kind from ({FLAGS_SQL})""",
)
def q41(spark, sf):
    a, r = F.col("has_a") == 1, F.col("has_r") == 1
    kind = g.classify([(a & r, "both"), (a, "accepted only"), (r, "returned only")], "neither")
    return return_flags(shop_graph(spark, sf)).select("ord", kind.alias("kind"))


@query("Q42_decade", f"select {DECADE_SQL} as decade, count(distinct o_orderkey) as n from orders group by 1")
def q42(spark, sf):
    rows = g.pattern(shop_graph(spark, sf), "year", "ord", "year")
    return g.count_per(rows.withColumn("decade", g.decade(g.as_int(F.col("year")))), "decade", "ord")


@query(
    "Q43_intervals",
    """select case when year(o_orderdate) between 1993 and 1996 then '1993-1996' when year(o_orderdate) between 1997 and 1999 then '1997-1999' end as span,
       count(distinct o_orderkey) as n from orders where year(o_orderdate) between 1993 and 1999 group by 1""",
)
def q43(spark, sf):
    bounds = [(1993, 1996, "1993-1996"), (1997, 1999, "1997-1999")]
    rows = g.pattern(shop_graph(spark, sf), "year", "ord", "year")
    rows = rows.withColumn("span", g.interval(g.as_int(F.col("year")), bounds)).filter("span is not null")
    return g.count_per(rows, "span", "ord")


@query(
    "Q54_missing_share",
    """select * from (select source, round(100.0::double * count_if(quality is null) / count(*), 6) as quality_missing from documents left join labels using (doc_id) group by source)
       join (select source, round(100.0::double * count_if(toxic is null or toxic = 1) / count(*), 6) as toxic_missing from documents left join labels using (doc_id) group by source) using (source)""",
)
def q54(spark, sf):
    t = shop_graph(spark, sf)
    source = g.pattern(t, "source", "doc", "source")
    quality = g.optional(source, g.pattern(t, "quality", "doc", "v"), "doc").groupBy("source").agg(F.round(g.missing_share(F.col("v")), 6).alias("quality_missing"))
    toxic = g.optional(source, g.pattern(t, "toxic", "doc", "v"), "doc").groupBy("source").agg(F.round(g.missing_share(F.col("v"), "1"), 6).alias("toxic_missing"))
    return quality.join(toxic, ["source"])


@query(
    "Q56_coverage_score",
    f"""select {OF_CUST} as cust, coalesce(score, 0) as score from customer left join
        (select o_custkey, count(distinct o_orderpriority) as score from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey""",
)
def q56(spark, sf):
    t = shop_graph(spark, sf)
    facts = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "status", "ord", None, obj="P"), ["ord"])
    facts = facts.join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    return g.coverage(g.instances(t, "Customer", "cust"), facts, "cust", "priority")


# ------------------------------------------------- clustered stores, reduced joins


def clustered(spark: SparkSession, sf: str, *predicates: str) -> SubjectStore:
    """The shop graph's predicates in a store clustered by subject."""
    return write_clustered(shop_graph(spark, sf).only(predicates), f"triples_{uuid.uuid4().hex[:12]}")


@query("S07_clustered_store", "select 'part/' || p_partkey as s, p_brand as o from part union all select 'part/' || p_partkey, p_name from part")
def s7_clustered(spark, sf):
    brands = clustered(spark, sf, "brand", g.LABEL).only(["brand", g.LABEL])
    return brands.filter(F.startswith("s", F.lit("part/"))).select("s", "o")


@query("Q03_star_clustered", STAR_SQL)
def q3_clustered(spark, sf):
    """Class and three predicates of a subject, joined bucket by bucket."""
    t = clustered(spark, sf, g.TYPE, "placedBy", "status", "priority")
    wanted = {"placedBy": "cust", "status": "status", "priority": "priority"}
    return t.each(lambda half: g.star(g.instances(half, "Order", "ord"), half, "ord", wanted))


@query(
    "Q03_star_many_values",
    """select 'order/' || a.l_orderkey as ord, 'part/' || a.l_partkey as part, 'supplier/' || b.l_suppkey as supp, c.o_orderstatus as status
       from lineitem a join lineitem b using (l_orderkey) join orders c on c.o_orderkey = a.l_orderkey""",
)
def q3_many(spark, sf):
    return g.star_once(shop_graph(spark, sf), "ord", {"hasPart": "part", "shippedBy": "supp", "status": "status"})


@query(
    "Q04_path_clustered",
    f"""select {OF_ORDER} as ord, 'customer/' || c_custkey as cust, 'nation/' || n_nationkey as nation, 'region/' || n_regionkey as region
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
)
def q4_clustered(spark, sf):
    t = clustered(spark, sf, g.TYPE, "placedBy", "inNation", "inRegion")
    return g.path(g.instances(t, "Order", "ord"), t, "ord", [("placedBy", "cust"), ("inNation", "nation"), ("inRegion", "region")])


@query(
    "Q04_reduced_path",
    f"""select {OF_ORDER} as ord, 'customer/' || c_custkey as cust, 'nation/' || n_nationkey as nation, 'region/' || r_regionkey as region, r_name as label
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where r_name = 'ASIA' and o_orderpriority = '1-URGENT'""",
)
def q4_reduced(spark, sf):
    """A path with a selective end: each hop is cut to what reaches it before rows get wide."""
    t = shop_graph(spark, sf)
    hops = [("placedBy", "cust"), ("inNation", "nation"), ("inRegion", "region"), (g.LABEL, "label")]
    start = g.pattern(t, "priority", "ord", None, obj="1-URGENT")
    return g.reduced_path(start, t, "ord", hops, {"label": F.col("label") == "ASIA"})


@query(
    "Q06_constant_subject_clustered",
    "select 'nation/' || c_nationkey as nation, c_mktsegment as segment from customer where c_custkey = 7",
)
def q6_clustered(spark, sf):
    t = clustered(spark, sf, "inNation", "segment")
    of = lambda p, var: g.pattern(t, p, "cust", var, subject="customer/7")
    return of("inNation", "nation").join(of("segment", "segment"), ["cust"]).select("nation", "segment")


@query(
    "Q07_all_values_of_a_table",
    """with h as (select distinct o_custkey as c, o_orderpriority as v from orders),
       d as (select distinct s_nationkey as n, o_orderpriority as v from supplier join orders on o_orderkey % 1000 = s_suppkey % 1000)
       select 'nation/' || d.n as nation, 'customer/' || h.c as cust from h join d using (v) group by d.n, h.c
       having count(*) = (select count(*) from d e where e.n = d.n)""",
)
def q7_table(spark, sf):
    """Customers whose orders have all priorities asked for, by nation: a divisor for each group from a table."""
    t = shop_graph(spark, sf)
    has = g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "priority", "ord", "priority"), ["ord"])
    place = lambda c: F.regexp_extract(c, r"\d+", 0).cast("long") % 1000
    # each place's different nations and priorities meet, not its suppliers and orders
    suppliers = g.of_class(g.pattern(t, "inNation", "supp", "nation"), t, "supp", "Supplier").select("nation", place("supp").alias("place")).distinct()
    asked = g.pattern(t, "priority", "ord", "priority").select("priority", place("ord").alias("place")).distinct().join(suppliers, ["place"])
    return g.divided(has, asked, "cust", "priority", "nation")


@query(
    "Q43_interval_table",
    """select 'order/' || o_orderkey as ord, 'supplier/' || s_suppkey as interval from orders left join supplier
       on floor(o_totalprice)::bigint between 1000 * (s_suppkey % 400) and 1000 * (s_suppkey % 400) + 1 + s_suppkey % 3000""",
)
def q43_table(spark, sf):
    """Totals in as many overlapping intervals as there are suppliers, and those in none."""
    supplier = table(spark, sf, "supplier")
    low = (1000 * (F.col("s_suppkey") % 400)).cast("long")
    bounds = supplier.select(iri("supplier", "s_suppkey").alias("interval"), low.alias("low"), (low + 1 + F.col("s_suppkey") % 3000).alias("high"))
    totals = g.pattern(shop_graph(spark, sf), "total", "ord", "total").select("ord", F.floor(g.as_decimal(F.col("total"))).cast("long").alias("total"))
    return g.interval_join(totals, "total", bounds, "low", "high", "left").select("ord", "interval")


# ---------------------------------------------------------- groups in long form

PARTS_OF_SQL = "select distinct c_mktsegment as segment, 'order/' || o_orderkey as ord from orders join customer on o_custkey = c_custkey"


def orders_by_segment(t: g.Triples) -> DataFrame:
    return g.pattern(t, "placedBy", "ord", "cust").join(g.pattern(t, "segment", "cust", "segment"), ["cust"])


@query("Q33_group_values", f"select segment, ord, row_number() over (partition by segment order by ord) - 1 as rank from ({PARTS_OF_SQL})")
def q33_values(spark, sf):
    """A few large groups, each spread over many tasks."""
    return ordered.group_values(orders_by_segment(shop_graph(spark, sf)), "segment", "ord")


@query(
    "Q33_group_segments",
    f"""with v as (select segment, ord, row_number() over (partition by segment order by ord) - 1 as r from ({PARTS_OF_SQL})),
    made as (select segment, r // 512 as n, string_agg(case when r = 0 then '' else ', ' end || ord, '' order by r) as text from v group by segment, r // 512)
    select segment, n as part, coalesce(sum(length(text)) over (partition by segment order by n rows between unbounded preceding and 1 preceding), 0)::bigint as offset, text from made""",
)
def q33_segments(spark, sf):
    rows = orders_by_segment(shop_graph(spark, sf)).withColumnRenamed("segment", "group")
    found = ordered.joined_values(rows, "group", "ord", size=512)
    return found.select(F.col("group").alias("segment"), F.col("segment").alias("part"), "offset", "text")
