"""The relational operators that generated SQL uses, each on whole star tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sarani.operators.numbering import number_within
from sarani.plans.registry import query
from sarani.sources.star import load


@query("rel_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def rel_scan(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query("rel_project", "SELECT c_custkey, c_name FROM customer")
def rel_project(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name")


@query("rel_alias", "SELECT s_suppkey AS id, s_name AS supplier_name FROM supplier")
def rel_alias(spark, d):
    return load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("supplier_name")
    )


@query("rel_filter_eq", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def rel_filter_eq(spark, d):
    c = load(spark, d, "customer")
    return c.filter(c.c_mktsegment == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query("rel_bool", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE (l_returnflag = 'R' AND l_quantity > 40) OR NOT (l_discount < 0.09 OR l_tax >= 0.04)""")
def rel_bool(spark, d):
    li = load(spark, d, "lineitem")
    keep = ((li.l_returnflag == "R") & (li.l_quantity > 40)) | ~((li.l_discount < 0.09) | (li.l_tax >= 0.04))
    return li.filter(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("rel_in_list", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def rel_in_list(spark, d):
    o = load(spark, d, "orders")
    return o.filter(o.o_orderpriority.isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("rel_in_subquery", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def rel_in_subquery(spark, d):
    o = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return load(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("rel_not_in", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')""")
def rel_not_in(spark, d):
    o = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return load(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("rel_between", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12""")
def rel_between(spark, d):
    li = load(spark, d, "lineitem")
    return li.filter(li.l_quantity.between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("rel_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt' OR p_name LIKE 'r_d %'")
def rel_like(spark, d):
    p = load(spark, d, "part")
    return p.filter(p.p_name.like("%bolt") | p.p_name.like("r_d %")).select("p_partkey", "p_name")


@query("rel_group_by", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty,
       ROUND(AVG(l_extendedprice), 4) AS avg_price
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def rel_group_by(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
    )


@query("rel_having", """
SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15""")
def rel_having(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("agg_count", """
SELECT o_orderstatus, COUNT(*) AS n_rows, COUNT(o_custkey) AS n_cust FROM orders GROUP BY o_orderstatus""")
def agg_count(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.count("o_custkey").alias("n_cust")
    )


@query("agg_sum", "SELECT l_suppkey, ROUND(SUM(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY l_suppkey")
def agg_sum(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price")
    )


@query("agg_min_max", """
SELECT p_brand, MIN(p_retailprice) AS min_price, MAX(p_retailprice) AS max_price, MIN(p_name) AS min_name
FROM part GROUP BY p_brand""")
def agg_min_max(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("min_price"), F.max("p_retailprice").alias("max_price"),
        F.min("p_name").alias("min_name"),
    )


@query("agg_avg", "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS avg_balance FROM customer GROUP BY c_mktsegment")
def agg_avg(spark, d):
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.round(F.avg("c_acctbal"), 4).alias("avg_balance")
    )


@query("fn_abs", "SELECT c_custkey, ABS(c_acctbal) AS abs_balance FROM customer")
def fn_abs(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("abs_balance"))


@query("fn_subtract", """
SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice - l_quantity, 2) AS difference FROM lineitem""")
def fn_subtract(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - F.col("l_quantity"), 2).alias("difference")
    )


@query("rel_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def rel_distinct(spark, d):
    return load(spark, d, "part").select("p_brand", "p_type").distinct()


@query("agg_count_distinct", """
SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag""")
def agg_count_distinct(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("n_parts")
    )


@query("rel_order_by", """
SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey ASC) AS rank
FROM orders""")
def rel_order_by(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_desc"))
    ranked = number_within(o, [], "_desc", "_no", ties=("o_orderkey",))
    return ranked.select("o_orderkey", "o_totalprice", (F.col("_no") + 1).alias("rank")).orderBy(
        F.desc("o_totalprice"), F.asc("o_orderkey")
    )


@query("rel_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def rel_top_k(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    ).limit(20)


@query("rel_top_k_per_table", """
SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def rel_top_k_per_table(spark, d):
    best = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return (
        load(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
        .withColumn("_r", F.row_number().over(best)).filter("_r <= 3").drop("_r")
    )


@query("rel_join", """
SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def rel_join(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


_SETS = """
SELECT c_nationkey AS nationkey, c_acctbal < 0 AS in_debt FROM customer WHERE c_mktsegment = 'BUILDING'
{op} SELECT s_nationkey, s_acctbal < 0 FROM supplier"""


def _set_sides(spark, d):
    c = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_nationkey").alias("nationkey"), (F.col("c_acctbal") < 0).alias("in_debt")
    )
    s = load(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), (F.col("s_acctbal") < 0).alias("in_debt")
    )
    return c, s


@query("rel_union", _SETS.format(op="UNION"))
def rel_union(spark, d):
    c, s = _set_sides(spark, d)
    return c.union(s).distinct()


@query("rel_intersect", _SETS.format(op="INTERSECT"))
def rel_intersect(spark, d):
    c, s = _set_sides(spark, d)
    return c.intersect(s)


@query("rel_except", _SETS.format(op="EXCEPT"))
def rel_except(spark, d):
    c, s = _set_sides(spark, d)
    return c.subtract(s)
