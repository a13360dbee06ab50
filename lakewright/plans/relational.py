"""The relational shapes of the captured workload."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakewright.operators.ranks import not_in, with_rank
from lakewright.operators.skew import lookup
from lakewright.plans.registry import query
from lakewright.sources.tables import table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _day(y: int, m: int, d: int):
    return F.lit(dt.datetime(y, m, d))


def _r(column, name, digits=2):
    return F.round(column, digits).alias(name)


@query(
    "q1_grouped_aggregates",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
      round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
      round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
      round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc,
      count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def _(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_shipdate") <= _day(1998, 9, 2))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            _r(F.sum("l_quantity"), "sum_qty"),
            _r(F.sum("l_extendedprice"), "sum_base"),
            _r(F.sum(_revenue()), "sum_disc", 4),
            _r(F.sum(_revenue() * (1 + F.col("l_tax"))), "sum_charge"),
            _r(F.avg("l_quantity"), "avg_qty", 4),
            _r(F.avg("l_extendedprice"), "avg_price", 4),
            _r(F.avg("l_discount"), "avg_disc", 4),
            F.count("*").alias("n"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query(
    "q2_three_way_join",
    """SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15'
    GROUP BY 1, 2""",
)
def _(spark, folder):
    customer = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, folder, "orders").where(F.col("o_orderdate") < _day(1997, 3, 15))
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") > _day(1997, 3, 15))
    # One row per order before the join, so an order with many lines is no longer heavy.
    per_order = lines.groupBy("l_orderkey").agg(F.sum(_revenue()).alias("revenue"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("l_orderkey", "o_orderdate", _r(F.col("revenue"), "revenue", 4))
        .orderBy(F.desc("revenue"), "o_orderdate")
    )


@query(
    "q3_exists_semi_join",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
    GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").where(
        (F.col("o_orderdate") >= _day(1996, 1, 1)) & (F.col("o_orderdate") < _day(1999, 1, 1))
    )
    last_ship = (
        table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    )
    late = (F.col("o_orderkey") == F.col("l_orderkey")) & (
        F.col("last_ship") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    )
    return (
        orders.join(last_ship, late, "left_semi")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("order_count"))
        .orderBy("o_orderpriority")
    )


@query(
    "q4_global_aggregate",
    """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue, count(*) AS n FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def _(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where((F.col("l_shipdate") >= _day(1996, 1, 1)) & (F.col("l_shipdate") < _day(1997, 1, 1)))
        .where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
        .agg(_r(F.sum(F.col("l_extendedprice") * F.col("l_discount")), "revenue", 4), F.count("*").alias("n"))
    )


@query(
    "q5_conditional_sums",
    """SELECT l_returnflag,
      sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::bigint AS high_count,
      sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::bigint AS low_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") >= _day(1996, 1, 1))
    counts = lines.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        counts.join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("l_returnflag")
        .agg(
            F.sum(F.when(urgent, F.col("n")).otherwise(0)).alias("high_count"),
            F.sum(F.when(~urgent, F.col("n")).otherwise(0)).alias("low_count"),
        )
    )


@query(
    "q6_outer_join_count_of_counts",
    """SELECT c_count, count(*) AS custdist FROM (
      SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
      LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%NOT%SPEC%' GROUP BY 1) GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").where(~F.col("o_orderpriority").like("%NOT%SPEC%"))
    per_customer = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (
        table(spark, folder, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy(F.coalesce("n", F.lit(0)).alias("c_count"))
        .agg(F.count("*").alias("custdist"))
        .orderBy(F.desc("custdist"), F.desc("c_count"))
    )


@query(
    "q7_promo_share",
    """SELECT round(100.0 * sum(CASE WHEN starts_with(p_type, 'PROMO') THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
      / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1997-09-01'""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").where(
        (F.col("l_shipdate") >= _day(1996, 9, 1)) & (F.col("l_shipdate") < _day(1997, 9, 1))
    )
    per_part = lines.groupBy("l_partkey").agg(F.sum(_revenue()).alias("rev"))
    joined = per_part.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    promo = F.when(F.startswith("p_type", F.lit("PROMO")), F.col("rev")).otherwise(0.0)
    return joined.agg(_r(100.0 * F.sum(promo) / F.sum("rev"), "promo_revenue", 4))


@query(
    "q8_scalar_max_subquery",
    """WITH revenue AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem
      WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01' GROUP BY 1)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = l_suppkey
    WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
def _(spark, folder):
    revenue = (
        table(spark, folder, "lineitem")
        .where((F.col("l_shipdate") >= _day(1996, 1, 1)) & (F.col("l_shipdate") < _day(1996, 7, 1)))
        .groupBy("l_suppkey")
        .agg(_r(F.sum(_revenue()), "total_revenue", 4))
    )
    top = revenue.where(F.col("total_revenue") == revenue.agg(F.max("total_revenue")).scalar())
    return (
        table(spark, folder, "supplier")
        .join(top, F.col("s_suppkey") == F.col("l_suppkey"))
        .select("s_suppkey", "s_name", "total_revenue")
        .orderBy("s_suppkey")
    )


@query(
    "q9_not_in_count_distinct",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt
    FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_brand <> 'Brand#13' AND NOT starts_with(p_type, 'MEDIUM') AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
      AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    part = table(spark, folder, "part").where(
        (F.col("p_brand") != "Brand#13")
        & ~F.startswith("p_type", F.lit("MEDIUM"))
        & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49)
    )
    bad = table(spark, folder, "supplier").where("s_acctbal < 0")
    kinds = ["p_brand", "p_type", "p_size"]
    wanted = part.select(F.col("p_partkey").alias("l_partkey"), *kinds)
    lines = lookup(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey"), wanted, ["l_partkey"], "inner")
    pairs = lines.select(*kinds, "l_suppkey").distinct()
    return (
        not_in(pairs, "l_suppkey", bad, "s_suppkey")
        .groupBy("p_brand", "p_type", "p_size")
        .agg(F.countDistinct("l_suppkey").alias("supplier_cnt"))
        .orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")
    )


@query(
    "q10_correlated_average",
    """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
    WHERE p_brand IN ('Brand#3', 'Brand#5', 'Brand#13')
      AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
)
def _(spark, folder):
    part = table(spark, folder, "part").where(F.col("p_brand").isin("Brand#3", "Brand#5", "Brand#13"))
    lines = table(spark, folder, "lineitem")
    # A part's lines collapse to one row per quantity, from which the average and the sum below it follow.
    wanted = part.select(F.col("p_partkey").alias("l_partkey"))
    by_quantity = (
        lookup(lines.select("l_partkey", "l_quantity", "l_extendedprice"), wanted, ["l_partkey"], "inner")
        .groupBy("l_partkey", "l_quantity")
        .agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    )
    averages = by_quantity.groupBy("l_partkey").agg(
        (0.4 * F.sum(F.col("l_quantity") * F.col("n")) / F.sum("n")).alias("bound")
    )
    return (
        by_quantity.join(averages, "l_partkey")
        .where(F.col("l_quantity") < F.col("bound"))
        .agg(_r(F.sum("price") / 7.0, "avg_yearly"))
    )


_Q11 = [("Brand#3", 1, 15, 15), ("Brand#5", 10, 25, 30), ("Brand#13", 20, 40, 50)]


@query(
    "q11_disjunctive_join",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM lineitem, part
    WHERE p_partkey = l_partkey AND ("""
    + " OR ".join(
        f"(p_brand = '{b}' AND l_quantity BETWEEN {lo} AND {hi} AND p_size BETWEEN 1 AND {size})" for b, lo, hi, size in _Q11
    )
    + ")",
)
def _(spark, folder):
    arms = [
        (F.col("p_brand") == b) & F.col("l_quantity").between(lo, hi) & F.col("p_size").between(1, size)
        for b, lo, hi, size in _Q11
    ]
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.where(arms[0] | arms[1] | arms[2]).agg(_r(F.sum(_revenue()), "revenue", 4), F.count("*").alias("n"))


@query(
    "q12_anti_join_scalar_average",
    """SELECT substring(c_mktsegment, 1, 2) AS code, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
    WHERE substring(c_mktsegment, 1, 2) IN ('BU', 'AU', 'MA', 'HO', 'FU')
      AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0 AND substring(c_mktsegment, 1, 2) IN ('BU', 'AU', 'MA', 'HO', 'FU'))
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1""",
)
def _(spark, folder):
    code = F.substring("c_mktsegment", 1, 2)
    customer = table(spark, folder, "customer").where(code.isin("BU", "AU", "MA", "HO", "FU"))
    recent = table(spark, folder, "orders").where(F.col("o_orderdate") >= _day(2000, 1, 1)).select("o_custkey").distinct()
    average = customer.where("c_acctbal > 0.0").agg(F.avg("c_acctbal")).scalar()
    return (
        customer.where(F.col("c_acctbal") > average)
        .join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .groupBy(code.alias("code"))
        .agg(F.count("*").alias("numcust"), _r(F.sum("c_acctbal"), "totacctbal"))
        .orderBy("code")
    )


@query(
    "q13_join_date_range_sum",
    """SELECT c_name, round(sum(o_totalprice), 2) AS total_spent FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").where(F.col("o_orderdate").between(_day(1996, 1, 1), _day(1996, 12, 31)))
    spent = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    return (
        table(spark, folder, "customer")
        .join(spent, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_name")
        .agg(_r(F.sum("spent"), "total_spent"))
        .orderBy(F.desc("total_spent"))
    )


@query(
    "q14_average_after_join",
    """SELECT p_brand, round(avg(l_quantity), 4) AS avg_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def _(spark, folder):
    per_part = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("q"), F.count("l_quantity").alias("n"))
    )
    return (
        per_part.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(_r(F.sum("q") / F.sum("n"), "avg_quantity", 4))
    )


@query(
    "q15_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    )


@query(
    "q16_count_column",
    "SELECT s_name, count(l_orderkey) AS order_count FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1",
)
def _(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n"))
    return (
        counts.join(table(spark, folder, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy("s_name")
        .agg(F.sum("n").alias("order_count"))
    )


@query("q17_count_by_two_keys", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, folder):
    return table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query(
    "q18_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(spark, folder):
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(10)
    )


@query(
    "q19_snowflake_lookup",
    """SELECT r_name, n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def _(spark, folder):
    per_nation = (
        table(spark, folder, "customer")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    )
    return (
        per_nation.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("n").alias("n_customers"), _r(F.sum("b"), "balance"))
    )


@query(
    "q20_above_scalar_average",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
)
def _(spark, folder):
    customer = table(spark, folder, "customer")
    average = customer.agg(F.avg("c_acctbal")).scalar()
    return customer.where(F.col("c_acctbal") > average).select("c_custkey", "c_name", "c_acctbal")


@query(
    "q21_column_comparison",
    "SELECT l_linenumber, count(l_orderkey) AS n FROM lineitem WHERE l_tax < l_discount GROUP BY 1",
)
def _(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_tax") < F.col("l_discount"))
        .groupBy("l_linenumber")
        .agg(F.count("l_orderkey").alias("n"))
    )


@query(
    "q22_in_list_date_range",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R')
      AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1, 2""",
)
def _(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag").isin("A", "R"))
        .where(F.col("l_shipdate").between(_day(1996, 1, 1), _day(1998, 12, 31)))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"))
    )


@query(
    "q23_cast_inside_aggregate",
    "SELECT l_suppkey, round(sum(l_tax * cast(l_linenumber AS double)), 2) AS weighted FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey")
        .agg(_r(F.sum(F.col("l_tax") * F.col("l_linenumber").cast("double")), "weighted"))
    )


@query(
    "q24_date_dimension_star",
    """WITH dates AS (SELECT DISTINCT o_orderdate AS d, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
    SELECT round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders JOIN dates ON o_orderdate = d WHERE y = 1997 AND m <= 6""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    dates = orders.select(F.col("o_orderdate").alias("d")).distinct().where("year(d) = 1997 AND month(d) <= 6")
    per_day = orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("k"))
    return per_day.join(dates, F.col("o_orderdate") == F.col("d")).agg(
        _r(F.sum("s"), "revenue"), F.sum("k").alias("n")
    )


@query("q25_single_table_count", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, folder):
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "q26_scan_project_filter",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 25 AND p_brand = 'Brand#5'",
)
def _(spark, folder):
    return table(spark, folder, "part").where("p_size > 25 AND p_brand = 'Brand#5'").select(
        "p_partkey", "p_name", "p_retailprice"
    )


@query(
    "q27_rank",
    """SELECT l_orderkey, l_returnflag, l_extendedprice,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS price_rank FROM lineitem""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    return with_rank(lines, ["l_returnflag"], "l_extendedprice", "rank", "price_rank")


@query(
    "q28_dense_rank",
    """SELECT l_orderkey, l_partkey, l_quantity,
      dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS quantity_rank FROM lineitem""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return with_rank(lines, ["l_orderkey"], "l_quantity", "dense_rank", "quantity_rank")


@query(
    "q29_percent_rank",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
      round(percent_rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC), 6) AS price_percent FROM lineitem""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    ranked = with_rank(lines, ["l_linenumber"], "l_extendedprice", "percent_rank", "price_percent")
    return ranked.withColumn("price_percent", F.round("price_percent", 6))


@query(
    "q30_having",
    "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 500000",
)
def _(spark, folder):
    return (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
        .where("total > 500000")
        .withColumn("total", F.round("total", 2))
    )


@query(
    "q31_decimal_aggregates",
    """SELECT l_linestatus, cast(sum(cast(l_extendedprice AS decimal(9, 2))) AS double) AS total,
      round(sum(cast(l_extendedprice AS decimal(9, 2)))::double / count(*), 4) AS average FROM lineitem GROUP BY 1""",
)
def _(spark, folder):
    price = F.col("l_extendedprice").cast("decimal(9,2)")
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_linestatus")
        .agg(F.sum(price).cast("double").alias("total"), F.round(F.avg(price).cast("double"), 4).alias("average"))
    )


@query(
    "q32_semi_join_dimension",
    """SELECT p_partkey, p_name FROM part WHERE p_partkey IN
      (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.09)""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_quantity > 45 AND l_discount >= 0.09").select("l_partkey").distinct()
    part = table(spark, folder, "part")
    return part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")
