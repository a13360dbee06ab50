"""Views over the base tables with the shape of trial logs, plan logs and training logs.

Each view is one projection of one table, written in the SQL that Spark and DuckDB share, so
the result of a Spark job can be checked by an independent SQL engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.sources.tables import spread, table

_Q = "cast(l_quantity as int)"
_D = "cast(round(l_discount * 100) as int)"
_T = "cast(round(l_tax * 100) as int)"
_K = "(l_partkey % 60 + 1)"


def _text(expr: str) -> str:
    return f"cast({expr} as string)"


TRIAL_COLUMNS = {
    "benchmark": "CASE WHEN l_partkey % 4 = 0 THEN 'tpch' WHEN l_partkey % 4 = 1 THEN 'tpcds' "
                 "WHEN l_partkey % 4 = 2 THEN 'ssb' ELSE 'job' END",
    "file_name": f"'part-' || {_text('l_suppkey % 7')} || '.csv'",
    "engine": "CASE WHEN l_suppkey % 50 = 49 THEN 'flink' WHEN l_suppkey % 3 = 0 THEN 'spark' "
              "WHEN l_suppkey % 3 = 1 THEN 'presto' ELSE 'trino' END",
    "datalake": "CASE WHEN l_linenumber % 3 = 0 THEN 'delta' WHEN l_linenumber % 3 = 1 THEN 'iceberg' "
                "ELSE 'hudi' END",
    "query_name": "CASE WHEN l_partkey % 4 = 0 THEN "
                  f"'tpch_' || {_text('l_linenumber % 3')} || '_q' || {_text(_K)} "
                  f"WHEN l_partkey % 4 = 1 THEN 'query' || {_text(_K)} "
                  f"WHEN l_partkey % 4 = 2 THEN 'q' || {_text(_K + ' % 5 + 1')} || '_' || {_text(_K + ' % 3 + 1')} "
                  f"ELSE 'job_' || {_text(_K)} || 'a' END",
    "conf": f"CASE WHEN {_Q} % 3 = 0 THEN {_text(_Q)} || ';' || {_text(_D)} || '|' || {_text(_T)} "
            f"WHEN {_Q} % 3 = 1 THEN 'mem=' || {_text(_Q)} || 'MB;par=' || {_text(_D)} || ';ok=true' "
            f"ELSE {_text(_Q)} || ';' || {_text(_D)} || ';' || {_text(_T)} END",
    "sf": "CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 3 = 0 THEN '1' "
          "WHEN l_orderkey % 3 = 1 THEN '10' ELSE '100' END",
    "latency": "CASE WHEN l_partkey % 89 = 0 THEN 'bad' "
               "WHEN l_extendedprice >= 1500 AND l_extendedprice < 5000 THEN '1500' "
               f"ELSE {_text('cast(floor(l_extendedprice) as bigint)')} END",
}
TRIAL_FILTER = "(l_partkey % 60 + 2 * (l_suppkey % 3) + l_linenumber % 3) % 5 <> 0"

# Plan texts, one per order. @K@ order key, @C@ customer key, @N@ a small number, @P@ priority,
# @D@ a date.
PLAN_TEMPLATES = [
    """=== Optimized Logical Plan ===
Sort [total#9 DESC NULLS LAST, o_orderdate#4 ASC NULLS FIRST], true
+- Aggregate [o_orderdate#4], [o_orderdate#4, sum(o_totalprice#3) AS total#9]
   +- Project [o_totalprice#3, o_orderdate#4]
      +- Join Inner, (c_custkey#1L = o_custkey#2L)
         :- Project [c_custkey#1L]
         :  +- Filter ((isnotnull(c_mktsegment#5) AND (c_mktsegment#5 = @P@)) AND isnotnull(c_custkey#1L))
         :     +- Relation tpch_hudi_10g.customer[_hoodie_commit_time#70,c_custkey#1L,c_name#6,c_acctbal#7,c_mktsegment#5] parquet
         +- Filter (((isnotnull(o_orderdate#4) AND (o_orderdate#4 >= @D@)) AND (o_totalprice#3 < @K@.5)) AND isnotnull(o_custkey#2L))
            +- Relation tpch_hudi_10g.orders[_hoodie_commit_time#71,o_orderkey#8L,o_custkey#2L,o_totalprice#3,o_orderdate#4] parquet
=== Physical Plan ===
""",
    """== Optimized Logical Plan ==
Aggregate [sum((l_extendedprice#11 * l_discount#12)) AS revenue#13]
+- Project [l_extendedprice#11, l_discount#12]
   +- Filter ((isnotnull(l_quantity#14) AND ((l_quantity#14 < @N@) OR (l_quantity#14 >= 45))) AND (cast(l_shipdate#15 as date) <= @D@))
      +- RelationV2[l_quantity#14, l_extendedprice#11, l_discount#12, l_shipdate#15] spark_catalog.tpch_iceberg_10g.lineitem

== Physical Plan ==
HashAggregate(keys=[], functions=[sum((l_extendedprice#11 * l_discount#12))])
+- Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id=@K@]
""",
    """== Optimized Logical Plan ==
GlobalLimit @N@
+- LocalLimit @N@
   +- Project [s_name#21, s_acctbal#22]
      +- Filter (isnotnull(s_nationkey#23) AND s_nationkey#23 IN (3,@N@,24))
         +- RelationV2[s_name#21, s_acctbal#22, s_nationkey#23] spark_catalog.ssb_iceberg_10g.supplier

== Physical Plan ==
TakeOrderedAndProject(limit=@N@, orderBy=[s_acctbal#22 DESC NULLS LAST])
""",
    """== Optimized Logical Plan ==
Filter (isnotnull(total#31) AND (total#31 > @K@.00))
+- Aggregate [c_mktsegment#32], [c_mktsegment#32, avg(c_acctbal#33) AS total#31]
   +- Join LeftSemi, (c_custkey#34L = o_custkey#35L)
      :- RelationV2[c_custkey#34L, c_acctbal#33, c_mktsegment#32] spark_catalog.tpch_iceberg_10g.customer
      +- Project [o_custkey#35L]
         +- Filter (((isnotnull(o_orderpriority#36) AND StartsWith(o_orderpriority#36, @P@)) AND NOT o_clerk#37 LIKE %night%shift%) AND isnotnull(o_custkey#35L))
            +- RelationV2[o_custkey#35L, o_orderpriority#36, o_clerk#37] spark_catalog.tpch_iceberg_10g.orders

== Physical Plan ==
Filter (total#31 > @K@.00)
""",
    """=== Optimized Logical Plan ===
Project [c_custkey#41L, c_acctbal#42]
+- Join LeftAnti, (o_custkey#44L = c_custkey#41L)
   :- Filter ((isnotnull(c_acctbal#42) AND NOT (c_nationkey#43L = @N@)) AND (c_acctbal#42 > scalar-subquery#45 []))
   :  :  +- Aggregate [avg(c_acctbal#46) AS avg(c_acctbal)#47]
   :  :     +- Project [c_acctbal#46]
   :  :        +- Filter (isnotnull(c_acctbal#46) AND (c_acctbal#46 > 0.0))
   :  :           +- Relation tpch_hudi_10g.customer[c_custkey#48L,c_acctbal#46] parquet
   :  +- Relation tpch_hudi_10g.customer[c_custkey#41L,c_acctbal#42,c_nationkey#43L] parquet
   +- Project [o_custkey#44L]
      +- Relation tpch_hudi_10g.orders[o_orderkey#49L,o_custkey#44L] parquet
=== Physical Plan ===
""",
    """== Optimized Logical Plan ==
Window [sum(sr_return_amt#51) windowspecdefinition(sr_store_sk#52L, sr_returned_date_sk#53L ASC NULLS FIRST, specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())) AS returned_so_far#54], [sr_store_sk#52L], [sr_returned_date_sk#53L ASC NULLS FIRST]
+- Project [sr_store_sk#52L, sr_returned_date_sk#53L, sr_return_amt#51]
   +- Join Inner, (cast(sr_reason_sk#55 as bigint) = r_reason_sk#56L)
      :- Filter (isnotnull(sr_return_amt#51) AND (sr_return_amt#51 > @N@.00))
      :  +- RelationV2[sr_reason_sk#55, sr_store_sk#52L, sr_returned_date_sk#53L, sr_return_amt#51] spark_catalog.tpcds_iceberg_10g.store_returns
      +- Project [r_reason_sk#56L]
         +- Filter (r_reason_desc#57 IN (Damaged,@P@) OR (r_reason_weight#58 = @N@.5))
            +- RelationV2[r_reason_sk#56L, r_reason_desc#57, r_reason_weight#58] spark_catalog.tpcds_iceberg_10g.reason

== Physical Plan ==
AdaptiveSparkPlan isFinalPlan=false
""",
    """== Optimized Logical Plan ==
RelationV2[lo_orderkey#61L, lo_custkey#62L, lo_revenue#63L, custom_tag#64] spark_catalog.ssb_iceberg_10g.lineorder

== Physical Plan ==
BatchScan[lo_orderkey#61L] spark_catalog.ssb_iceberg_10g.lineorder [filters=] RuntimeFilters: [@K@]
""",
    """== Analyzed Logical Plan ==
order_count: bigint
Aggregate [d_year#71], [count(lo_orderkey#72L) AS order_count#73L]
== Optimized Logical Plan ==
Sort [d_year#71 ASC NULLS FIRST], true
+- Aggregate [d_year#71], [d_year#71, count(lo_orderkey#72L) AS order_count#73L]
   +- Project [lo_orderkey#72L, d_year#71]
      +- Join LeftOuter, (lo_orderdate#74 = d_datekey#75)
         :- RelationV2[lo_orderkey#72L, lo_orderdate#74] spark_catalog.ssb_iceberg_10g.lineorder
         +- Filter (isnotnull(d_year#71) AND (d_datekey#75 < lo_commit#76))
            +- RelationV2[d_datekey#75, d_year#71] spark_catalog.ssb_iceberg_10g.date

== Physical Plan ==
Sort [d_year#71 ASC NULLS FIRST], true, 0
""",
]
_BENCH = ["tpch_0_q", "tpch_gpt_q", "ssb_q", "tpch_1_q", "tpch_2_q", "tpcds_gpt_q_", "ssb_Q1.", "ssb_q_gpt"]


def _case(subject: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {subject} = {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {arms} END"


_MARKS = {
    "@K@": _text("o_orderkey"),
    "@C@": _text("o_custkey"),
    "@N@": _text("o_custkey % 20 + 1"),
    "@P@": "o_orderpriority",
    "@D@": "'199' || " + _text("o_custkey % 10") + " || '-0' || " + _text("o_custkey % 9 + 1") + " || '-15'",
}


def _filled(template: str) -> str:
    for mark, value in _MARKS.items():
        template = f"replace({template}, '{mark}', {value})"
    return template


PLAN_COLUMNS = {
    "file_name": f"{_case('o_orderkey % 8', _BENCH)} || {_text('o_orderkey')} || "
                 "CASE WHEN o_orderkey % 31 = 0 THEN '.txt' ELSE '_plan.txt' END",
    "text": _filled(_case("o_orderkey % 8", PLAN_TEMPLATES)),
}



def _joined() -> str:
    """The text of ``PLAN_COLUMNS`` from the parts of its template, which costs one copy instead of a search per mark.

    A missing value leaves no text, also where the template does not show it; values that could hold a mark are searched.
    """
    arms = []
    for i, template in enumerate(PLAN_TEMPLATES):
        parts = [_MARKS.get(part, f"'{part}'") for part in re.split("(@[KCNPD]@)", template) if part]
        arms.append(f"WHEN o_orderkey % 8 = {i} THEN concat({', '.join(parts)})")
    return (
        f"CASE WHEN o_orderkey IS NULL OR o_custkey IS NULL OR o_orderpriority IS NULL THEN NULL "
        f"WHEN contains(o_orderpriority, '@') THEN {PLAN_COLUMNS['text']} ELSE CASE {' '.join(arms)} END END"
    )


# One plan per query of the trial log, under the name its query is mapped to; a fifth of the queries has none.
_NO = "(o_custkey % 60 + 1)"
QUERY_PLAN_KEY = (
    f"CASE WHEN o_orderkey % 4 = 0 THEN 'tpch_0_q' || {_text(_NO)} WHEN o_orderkey % 4 = 1 THEN 'tpcds_q' || {_text(_NO)} "
    f"WHEN o_orderkey % 4 = 2 THEN 'ssb_Q' || {_text(_NO + ' % 5 + 1')} || '.' || {_text(_NO + ' % 3 + 1')} "
    f"ELSE 'job_' || {_text(_NO)} || 'a' END"
)
QUERY_PLAN_FILTER = f"{_NO} % 5 <> 0"

_CENTS = "cast(round(value * 100) as bigint)"


def _decimal(whole: str, milli: str) -> str:
    return f"{_text(whole)} || '.' || lpad({_text(milli)}, 4, '0')"


_LOSS = _decimal(f"({_CENTS} - {_CENTS} % 100) // 100", f"{_CENTS} % 100 * 100")
_RATIO = _decimal(f"1 + {_CENTS} % 7", f"{_CENTS} % 9973")
_BEST = _decimal("1", f"{_CENTS} % 997")

LOG_COLUMNS = {
    "file_name": "CASE WHEN user_id % 11 = 10 THEN 'notes.log' ELSE 'train_' || CASE WHEN user_id % 4 = 0 THEN 'tpch' "
                 "WHEN user_id % 4 = 1 THEN 'tpcds' WHEN user_id % 4 = 2 THEN 'ssb' ELSE 'job' END "
                 f"|| '_sf' || {_text('user_id % 13')} || '.log' END",
    "line_no": "event_id",
    "line": "CASE "
            f"WHEN event_type = 'error' AND user_id % 3 <> 0 AND event_id % 5 = 0 THEN 'Final test ratio (best-valid snapshot, ep' || {_text('event_id % 30')} || '): ' || {_RATIO} "
            f"WHEN event_type = 'error' THEN 'Training complete. Best valid ratio: ' || {_BEST} || ' at epoch ' || {_text('event_id % 30')} "
            f"WHEN event_type = 'signup' THEN 'Loaded ' || {_text(_CENTS)} || ' rows' "
            f"WHEN event_id % 2 = 0 THEN '  Epoch ' || lpad({_text('event_id')}, 3, ' ') || ': s1=' || {_LOSS} || ' (mse=' || {_BEST} || ' ce=' || {_LOSS} || ' div=0.0100) s2=' || {_BEST} || ' s3=' || {_LOSS} || ' valid_ratio=' || {_RATIO} || '  best_valid=' || {_BEST} || '@ep' || {_text('event_id % 30')} "
            f"ELSE 'Epoch ' || {_text('event_id')} || ': expert=' || {_LOSS} || ' test_ratio=' || {_RATIO} || ' best=' || {_BEST} || '@ep' || {_text('event_id % 30')} || ' (target=' || {_BEST} || ')' END",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def _sql(source: str, columns: dict[str, str], where: str | None = None) -> str:
    tail = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(_select(columns))} FROM {source}{tail}"


def trials_raw(spark: SparkSession, folder: str) -> DataFrame:
    used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    lines = table(spark, folder, "lineitem").where(TRIAL_FILTER).select(*used)
    return spread(lines, "l_orderkey", "l_partkey").selectExpr(*_select(TRIAL_COLUMNS))


def plan_files(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return spread(orders, "o_orderkey").selectExpr(*_select({**PLAN_COLUMNS, "text": _joined()}))


def query_plan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Plan texts named after queries of the trial log: that of the least order of each name."""
    orders = table(spark, folder, "orders").where(QUERY_PLAN_FILTER)
    named = orders.selectExpr(f"{QUERY_PLAN_KEY} AS plan_key", "o_orderkey", "o_custkey", "o_orderpriority")
    first = named.groupBy("plan_key").agg(F.min(F.struct("o_orderkey", "o_custkey", "o_orderpriority")).alias("o"))
    return first.select("plan_key", "o.*").selectExpr("plan_key || '_plan.txt' AS file_name", f"{PLAN_COLUMNS['text']} AS text")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    columns = {k: v.replace("//", "div") for k, v in LOG_COLUMNS.items()}
    return table(spark, folder, "events").selectExpr(*_select(columns))


TRIALS_SQL = _sql("lineitem", TRIAL_COLUMNS, TRIAL_FILTER)
PLANS_SQL = _sql("orders", PLAN_COLUMNS)
LOGS_SQL = _sql("events", LOG_COLUMNS)
QUERY_PLANS_SQL = (
    f"SELECT plan_key || '_plan.txt' AS file_name, {PLAN_COLUMNS['text']} AS text FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY plan_key ORDER BY o_orderkey, o_custkey, o_orderpriority) AS no FROM (SELECT {QUERY_PLAN_KEY} AS plan_key, o_orderkey, "
    f"o_custkey, o_orderpriority FROM orders WHERE {QUERY_PLAN_FILTER})) WHERE no = 1"
)
