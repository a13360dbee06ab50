"""Queries over histograms and row estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import histograms as H
from lakewright.operators.skew import lookup
from lakewright.plans import sqltext as Q
from lakewright.plans.registry import query
from lakewright.session import materialize, scratch_path
from lakewright.sources.tables import table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_PROFILE = {
    "customer": (["c_nationkey", "c_acctbal"], ["c_mktsegment"]),
    "supplier": (["s_acctbal"], []),
    "lineitem": (["l_extendedprice", "l_quantity"], ["l_returnflag"]),
    "region": ([], ["r_name"]),
}


def profile(spark, folder):
    """Histogram of every profiled column."""
    from functools import reduce

    counts = [H.column_counts(table(spark, folder, t), n, x) for t, (n, x) in _PROFILE.items()]
    return H.build(materialize(reduce(lambda a, b: a.unionByName(b), counts)))


def _values_sql() -> str:
    parts = []
    for t, (numeric, text) in _PROFILE.items():
        parts += [f"SELECT '{c}' AS col, {c}::double AS num, cast({c} AS varchar) AS text FROM {t}" for c in numeric]
        parts += [f"SELECT '{c}' AS col, NULL::double AS num, {c} AS text FROM {t}" for c in text]
    return " UNION ALL ".join(parts)


HIST = f"""vals AS ({_values_sql()}),
few AS (SELECT col FROM vals GROUP BY col HAVING count(DISTINCT text) <= 25),
points AS (
  SELECT col, NULL::double AS lo, NULL::double AS hi, text AS value, any_value(num) AS avg,
    count(*) / sum(count(*)) OVER (PARTITION BY col) AS height, false AS closed
  FROM vals WHERE col IN (FROM few) GROUP BY col, text),
tiles AS (SELECT col, num, ntile(10) OVER (PARTITION BY col ORDER BY num) AS tile FROM vals WHERE col NOT IN (FROM few)),
ranges AS (
  SELECT col, min(num) AS lo, max(num) AS hi, NULL::varchar AS value, avg(num) AS avg,
    count(*) / sum(count(*)) OVER (PARTITION BY col) AS height, tile = 10 AS closed
  FROM tiles GROUP BY col, tile),
hist AS (FROM points UNION ALL FROM ranges),
texts AS (
  SELECT col, value, lo, hi,
    CASE WHEN lo IS NULL THEN value ELSE '[' || lo::decimal(18, 2)::varchar || ', ' || hi::decimal(18, 2)::varchar || CASE WHEN closed THEN ']' ELSE ')' END END
      || ': avg = ' || coalesce(avg::decimal(18, 4)::varchar, value) || ', height = ' || height::decimal(6, 4)::varchar AS line
  FROM hist),
rounded AS (SELECT col, value, lo::decimal(18, 2)::double AS lo, hi::decimal(18, 2)::double AS hi, height::decimal(6, 4)::double AS height FROM hist)"""

_SHOW = """SELECT col AS "column", round(lo, 2) AS lo, round(hi, 2) AS hi, value, round(height, 4) AS height"""


@query("h7_histogram_build", Q.with_(HIST, select=_SHOW + ", round(avg, 3) AS avg FROM hist"))
def _(spark, folder):
    return profile(spark, folder).select(
        "column", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), "value",
        F.round("height", 4).alias("height"), F.round("avg", 3).alias("avg"),
    )


@query("h1_histogram_parse", Q.with_(HIST, select=_SHOW + " FROM rounded"))
def _(spark, folder):
    return H.parse_text(H.to_text(profile(spark, folder))).select("column", "lo", "hi", "value", "height")


@query(
    "s5_histogram_scan",
    Q.with_(HIST, select='SELECT col AS "column", count(*) AS n_buckets, round(sum(height), 4) AS height FROM rounded GROUP BY 1'),
)
def _(spark, folder):
    from lakewright.sources.text_files import read_texts

    path = scratch_path(spark, "histograms")
    H.to_text(profile(spark, folder)).select("text").write.text(path)
    return (
        H.parse_text(read_texts(spark, path, "*.txt"))
        .groupBy("column")
        .agg(F.count("*").alias("n_buckets"), F.round(F.sum("height"), 4).alias("height"))
    )


@query(
    "h8_row_count_catalog",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
)
def _(spark, folder):
    return H.table_rows(spark, folder, TABLES)


_OPS = ["=", "<", "<=", ">", ">=", "IN", "LIKE", "="]
# Predicates, one per customer: @op@ and @values@ follow the customer key.
_PRED_COLUMNS = {
    "pred_id": "c_custkey",
    "col": "CASE WHEN c_custkey % 5 = 0 THEN 'c_nationkey' WHEN c_custkey % 5 = 1 THEN 'c_acctbal' "
           "WHEN c_custkey % 5 = 2 THEN 'c_mktsegment' WHEN c_custkey % 5 = 3 THEN 'l_quantity' ELSE 'c_comment' END",
    "op": "CASE " + " ".join(f"WHEN c_custkey % 8 = {i} THEN '{o}'" for i, o in enumerate(_OPS)) + " END",
    "first": "CASE WHEN c_custkey % 8 = 7 THEN 'o_custkey#12' WHEN c_custkey % 5 = 0 THEN cast(c_custkey % 27 as string) "
             "WHEN c_custkey % 5 = 1 THEN cast(c_custkey % 9000 as string) || '.25' "
             "WHEN c_custkey % 5 = 2 THEN c_mktsegment ELSE cast(c_custkey % 60 as string) END",
    "second": "CASE WHEN c_custkey % 5 = 2 THEN 'BUILDING' ELSE cast(c_custkey % 11 + 30 as string) END",
    "negated": "c_custkey % 3 = 0",
}
_PREDS = "preds AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PRED_COLUMNS.items()) + " FROM customer)"
_LITS = """lits AS (
  SELECT *, first AS lit FROM preds UNION ALL SELECT *, second AS lit FROM preds WHERE op = 'IN'),
rows_of AS (SELECT 'c' AS prefix, count(*) AS n FROM customer UNION ALL SELECT 'l', count(*) FROM lineitem)"""


def _hits(less: str, less_eq: str, more: str, more_eq: str) -> str:
    """Per literal and bucket; x is the literal, numeric where both sides are."""
    return f"""hits AS (
  SELECT pred_id, coalesce(sum(CASE
    WHEN CASE op WHEN '<' THEN {less} WHEN '<=' THEN {less_eq} WHEN '>' THEN {more} WHEN '>=' THEN {more_eq}
      WHEN '=' THEN CASE WHEN lo IS NOT NULL THEN x BETWEEN lo AND hi WHEN x IS NOT NULL THEN p = x ELSE value = lit END
      WHEN 'IN' THEN CASE WHEN lo IS NOT NULL THEN x BETWEEN lo AND hi WHEN x IS NOT NULL THEN p = x ELSE value = lit END END
    THEN height END), 0) AS sel
  FROM (SELECT l.*, h.lo, h.hi, h.height, h.value, try_cast(lit AS double) AS x, try_cast(h.value AS double) AS p
        FROM lits l JOIN hist h ON l.col = h.col)
  GROUP BY pred_id)"""


def _cmp(ranged: str, point: str) -> str:
    return f"(CASE WHEN lo IS NOT NULL THEN {ranged} WHEN x IS NOT NULL THEN p {point} x ELSE (p IS NULL AND value {point} lit) END)"


_RIGHT = _hits(_cmp("hi <= x", "<"), _cmp("hi <= x", "<="), _cmp("lo >= x", ">"), _cmp("lo >= x", ">="))
_COMPAT = _hits(_cmp("lo > x", ">"), _cmp("lo > x", ">"), _cmp("hi < x", "<"), _cmp("hi < x", "<"))


def _predicates(spark, folder):
    from lakewright.sources.derived import _select

    raw = table(spark, folder, "customer").selectExpr(*_select(_PRED_COLUMNS))
    values = F.when(F.col("op") == "IN", F.array("first", "second")).otherwise(F.array("first"))
    return raw.select("pred_id", F.col("col").alias("column"), "op", values.alias("values"), "negated")


def _estimates(spark, folder, compat=False, ops=None):
    nested = H.nest(profile(spark, folder))
    rows = H.prefix_rows(H.table_rows(spark, folder, TABLES), "tpch")
    preds = _predicates(spark, folder)
    if ops:
        preds = preds.where(F.col("op").isin(ops))
    return H.estimate(preds, nested, rows, compat)


def _sel_query(name, compat, hits, ops):
    listed = ", ".join(f"'{o}'" for o in ops)
    sql = Q.with_(
        HIST, _PREDS, _LITS, hits,
        select=f"""SELECT pred_id, col AS "column", op, round(coalesce(sel, 0), 4) AS selectivity
        FROM preds LEFT JOIN hits USING (pred_id) WHERE op IN ({listed}) AND NOT contains(first, '#')""",
    )

    @query(name, sql)
    def _(spark, folder):
        nested = H.nest(profile(spark, folder))
        preds = _predicates(spark, folder).where(F.col("op").isin(ops))
        preds = preds.where(~F.exists("values", lambda v: F.contains(v, F.lit("#"))))
        op = F.when(F.col("op") == "IN", "=").otherwise(F.col("op"))
        sel = F.coalesce(H.selectivity(F.col("buckets"), op, F.col("values"), compat), F.lit(0.0))
        joined = lookup(preds, nested, ["column"])
        return joined.select("pred_id", "column", "op", F.round(sel, 4).alias("selectivity"))


_sel_query("h2_literal_selectivity", False, _RIGHT, ["=", "<", "<=", ">", ">="])
_sel_query("h2_literal_selectivity_compat", True, _COMPAT, ["=", "<", "<=", ">", ">="])
_sel_query("h3_in_list_selectivity", False, _RIGHT, ["IN"])


def _row_query(name, ops, marker, compat=False):
    listed = ", ".join(f"'{o}'" for o in ops)
    hits = _COMPAT if compat else _RIGHT
    base = f"""CASE WHEN op = 'LIKE' THEN 0.1::double * coalesce(n, 1) WHEN contains(first, '#') THEN coalesce(n, 1)::double
      ELSE coalesce(sel, 0) * coalesce(n, 1) END"""
    sql = Q.with_(
        HIST, _PREDS, _LITS, hits,
        select=f"""SELECT pred_id, col AS "column", op, round(CASE WHEN negated THEN coalesce(n, 1) - {base} ELSE {base} END, 2) AS estimated
        FROM preds LEFT JOIN hits USING (pred_id) LEFT JOIN rows_of ON split_part(col, '_', 1) = prefix
        WHERE op IN ({listed}) AND {marker}""",
    )

    @query(name, sql)
    def _(spark, folder):
        kept = _estimates(spark, folder, compat, ops)
        has_ref = F.exists("values", lambda v: F.contains(v, F.lit("#")))
        if marker.startswith("NOT"):
            kept = kept.where(~has_ref)
        elif marker != "true":
            kept = kept.where(has_ref)
        return kept.select("pred_id", "column", "op", F.round("estimated", 2).alias("estimated"))


_row_query("h4_row_estimate", ["=", "<", "<=", ">", ">=", "IN"], "NOT contains(first, '#')")
_row_query("h4_row_estimate_compat", ["=", "<", "<=", ">", ">=", "IN"], "NOT contains(first, '#')", True)
_row_query("h5_pattern_estimate", ["LIKE"], "true")
_row_query("h6_column_comparison_estimate", ["="], "contains(first, '#')")


@query(
    "j10_bucket_range_lookup",
    Q.with_(
        HIST,
        "prices AS (SELECT list({lo: lo, hi: hi, height: height}) AS buckets FROM hist WHERE col = 'l_extendedprice')",
        """hits AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
          list_filter(buckets, lambda b: l_extendedprice BETWEEN b.lo AND b.hi) AS hit FROM lineitem, prices)""",
        select="""SELECT l_orderkey, l_linenumber, l_extendedprice, len(hit) AS n_buckets,
          round(coalesce(list_sum(list_transform(hit, lambda b: b.height)), 0), 4) AS height FROM hits""",
    ),
)
def _(spark, folder):
    hist = profile(spark, folder).where("column = 'l_extendedprice'")
    prices = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.lit("l_extendedprice").alias("column"))
    hits = H.bucket_hits(prices, hist, "l_extendedprice")
    return hits.select("l_orderkey", "l_linenumber", "l_extendedprice", "n_buckets", F.round("height", 4).alias("height"))
