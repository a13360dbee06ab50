"""Queries over captured plan texts, their trees and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import PREFIX_TABLES
from lakewright.operators import features as X
from lakewright.operators import histograms as H
from lakewright.operators import plan_batches as B
from lakewright.operators import plan_lines as P
from lakewright.operators import trees as G
from lakewright.operators.mapping import map_queries
from lakewright.operators.trials import QUERY, query_ids
from lakewright.plans import sqltext as Q
from lakewright.plans.histogram import TABLES, profile
from lakewright.plans.registry import query
from lakewright.plans.trial_log import accepted
from lakewright.session import materialize, scratch_path
from lakewright.sources.derived import plan_files
from lakewright.sources.tables import table
from lakewright.sources.tree_cache import cached_trees

_OPT = r"(?s){m} Optimized Logical Plan {m}\n(.*?)\n{m} Physical Plan {m}"
SECT = f"""sect AS (
  SELECT file_name, split_part(file_name, '_plan', 1) AS plan_key, split_part(file_name, '_', 1) AS benchmark, text,
    regexp_replace(coalesce(nullif(regexp_extract(text, '{_OPT.format(m="===")}', 1), ''),
      nullif(regexp_extract(text, '{_OPT.format(m="==")}', 1), '')), '^\\s+|\\s+$', '', 'g') AS section
  FROM plan_files WHERE ends_with(file_name, '_plan.txt'))"""
NODES = r"""split_lines AS (
  SELECT plan_key, benchmark, unnest(string_split(section, chr(10))) AS line,
    generate_subscripts(string_split(section, chr(10)), 1) AS i FROM sect),
nodes AS (
  SELECT plan_key, benchmark, row_number() OVER (PARTITION BY plan_key ORDER BY i) - 1 AS node_id, depth, body,
    regexp_extract(body, '(\w+)', 1) AS word
  FROM (SELECT *, CASE WHEN i = 1 THEN 0 WHEN regexp_matches(line, '^([ :]*?)(\+-|:-) ')
      THEN length(regexp_extract(line, '^([ :]*?)(\+-|:-) ', 1)) // 3 + 1 END AS depth,
      regexp_replace(line, '^([ :]*?)(\+-|:-) ', '') AS body FROM split_lines)
  WHERE depth IS NOT NULL),
ops AS (
  SELECT *, CASE WHEN word IN ('RelationV2', 'Relation') THEN 'Scan'
    WHEN word = 'Join' THEN 'Join ' || regexp_extract(body, '^Join (\w+)', 1) ELSE word END AS operator,
    CASE WHEN word = 'RelationV2' THEN regexp_extract(body, '\] *(?:\w+\.)*(\w+)$', 1)
      WHEN word = 'Relation' THEN regexp_extract(body, '^Relation (?:\w+\.)*(\w+)\[', 1) END AS table_name,
    list_transform(string_split(regexp_extract(body, '\[(.*?)\]', 1), ','), lambda c: trim(split_part(c, '#', 1))) AS listed
  FROM nodes)"""
_PLANS = (Q.PLAN_FILES, SECT)
_NODES = (*_PLANS, NODES)


def lines(spark, folder, files=None):
    return P.plan_lines(P.corpus(plan_files(spark, folder) if files is None else files))


def line_trees(spark, folder, files=None):
    # A line is a node here, and a tree needs its depth only.
    plans = P.line_depths(P.corpus(plan_files(spark, folder) if files is None else files))
    return G.with_paths(plans, F.col("depths"))


def expanded(spark, folder, files=None):
    plans = P.with_join_keys(P.plan_nodes(lines(spark, folder, files)))
    return G.with_paths(plans, F.transform("nodes", lambda n: n["depth"]))


def _rows(plans):
    return plans.select("plan_key", "benchmark", F.posexplode_outer("nodes").alias("node_id", "n")).select(
        "plan_key", "benchmark", "node_id", "n.*"
    )


def _kept(plans, *fields, columns=()):
    """Plans with these fields of their nodes and these further columns: what a table written of them needs."""
    nodes = F.transform("nodes", lambda n: F.struct(*[n[f].alias(f) for f in fields]))
    return plans.select("plan_key", "benchmark", nodes.alias("nodes"), *columns)


def line_rows(spark, folder):
    return _rows(P.line_nodes(lines(spark, folder)))


@query(
    "s4_plan_corpus",
    Q.with_(
        Q.PLAN_FILES,
        select="""SELECT file_name, md5(text) AS text_hash FROM plan_files
        WHERE ends_with(file_name, '_plan.txt') AND starts_with(file_name, 'tpch')""",
    ),
)
def _(spark, folder):
    return P.corpus(plan_files(spark, folder), "tpch").select("file_name", F.md5("text").alias("text_hash"))


@query("p1_optimized_section", Q.with_(*_PLANS, select="SELECT file_name, md5(section) AS hash, length(section) AS n FROM sect"))
def _(spark, folder):
    section = P.optimized_section(F.col("text"))
    files = P.corpus(plan_files(spark, folder)).select("file_name", section.alias("s"))
    return files.select("file_name", F.md5("s").alias("hash"), F.length("s").alias("n"))


@query(
    "p2_physical_section",
    Q.with_(
        *_PLANS,
        select=r"""SELECT file_name, md5(s) AS hash, length(s) AS n FROM (SELECT file_name,
        CASE WHEN regexp_matches(text, '(?s)== Physical Plan ==\n(.*)') THEN
          regexp_replace(regexp_extract(text, '(?s)== Physical Plan ==\n(.*)', 1), '^\s+|\s+$', '', 'g') END AS s FROM sect)""",
    ),
)
def _(spark, folder):
    section = P.physical_section(F.col("text"))
    files = P.corpus(plan_files(spark, folder)).select("file_name", section.alias("s"))
    return files.select("file_name", F.md5("s").alias("hash"), F.length("s").alias("n"))


@query("p3_line_nodes", Q.with_(*_NODES, select="SELECT plan_key, node_id, depth, word FROM nodes"))
def _(spark, folder):
    plans = lines(spark, folder).select("plan_key", F.posexplode_outer("lines").alias("node_id", "l"))
    return plans.select("plan_key", "node_id", "l.depth", "l.word")


@query("p4_root_operators", Q.with_(*_NODES, select="SELECT plan_key, operator FROM ops WHERE depth = 0"))
def _(spark, folder):
    return line_rows(spark, folder).where("depth = 0").select("plan_key", "operator")


@query(
    "p5_scan_nodes",
    Q.with_(*_NODES, select="SELECT plan_key, node_id, table_name, array_to_string(listed, ',') AS columns FROM ops WHERE operator = 'Scan'"),
)
def _(spark, folder):
    scans = line_rows(spark, folder).where("operator = 'Scan'")
    return scans.select("plan_key", "node_id", F.col("table").alias("table_name"), F.array_join("scan_cols", ",").alias("columns"))


@query("p6_join_nodes", Q.with_(*_NODES, select="SELECT plan_key, node_id, operator FROM ops WHERE word = 'Join'"))
def _(spark, folder):
    return line_rows(spark, folder).where(F.startswith("operator", F.lit("Join"))).select("plan_key", "node_id", "operator")


_KEY = r"\(\s*(?:cast\()?\s*(\w+#\d+L?)(?:\s+as\s+\w+\))?\s*=\s*(?:cast\()?\s*(\w+#\d+L?)(?:\s+as\s+\w+\))?\s*\)"


@query(
    "j9_join_key_pairs",
    Q.with_(
        *_NODES,
        f"""pairs AS (
          SELECT plan_key, benchmark, node_id, regexp_extract(body, '{_KEY}', 1) AS l, regexp_extract(body, '{_KEY}', 2) AS r
          FROM ops WHERE word = 'Join'),
        scans AS (SELECT plan_key, node_id AS scan_id, table_name, list_transform(string_split(regexp_extract(body, '\\[(.*?)\\]', 1), ','), lambda c: trim(c)) AS refs
          FROM ops WHERE operator = 'Scan'),
        sides AS (
          SELECT p.plan_key, p.benchmark, p.node_id, p.l, p.r,
            arg_min(table_name, scan_id) FILTER (list_contains(refs, l)) AS lt, arg_min(table_name, scan_id) FILTER (list_contains(refs, r)) AS rt
          FROM pairs p LEFT JOIN scans s ON p.plan_key = s.plan_key AND scan_id > p.node_id GROUP BY ALL)""",
        select="""SELECT plan_key, node_id, coalesce(benchmark || '_' || lt || '.', '') || split_part(l, '#', 1) AS left_key,
          coalesce(benchmark || '_' || rt || '.', '') || split_part(r, '#', 1) AS right_key FROM sides WHERE l <> ''""",
    ),
)
def _(spark, folder):
    plans = P.with_join_keys(P.line_nodes(lines(spark, folder)))
    rows = plans.select("plan_key", F.posexplode_outer("join_keys").alias("node_id", "k")).where(F.size("k") == 2)
    return rows.select("plan_key", "node_id", F.get("k", F.lit(0)).alias("left_key"), F.get("k", F.lit(1)).alias("right_key"))


def _list_query(name, field, word, expr):
    @query(name, Q.with_(*_NODES, select=f"SELECT plan_key, node_id, array_to_string({expr}, ',') AS columns FROM ops WHERE word = '{word}'"))
    def _(spark, folder):
        rows = line_rows(spark, folder).where(F.col("operator") == word)
        return rows.select("plan_key", "node_id", F.array_join(field, ",").alias("columns"))


_list_query("p7_project_columns", "project_cols", "Project", "listed")
_list_query("p8_aggregate_keys", "agg_cols", "Aggregate", r"CASE WHEN len(regexp_extract_all(body, '\[(.*?)\]', 1)) >= 2 THEN listed ELSE [] END")
_list_query("p9_sort_columns", "sort_cols", "Sort", r"regexp_extract_all(body, '(\w+)#', 1)")


@query(
    "p10_limits",
    Q.with_(*_NODES, select=r"SELECT plan_key, node_id, cast(regexp_extract(body, 'Limit (\d+)', 1) AS int) AS lim FROM ops WHERE contains(word, 'Limit')"),
)
def _(spark, folder):
    rows = line_rows(spark, folder).where(F.contains("operator", F.lit("Limit")))
    return rows.select("plan_key", "node_id", F.col("limit").alias("lim"))


_CLEAN_SQL = r"substr(body, 8)"
for _pattern, _new in [
    (r"\b(?:isnotnull|isnull)\(", "("),
    (r"cast\(([^()]*) as \w+(?:\(\d+,\d+\))?\)", r"\1"),
    (r"\b(?:avg|sum|min|max)\(([^()]*)\)", r"\1"),
    (r"substring\((\w+#\d+L?),[^()]*\)", r"\1"),
    (r"coalesce\((\w+#\d+L?),[^()]*\)", r"\1"),
]:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_pattern}', '{_new}', 'g')"


@query("p11_predicate_cleaning", Q.with_(*_NODES, select=f"SELECT plan_key, node_id, {_CLEAN_SQL} AS predicate FROM ops WHERE word = 'Filter'"))
def _(spark, folder):
    rows = line_rows(spark, folder).where("operator = 'Filter'")
    return rows.select("plan_key", "node_id", P.clean_predicate(F.expr("substring(body, 8)")).alias("predicate"))


# Predicate texts, one per order, for the rarer forms.
_CASE_TEXT = "'(CASE WHEN (o_totalprice#3 > ' || cast(o_custkey as string) || ') THEN 1 ELSE 0 END AND (o_custkey#2L = ' || cast(o_orderkey as string) || '))'"
_OR_TEXT = "'(o_custkey#2L = ' || cast(o_custkey as string) || ' OR NOT (o_orderkey#1L > ' || cast(o_orderkey as string) || '))'"
_DEC_TEXT = "'(total#1 > CheckOverflow((1.2 * promote_precision(avg_' || cast(o_custkey as string) || '#2)), DecimalType(14,7), true))'"


def _order_text(spark, folder, expr):
    return table(spark, folder, "orders").selectExpr("o_orderkey", f"{expr} AS text")


def _text_nodes(rows):
    rows = rows.withColumn("nodes", P.predicate_nodes(F.col("text")))
    rows = rows.select("o_orderkey", F.posexplode_outer("nodes").alias("pos", "p"))
    rows = rows.withColumn("a", F.when(F.col("p.text").isNotNull(), P.atom(F.col("p.text"))))
    return rows.select(
        "o_orderkey", "pos", "p.level", "p.kind", "p.negated", F.col("a.col").alias("col"), F.col("a.op").alias("op"),
        F.array_join("a.values", ",").alias("vals"),
    )


def _built(*nodes: tuple[str, ...]) -> str:
    parts = [
        f"SELECT o_orderkey, {pos} AS pos, {level} AS level, '{kind}' AS kind, {neg} AS negated, {col} AS col, {op} AS op, {val} AS vals FROM orders"
        for pos, (level, kind, neg, col, op, val) in enumerate(nodes)
    ]
    return " UNION ALL ".join(parts)


@query(
    "p12_case_stripping",
    _built(
        ("0", "AND", "false", "NULL", "NULL", "NULL"),
        ("1", "Predicate", "false", "'o_totalprice'", "'>'", "cast(o_custkey AS varchar)"),
        ("1", "Predicate", "false", "'o_custkey'", "'='", "cast(o_orderkey AS varchar)"),
    ),
)
def _(spark, folder):
    return _text_nodes(_order_text(spark, folder, _CASE_TEXT))


@query(
    "p13_or_regrouping",
    _built(
        ("0", "OR", "false", "NULL", "NULL", "NULL"),
        ("1", "Predicate", "false", "'o_custkey'", "'='", "cast(o_custkey AS varchar)"),
        ("1", "Predicate", "true", "'o_orderkey'", "'>'", "cast(o_orderkey AS varchar)"),
    ),
)
def _(spark, folder):
    return _text_nodes(_order_text(spark, folder, _OR_TEXT))


@query(
    "p16_decimal_comparison",
    _built(("0", "Predicate", "false", "'total'", "'>'", "'avg_' || cast(o_custkey AS varchar) || '#2'")),
)
def _(spark, folder):
    return _text_nodes(_order_text(spark, folder, _DEC_TEXT))


@query(
    "p14_predicate_atoms",
    Q.with_(
        *_NODES,
        r"""filters AS (SELECT plan_key, regexp_replace(body, 'cast\(([^()]*) as \w+\)', '\1', 'g') AS body FROM ops WHERE word = 'Filter'),
        found AS (
          SELECT plan_key, unnest(regexp_extract_all(body, '\w+#\d+L? (?:>=|<=|>|<|=) [^()]+')) AS a, 'cmp' AS k FROM filters
          UNION ALL SELECT plan_key, unnest(regexp_extract_all(body, '\w+#\d+L? IN \([^()]*\)')), 'in' FROM filters
          UNION ALL SELECT plan_key, unnest(regexp_extract_all(body, 'StartsWith\([^()]*\)')), 'sw' FROM filters
          UNION ALL SELECT plan_key, unnest(regexp_extract_all(body, '\w+#\d+L? LIKE [^() ]+')), 'like' FROM filters
          UNION ALL SELECT plan_key, unnest(regexp_extract_all(body, 'isnotnull\(([^()]*)\)', 1)), 'bare' FROM filters)""",
        select=r"""SELECT plan_key, col, op, vals, count(*) AS n FROM (SELECT plan_key,
          CASE k WHEN 'sw' THEN regexp_extract(a, '\((\w+)#', 1) ELSE regexp_extract(a, '^(\w+)#', 1) END AS col,
          CASE k WHEN 'cmp' THEN regexp_extract(a, ' (>=|<=|>|<|=) ', 1) WHEN 'in' THEN 'IN' WHEN 'sw' THEN 'StartsWith' WHEN 'like' THEN 'LIKE' ELSE '' END AS op,
          CASE k WHEN 'cmp' THEN regexp_extract(a, ' (?:>=|<=|>|<|=) (.*)$', 1) WHEN 'in' THEN regexp_extract(a, '\((.*)\)', 1)
            WHEN 'sw' THEN regexp_extract(a, ', (.*)\)', 1) WHEN 'like' THEN regexp_extract(a, 'LIKE (.*)$', 1) ELSE '' END AS vals
          FROM found) GROUP BY ALL""",
    ),
)
def _(spark, folder):
    rows = _rows(P.plan_nodes(lines(spark, folder))).where("pred IS NOT NULL")
    return rows.groupBy(
        "plan_key", F.col("pred.col").alias("col"), F.col("pred.op").alias("op"), F.array_join("pred.values", ",").alias("vals")
    ).agg(F.count("*").alias("n"))


@query(
    "p15_nested_predicates",
    Q.with_(
        *_NODES,
        select=r"""SELECT plan_key, sum(len(regexp_extract_all(body, ' AND ')))::bigint AS n_and, sum(len(regexp_extract_all(body, ' OR ')))::bigint AS n_or,
          sum(len(regexp_extract_all(body, ' AND ')) + len(regexp_extract_all(body, ' OR ')) + 1)::bigint AS n_atoms,
          sum(len(regexp_extract_all(body, 'NOT (?:\(|\w+#)')))::bigint AS n_negated
        FROM ops WHERE word = 'Filter' GROUP BY 1""",
    ),
)
def _(spark, folder):
    rows = _rows(P.plan_nodes(lines(spark, folder))).where("operator IN ('AND', 'OR', 'Predicate')")
    return rows.groupBy("plan_key").agg(
        F.count_if(F.col("operator") == "AND").alias("n_and"),
        F.count_if(F.col("operator") == "OR").alias("n_or"),
        F.count_if(F.col("operator") == "Predicate").alias("n_atoms"),
        F.count_if("negated").alias("n_negated"),
    )


@query(
    "p17_table_initials",
    Q.with_(
        *_NODES,
        select="""SELECT table_name, array_to_string(list_transform(string_split(table_name, '_'),
          lambda w: CASE WHEN w = 'char' THEN 'ch' ELSE left(w, 1) END), '') AS initials, count(*) AS n
        FROM ops WHERE operator = 'Scan' GROUP BY ALL""",
    ),
)
def _(spark, folder):
    scans = line_rows(spark, folder).where("operator = 'Scan'").groupBy(F.col("table").alias("table_name")).agg(F.count("*").alias("n"))
    return scans.select("table_name", S.table_initials(F.col("table_name")).alias("initials"), "n")


@query(
    "p17_prefixed_predicates",
    Q.with_(
        *_NODES,
        r"""below AS (SELECT *, lead(operator) OVER w AS next_operator, lead(table_name) OVER w AS next_table FROM ops WINDOW w AS (PARTITION BY plan_key ORDER BY node_id)),
        filters AS (SELECT plan_key, regexp_replace(body, 'cast\(([^()]*) as \w+\)', '\1', 'g') AS body,
          CASE WHEN benchmark IN ('job', 'ssb') AND next_operator = 'Scan' THEN array_to_string(list_transform(string_split(next_table, '_'),
            lambda w: CASE WHEN w = 'char' THEN 'ch' ELSE left(w, 1) END), '') || '_' ELSE '' END AS prefix FROM below WHERE word = 'Filter'),
        found AS (
          SELECT plan_key, prefix, regexp_extract(unnest(regexp_extract_all(body, '\w+#\d+L? (?:>=|<=|>|<|=|LIKE|IN) ')), '^(\w+)#', 1) AS col FROM filters
          UNION ALL SELECT plan_key, prefix, regexp_extract(unnest(regexp_extract_all(body, '(?:StartsWith|isnotnull)\([^()]*\)')), '\((\w+)#', 1) FROM filters)""",
        select="SELECT plan_key, prefix || col AS col, count(*) AS n FROM found GROUP BY ALL",
    ),
)
def _(spark, folder):
    rows = _rows(P.with_table_prefix(P.plan_nodes(lines(spark, folder)))).where("pred IS NOT NULL")
    return rows.groupBy("plan_key", F.col("pred.col").alias("col")).agg(F.count("*").alias("n"))


_RELATIONS = r"""mentions AS (
  SELECT unnest(regexp_extract_all(text, 'RelationV2\[([^\]]*)\] ?((?:\w+\.)*)(\w+)', 1)) AS cols,
    unnest(regexp_extract_all(text, 'RelationV2\[([^\]]*)\] ?((?:\w+\.)*)(\w+)', 2)) AS db,
    unnest(regexp_extract_all(text, 'RelationV2\[([^\]]*)\] ?((?:\w+\.)*)(\w+)', 3)) AS t FROM plan_files),
relations AS (
  SELECT DISTINCT regexp_extract(db, '(job|tpcds|ssb|tpch)_iceberg_10g', 1) || '_' || t AS table_name,
    trim(split_part(unnest(string_split(cols, ',')), '#', 1)) AS col FROM mentions)"""


@query("s6_relation_columns", Q.with_(Q.PLAN_FILES, _RELATIONS, select='SELECT table_name, col AS "column" FROM relations'))
def _(spark, folder):
    return P.relation_columns(plan_files(spark, folder))


def benchmark_rows(spark, folder):
    """Row counts of the tables each benchmark shares with the base tables; a handful of numbers."""
    counts = {r.table_name: r.n_rows for r in H.table_rows(spark, folder, TABLES).collect()}
    return {b: {t: counts[t] for t in m.values() if t in counts} for b, m in PREFIX_TABLES.items()}


_ROWS_MAP = "MAP {" + ", ".join(f"'{b}_{t}': (SELECT count(*) FROM {t})" for b, m in PREFIX_TABLES.items() for t in dict.fromkeys(m.values()) if t in TABLES) + "}"
_PREFIX_MAP = "MAP {" + ", ".join(f"'{b}|{p}': '{t}'" for b, m in PREFIX_TABLES.items() for p, t in m.items()) + "}"


@query(
    "p20_column_magnitude",
    Q.with_(
        Q.PLAN_FILES, _RELATIONS,
        select=f"SELECT table_name || '.' || col AS name, length(cast(coalesce(({_ROWS_MAP})[table_name], 1) AS varchar)) AS magnitude FROM relations",
    ),
)
def _(spark, folder):
    return X.column_magnitudes(P.relation_columns(plan_files(spark, folder)), benchmark_rows(spark, folder))


@query(
    "t12_digit_count",
    "SELECT o_orderkey, length(cast(o_custkey AS varchar)) AS digits FROM orders",
)
def _(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.digit_count(F.col("o_custkey")).alias("digits"))


@query(
    "t14_numeric_cleaning",
    """SELECT o_orderkey, coalesce(try_cast(trim(t) AS double), 0.0::double) AS a FROM (SELECT o_orderkey, CASE o_orderkey % 5
      WHEN 0 THEN o_orderpriority WHEN 1 THEN ' ' || cast(o_custkey AS varchar) || '.5 ' WHEN 2 THEN cast(o_custkey AS varchar) || 'x'
      WHEN 3 THEN '-' || cast(o_custkey AS varchar) ELSE '' END AS t FROM orders)""",
)
def _(spark, folder):
    kind, number = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    text = (
        F.when(kind == 0, F.col("o_orderpriority")).when(kind == 1, F.concat(F.lit(" "), number, F.lit(".5 ")))
        .when(kind == 2, F.concat(number, F.lit("x"))).when(kind == 3, F.concat(F.lit("-"), number)).otherwise("")
    )
    return table(spark, folder, "orders").select("o_orderkey", F.coalesce(S.to_number(text), F.lit(0.0)).alias("a"))


@query(
    "t15_plan_key_fix",
    """SELECT key, replace(replace(replace(replace(key, 'query', 'q'), 'aug', '_aug'), '_a', 'a'), '_b', 'b') AS fixed, count(*) AS n FROM (
      SELECT CASE o_orderkey % 3 WHEN 0 THEN 'query' || cast(o_custkey AS varchar) || '_a' WHEN 1 THEN 'tpch_0_q' || cast(o_custkey AS varchar) || 'aug2'
        ELSE 'query' || cast(o_custkey AS varchar) || '_b' END AS key FROM orders) GROUP BY key""",
)
def _(spark, folder):
    number, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    key = (
        F.when(kind == 0, F.concat(F.lit("query"), number, F.lit("_a")))
        .when(kind == 1, F.concat(F.lit("tpch_0_q"), number, F.lit("aug2")))
        .otherwise(F.concat(F.lit("query"), number, F.lit("_b")))
    )
    keys = table(spark, folder, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return keys.select("key", S.plan_key_fix(F.col("key")).alias("fixed"), "n")


_SEEN = """ids AS (
  SELECT operator, row_number() OVER (ORDER BY first_seen) - 1 AS op_id FROM
    (SELECT operator, min((plan_key, node_id)) AS first_seen FROM ops GROUP BY 1)),
tabs AS (SELECT table_name, row_number() OVER (ORDER BY table_name) AS t FROM (SELECT DISTINCT table_name FROM ops WHERE table_name <> ''))"""


@query("a8_operator_vocabulary", Q.with_(*_NODES, _SEEN, select="SELECT operator, op_id FROM ids"))
def _(spark, folder):
    return X.operator_ids(P.line_nodes(lines(spark, folder)))


@query("a8_table_vocabulary", Q.with_(*_NODES, _SEEN, select="SELECT table_name FROM tabs"))
def _(spark, folder):
    return X.scan_tables(P.line_nodes(lines(spark, folder)))


@query(
    "t13_one_hot_operator",
    Q.with_(
        *_NODES, _SEEN,
        select=f"""SELECT plan_key, node_id, {Q.fixed("list_concat(list_transform(range((SELECT count(*) FROM ids)), lambda i: CASE WHEN i = op_id THEN 1.0::double ELSE 0.0::double END), [coalesce(t, 0)::double, 0.0::double])", 0)} AS encoding
        FROM ops JOIN ids USING (operator) LEFT JOIN tabs ON ops.table_name = tabs.table_name""",
    ),
)
def _(spark, folder):
    plans = materialize(_kept(P.line_nodes(lines(spark, folder)), "operator", "table"))
    rows = X.one_hot_nodes(plans, X.operator_ids(plans), X.scan_tables(plans))
    return rows.withColumn("encoding", S.fixed_point(F.col("encoding"), 0))


def _resolved(items: str) -> str:
    return (
        f"list_filter(list_transform({items}, lambda c: CASE WHEN contains(c, '_') THEN "
        "coalesce(benchmark || '_' || prefixes[benchmark || '|' || split_part(c, '_', 1)], seen[benchmark || '|' || c]) || '.' || c END), lambda c: c IS NOT NULL)"
    )


_KNOWN = (
    _RELATIONS,
    f"""maps AS (SELECT {_PREFIX_MAP} AS prefixes, map_from_entries(list((k, v))) AS seen
      FROM (SELECT split_part(table_name, '_', 1) || '|' || col AS k, min(table_name) AS v FROM relations GROUP BY 1))""",
    rf"""vecs AS (SELECT plan_key, benchmark, node_id, operator, depth + 1 AS height,
      CASE WHEN contains(word, 'Limit') THEN cast(regexp_extract(body, 'Limit (\d+)', 1) AS int) ELSE 0 END AS lim,
      CASE WHEN operator = 'Scan' THEN {_resolved("listed")} ELSE [] END AS scan,
      CASE WHEN word = 'Project' THEN {_resolved("listed")} ELSE [] END AS project,
      CASE WHEN word = 'Aggregate' AND len(regexp_extract_all(body, '\[(.*?)\]', 1)) >= 2 THEN {_resolved("listed")} ELSE [] END AS agg,
      CASE WHEN word = 'Sort' THEN {_resolved(r"regexp_extract_all(body, '(\w+)#', 1)")} ELSE [] END AS sort
      FROM ops, maps)""",
)


def line_vectors(spark, folder):
    files = plan_files(spark, folder)
    known = X.known_columns(P.relation_columns(files))
    return X.node_vectors(P.with_join_keys(P.line_nodes(P.plan_lines(P.corpus(files)))), known)


@query(
    "j8_column_resolution",
    Q.with_(*_NODES, *_KNOWN, select="SELECT plan_key, node_id, unnest(scan) AS name FROM vecs"),
)
def _(spark, folder):
    rows = line_vectors(spark, folder).select("plan_key", F.posexplode_outer("vectors").alias("node_id", "v"))
    return rows.select("plan_key", "node_id", F.explode("v.scan").alias("name"))


@query(
    "p18_node_vectors",
    Q.with_(
        *_NODES, *_KNOWN,
        select="""SELECT plan_key, node_id, operator, lim, height, array_to_string(scan, ',') AS scan, array_to_string(project, ',') AS project,
          array_to_string(agg, ',') AS agg, array_to_string(sort, ',') AS sort FROM vecs""",
    ),
)
def _(spark, folder):
    rows = line_vectors(spark, folder).select("plan_key", F.posexplode_outer("vectors").alias("node_id", "v"))
    joined = [F.array_join(f"v.{k}", ",").alias(k) for k in ("scan", "project", "agg", "sort")]
    return rows.select("plan_key", "node_id", "v.operator", F.col("v.limit").alias("lim"), "v.height", *joined)


@query(
    "a9_list_widths",
    Q.with_(
        *_NODES, *_KNOWN,
        select="SELECT benchmark, max(len(scan)) AS w_scan, max(len(project)) AS w_project, max(len(agg)) AS w_agg, max(len(sort)) AS w_sort FROM vecs GROUP BY 1",
    ),
)
def _(spark, folder):
    return X.list_widths(line_vectors(spark, folder)).drop("w_join")


def _digits(items: str, width: str) -> str:
    return f"list_resize(list_transform({items}, lambda c: coalesce(mags[c], 0)::double), {width}, 0.0::double)"


@query(
    "p21_list_padding",
    Q.with_(
        *_NODES, *_KNOWN,
        f"""mag AS (SELECT map_from_entries(list((table_name || '.' || col, length(cast(coalesce(({_ROWS_MAP})[table_name], 1) AS varchar))))) AS mags FROM relations),
        wide AS (SELECT benchmark, max(len(scan)) AS w_scan, max(len(project)) AS w_project FROM vecs GROUP BY 1)""",
        select=f"""SELECT plan_key, node_id, {Q.fixed(_digits("scan", "w_scan"), 0)} AS scan, {Q.fixed(_digits("project", "w_project"), 0)} AS project
        FROM vecs JOIN wide USING (benchmark), mag""",
    ),
)
def _(spark, folder):
    plans = materialize(line_vectors(spark, folder).select("plan_key", "benchmark", "vectors"))
    magnitudes = X.column_magnitudes(P.relation_columns(plan_files(spark, folder)), benchmark_rows(spark, folder))
    widths = X.list_widths(plans)
    sizes = X._as_map(magnitudes, F.col("name"), F.col("magnitude"))
    rows = plans.select("plan_key", "benchmark", F.posexplode_outer("vectors").alias("node_id", "v")).withColumn("_s", sizes)

    def padded(kind):
        known = F.transform(f"v.{kind}", lambda c: F.coalesce(F.try_element_at(F.col("_s"), c), F.lit(0)).cast("double"))
        return S.fixed_point(S.pad(known, F.col(f"w_{kind}")), 0).alias(kind)

    return X.lookup(rows, widths, ["benchmark"]).select("plan_key", "node_id", padded("scan"), padded("project"))


_PARENTS = """parents AS (
  SELECT n.plan_key, n.node_id, max(p.node_id) AS parent_id FROM nodes n
  JOIN nodes p ON p.plan_key = n.plan_key AND p.depth = n.depth - 1 AND p.node_id < n.node_id GROUP BY 1, 2),
edges AS (SELECT *, row_number() OVER (PARTITION BY plan_key, parent_id ORDER BY node_id) - 1 AS child_no FROM parents),
closure AS (
  SELECT plan_key, node_id, parent_id AS ancestor_id, 1 AS hops FROM parents
  UNION ALL SELECT c.plan_key, c.node_id, p.parent_id, hops + 1 FROM closure c JOIN parents p ON p.plan_key = c.plan_key AND p.node_id = c.ancestor_id)"""
_TREES = (*_NODES, _PARENTS)


@query(
    "w8_tree_parents",
    Q.with_(
        *_TREES,
        select="""SELECT plan_key, node_id, parent_id, child_no,
        CASE child_no WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'extra' END AS side FROM edges""",
    ),
)
def _(spark, folder):
    return G.parent_rows(line_trees(spark, folder))


@query("g1_adjacency", Q.with_(
    *_TREES,
    select="""SELECT n.plan_key, n.node_id, string_agg(CASE WHEN p.parent_id = n.node_id THEN '1' ELSE '0' END, ',' ORDER BY m.node_id) AS row
    FROM nodes n JOIN nodes m ON n.plan_key = m.plan_key LEFT JOIN parents p ON p.plan_key = m.plan_key AND p.node_id = m.node_id GROUP BY 1, 2""",
))
def _(spark, folder):
    rows = G.adjacency(line_trees(spark, folder))
    return rows.withColumn("row", F.array_join(F.transform("row", lambda x: x.cast("string")), ","))


@query("g2_ancestors", Q.with_(*_TREES, select="SELECT plan_key, node_id, ancestor_id, hops FROM closure"))
def _(spark, folder):
    return G.ancestors(line_trees(spark, folder))


@query("g3_distances", Q.with_(
    *_TREES,
    """up AS (SELECT plan_key, node_id, ancestor_id, hops FROM closure UNION ALL SELECT plan_key, node_id, node_id, 0 FROM nodes),
    pairs AS (SELECT a.plan_key, a.node_id AS u, b.node_id AS v, min(a.hops + b.hops) AS d FROM up a JOIN up b USING (plan_key, ancestor_id) GROUP BY ALL)""",
    select="SELECT plan_key, u AS node_id, string_agg(cast(d AS varchar), ',' ORDER BY v) AS hops FROM pairs GROUP BY 1, 2",
))
def _(spark, folder):
    rows = G.distances(line_trees(spark, folder))
    return rows.withColumn("hops", F.array_join(F.col("hops").cast("array<string>"), ","))


@query(
    "g4_roots",
    Q.with_(
        *_NODES,
        # A node has a parent if an earlier node of its plan is one level shallower: the depths seen so far as bits.
        """seen AS (SELECT plan_key, node_id, depth, bit_or(1::hugeint << depth::int) OVER (PARTITION BY plan_key ORDER BY node_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS depths FROM nodes)""",
        select="SELECT plan_key, node_id AS root_id FROM seen WHERE depth = 0 OR coalesce(depths, 0) & (1::hugeint << (depth - 1)::int) = 0",
    ),
)
def _(spark, folder):
    return G.roots(line_trees(spark, folder))


@query("g5_flat_tree", Q.with_(
    *_TREES,
    select="""SELECT n.plan_key, n.node_id, coalesce(string_agg(cast(e.node_id AS varchar), ',' ORDER BY e.node_id), '') AS children
    FROM nodes n LEFT JOIN edges e ON e.plan_key = n.plan_key AND e.parent_id = n.node_id GROUP BY 1, 2""",
))
def _(spark, folder):
    rows = G.child_lists(line_trees(spark, folder))
    return rows.withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


@query("g6_two_child_completion", Q.with_(
    *_TREES,
    select="SELECT plan_key, parent_id, 'right' AS side, 'Dummy' AS operator FROM edges GROUP BY 1, 2 HAVING count(*) = 1",
))
def _(spark, folder):
    return G.dummies(line_trees(spark, folder))


@query("g7_subtree_swap", Q.with_(
    *_TREES,
    f"""two AS (SELECT plan_key, parent_id, min(node_id) AS l, max(node_id) AS r FROM edges GROUP BY 1, 2 HAVING count(*) = 2),
    draws AS (SELECT *, {Q.uniform("42", "plan_key", "copy", "parent_id")} < 0.3::double AS swap FROM two, range(1, 6) c(copy))""",
    select="""SELECT plan_key || '_aug' || cast(copy AS varchar) AS tree_key, parent_id AS node_id,
      CASE WHEN swap THEN cast(r AS varchar) || ',' || cast(l AS varchar) ELSE cast(l AS varchar) || ',' || cast(r AS varchar) END AS children FROM draws""",
))
def _(spark, folder):
    rows = G.augment(line_trees(spark, folder)).where("copy > 0")
    rows = rows.select("tree_key", F.posexplode_outer("children").alias("node_id", "kids")).where(F.size("kids") == 2)
    return rows.select("tree_key", "node_id", F.array_join(F.transform("kids", lambda x: x.cast("string")), ",").alias("children"))


@query("g8_node_heights", Q.with_(*_TREES, select="SELECT plan_key, node_id, depth + 1 AS height FROM nodes"))
def _(spark, folder):
    return G.heights(line_trees(spark, folder))


@query("g9_operator_counts", Q.with_(*_NODES, select="SELECT plan_key, operator, count(*) AS n FROM ops GROUP BY 1, 2"))
def _(spark, folder):
    return line_rows(spark, folder).groupBy("plan_key", "operator").agg(F.count("*").alias("n"))


@query("w11_leaf_levels", Q.with_(
    *_TREES,
    select="""SELECT n.plan_key, n.node_id, coalesce(max(c.hops), 0) AS level FROM nodes n
    LEFT JOIN closure c ON c.plan_key = n.plan_key AND c.ancestor_id = n.node_id GROUP BY 1, 2""",
))
def _(spark, folder):
    return G.leaf_levels(line_trees(spark, folder))


@query("a22_forest_offsets", Q.with_(
    *_NODES,
    select="""SELECT plan_key, n AS n_nodes, sum(n) OVER (ORDER BY plan_key)::bigint - n AS node_offset
    FROM (SELECT plan_key, count(*) AS n FROM nodes GROUP BY 1)""",
))
def _(spark, folder):
    sizes = lines(spark, folder).select("plan_key", F.size("lines").cast("bigint").alias("n_nodes"))
    return G.forest_offsets(sizes)


def plan_features(spark, folder, files=None):
    """Numeric trees of the whole plan log, or of these plan texts; a query that reads them twice writes them first."""
    files = plan_files(spark, folder) if files is None else files
    relations = materialize(P.relation_columns(files))
    plans = materialize(B.plan_vectors(P.corpus(files), X.known_columns(relations)))
    hist = H.nest(profile(spark, folder))
    rows = benchmark_rows(spark, folder)
    named = plans.select("plan_key", F.transform("vectors.operator", lambda o: F.struct(o.alias("operator"))).alias("nodes"))
    return X.flat_features(plans, X.operator_ids(named), X.column_magnitudes(relations, rows), hist, rows)


@query("p19_flat_features")
def _(spark, folder):
    plans = plan_features(spark, folder).select("plan_key", X.fixed_points(F.col("features")).alias("features"))
    return plans.select("plan_key", F.posexplode_outer("features").alias("node_id", "features"))


@query("p22_common_width", Q.with_(*_PLANS, select="SELECT benchmark, count(*) AS n_plans, 1 AS n_widths FROM sect GROUP BY 1"))
def _(spark, folder):
    flat = X.common_width(materialize(plan_features(spark, folder)))
    return flat.groupBy("benchmark").agg(
        F.count("*").alias("n_plans"), F.countDistinct(F.size(F.get("features", F.lit(0)))).alias("n_widths")
    )


@query(
    "j11_tree_cache_merge",
    Q.with_(*_PLANS, select="SELECT benchmark, count(*) AS n_plans, count(DISTINCT plan_key) AS n_keys, true AS same_width FROM sect GROUP BY 1"),
)
def _(spark, folder):
    """Trees of every benchmark, each padded for itself, united at the widest one's width."""
    flat = materialize(plan_features(spark, folder))
    widths = X.common_width(flat).withColumn("width", F.size(F.get("features", F.lit(0))))
    widest = flat.agg(F.max(F.size(F.get("features", F.lit(0))))).scalar()
    return widths.groupBy("benchmark").agg(
        F.count("*").alias("n_plans"),
        F.countDistinct("plan_key").alias("n_keys"),
        (F.min("width") == F.max("width")).alias("one_width"),
        F.max("width").alias("width"),
    ).select("benchmark", "n_plans", "n_keys", (F.col("one_width") & (F.col("width") == widest)).alias("same_width"))


def swapped_trees(spark, folder, files, copies=2):
    """Children lists of each plan and of its copies with swapped sides."""
    trees = G.augment(line_trees(spark, folder, files).select("plan_key", "benchmark", "parents"), copies=copies)
    return trees.select("benchmark", "plan_key", "tree_key", "children")


@query(
    "s7_tree_cache",
    Q.with_(*_NODES, select="""SELECT benchmark, count(DISTINCT plan_key) * 3 AS n_trees, count(*) * 3 AS n_nodes,
      count(DISTINCT plan_key) FILTER (plan_key LIKE '%3' OR plan_key LIKE '%7') * 3 AS n_computed FROM nodes GROUP BY 1"""),
)
def _(spark, folder):
    """Two runs over one cache: the second has new plans and changed texts, and computes those only."""
    root = scratch_path(spark, "trees")
    # Generated, so that the condition below reads a text instead of building it at each mention.
    files = P.corpus(plan_files(spark, folder)).select("file_name", F.explode_outer(F.array("text")).alias("text"))
    files = files.withColumn("plan_key", F.split_part("file_name", F.lit("_plan"), F.lit(1)))
    files = files.withColumn("benchmark", F.split_part("file_name", F.lit("_"), F.lit(1)))
    files = materialize(files.where(P.optimized_section(F.col("text")).isNotNull()))
    changed = F.when(F.col("plan_key").endswith("3"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))

    def build(missing):
        return swapped_trees(spark, folder, missing)

    cached_trees(files.where(~F.col("plan_key").endswith("7")), root, build, "copies=2", "first")
    trees = cached_trees(files.withColumn("text", changed), root, build, "copies=2", "second")
    return trees.groupBy("benchmark").agg(
        F.count("*").alias("n_trees"),
        F.sum(F.size("children")).alias("n_nodes"),
        F.count_if(F.col("run") == "second").alias("n_computed"),
    )


_J5 = r"""q AS (SELECT DISTINCT benchmark, query_id, regexp_replace(query_id, '^sf\d+_', '') AS base FROM accepted),
keys AS (SELECT DISTINCT CASE o_custkey % 6 WHEN 0 THEN 'tpch_0_q' WHEN 1 THEN 'tpcds_q' WHEN 2 THEN 'ssb_Q2.' WHEN 3 THEN 'ssb_q3' ELSE 'job_' END
    || cast(o_custkey % 45 AS varchar) || CASE WHEN o_custkey % 6 >= 4 THEN 'a' ELSE '' END AS plan_key FROM orders),
cands AS (
  SELECT benchmark, query_id, 1 AS choice, 'tpcds_q' || replace(substr(base, 6), '_', '') AS plan_key FROM q WHERE starts_with(base, 'query')
  UNION ALL SELECT benchmark, query_id, 4, 'ssb_Q' || regexp_extract(base, '^q(\d+)_(\d+)$', 1) || '.' || regexp_extract(base, '^q(\d+)_(\d+)$', 2) FROM q WHERE regexp_matches(base, '^q(\d+)_(\d+)$')
  UNION ALL SELECT benchmark, query_id, 5, 'ssb_q' || regexp_extract(base, '^q(\d+)_(\d+)$', 1) || regexp_extract(base, '^q(\d+)_(\d+)$', 2) FROM q WHERE regexp_matches(base, '^q(\d+)_(\d+)$')
  UNION ALL SELECT benchmark, query_id, 6, base FROM q WHERE starts_with(base, 'job_')
  UNION ALL SELECT benchmark, query_id, 7, 'tpch_0_' || base FROM q WHERE regexp_matches(base, '^q\d+$')
  UNION ALL SELECT benchmark, query_id, 8, 'tpcds_' || base FROM q WHERE regexp_matches(base, '^q\d+$')),
mapped AS (SELECT benchmark, query_id, arg_min(plan_key, choice) AS plan_key FROM cands WHERE plan_key IN (SELECT plan_key FROM keys) GROUP BY 1, 2)"""


def query_plan_map(spark, folder):
    n = F.col("o_custkey")
    name = (
        F.when(n % 6 == 0, "tpch_0_q").when(n % 6 == 1, "tpcds_q").when(n % 6 == 2, "ssb_Q2.").when(n % 6 == 3, "ssb_q3").otherwise("job_")
    )
    key = F.concat(name, (n % 45).cast("string"), F.when(n % 6 >= 4, "a").otherwise(""))
    keys = table(spark, folder, "orders").select(key.alias("plan_key")).distinct()
    return map_queries(query_ids(accepted(spark, folder)), keys)


@query(
    "j5_query_plan_mapping",
    Q.with_(Q.RAW, Q.ACCEPTED, _J5,
            select="SELECT benchmark, query_id, mapped.plan_key AS plan_key FROM q LEFT JOIN mapped USING (benchmark, query_id)"),
)
def _(spark, folder):
    return query_plan_map(spark, folder)


@query(
    "j5_unmapped_queries",
    Q.with_(Q.RAW, Q.ACCEPTED, _J5, select="SELECT benchmark, query_id FROM q ANTI JOIN mapped USING (benchmark, query_id)"),
)
def _(spark, folder):
    return query_plan_map(spark, folder).where("plan_key IS NULL").select(*QUERY)
