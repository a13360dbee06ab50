"""Captured plan text to operator nodes.

A plan stays one row: its lines, nodes and predicates are arrays inside that row, so parsing a
log of any size needs no shuffle. Rows per node come from one ``posexplode_outer`` at the end: the
arrays are never empty, and the outer form keeps the optimizer from testing their size in a
filter below, which would compute them twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S

_LONG = 1 << 30
_COMPARE = [">=", "<=", ">", "<", "="]
_PATTERN = "StartsWith|EndsWith|Contains|NOT LIKE|LIKE"


def corpus(files: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Plan files of a benchmark, or all of them: names ending ``_plan.txt``."""
    kept = files.where(F.endswith("file_name", F.lit("_plan.txt")))
    if benchmark is not None:
        kept = kept.where(F.startswith("file_name", F.lit(benchmark)))
    return kept


_BLANK = " \n\t\r"


def optimized_section(text: Column) -> Column:
    """Text between the optimized and physical headings; the ``===`` dialect first."""

    def between(mark: str) -> Column:
        head, tail = f"{mark} Optimized Logical Plan {mark}\n", f"\n{mark} Physical Plan {mark}"
        after = F.substring(text, F.instr(text, head) + len(head), F.length(text))
        both = F.contains(text, F.lit(head)) & F.contains(after, F.lit(tail))
        return F.when(both, F.substring_index(after, tail, 1))

    return F.btrim(F.coalesce(between("==="), between("==")), F.lit(_BLANK))


def physical_section(text: Column) -> Column:
    head = "== Physical Plan ==\n"
    after = F.substring(text, F.instr(text, head) + len(head), F.length(text))
    return F.when(F.contains(text, F.lit(head)), F.btrim(after, F.lit(_BLANK)))


def _sections(files: DataFrame) -> DataFrame:
    # A condition on a generated column stays above it; on a plain one it would build the text and cut it again.
    section = F.explode_outer(F.array(optimized_section(F.col("text")))).alias("section")
    return files.select("file_name", section).where("section IS NOT NULL")


def _keys() -> list[Column]:
    return [F.substring_index("file_name", mark, 1).alias(name) for mark, name in (("_plan", "plan_key"), ("_", "benchmark"))]


def _depth(line: Column, rest: Column, i: Column) -> Column:
    """Level of a line whose text after the indentation is ``rest``; null if it is no plan line."""
    # The indentation consists of blanks and colons; ':-' loses its colon to the trim. A byte each.
    cut = F.octet_length(line) - F.octet_length(rest)
    indent = F.when(F.startswith(rest, F.lit("+- ")), cut).when(F.startswith(rest, F.lit("- ")), cut - 1)
    return F.when(i == 0, F.lit(0)).otherwise((indent / 3).cast("int") + 1)


def plan_lines(files: DataFrame) -> DataFrame:
    """(plan_key, benchmark, lines): depth, operator word and text of every plan line."""

    def parsed(line: Column, i: Column) -> Column:
        def split_line(rest: Column) -> Column:
            plus, minus = F.startswith(rest, F.lit("+- ")), F.startswith(rest, F.lit("- "))
            body = F.when(plus, F.substring(rest, 4, _LONG)).when(minus, F.substring(rest, 3, _LONG)).otherwise(line)
            word = F.substring_index(F.substring_index(body, " ", 1), "[", 1)
            return F.struct(_depth(line, rest, i).alias("depth"), word.alias("word"), body.alias("body"))

        return S.let(F.ltrim(line, F.lit(" :")), split_line)

    lines = F.filter(F.transform(F.split("section", "\n"), parsed), lambda s: s["depth"].isNotNull())
    return _sections(files).select(*_keys(), lines.alias("lines"))


def line_depths(files: DataFrame) -> DataFrame:
    """(plan_key, benchmark, depths): the depths of ``plan_lines`` alone."""

    def depth(line: Column, i: Column) -> Column:
        return S.let(F.ltrim(line, F.lit(" :")), lambda rest: _depth(line, rest, i))

    depths = F.filter(F.transform(F.split("section", "\n"), depth), lambda d: d.isNotNull())
    return _sections(files).select(*_keys(), depths.alias("depths"))


def _names(listed: Column) -> Column:
    """Column names of a comma list, without ids; aliased expressions keep their first name."""
    return F.transform(F.split(listed, ","), lambda c: F.trim(F.substring_index(c, "#", 1)))


def _first_list(body: Column) -> Column:
    return F.regexp_extract(body, r"\[(.*?)\]", 1)


def _list_count(body: Column) -> Column:
    return F.size(F.regexp_extract_all(body, F.lit(r"\[(.*?)\]"), F.lit(1)))


def scan_table(body: Column) -> Column:
    """Table of a scan line, in the catalog and the file form; empty when the line names none."""
    catalog = F.regexp_extract(body, r"\] *(?:\w+\.)*(\w+)$", 1)
    plain = F.regexp_extract(body, r"^Relation (?:\w+\.)*(\w+)\[", 1)
    return F.when(F.startswith(body, F.lit("RelationV2")), catalog).otherwise(plain)


def scan_refs(body: Column) -> Column:
    """Column references of a scan line, ids included."""
    return F.transform(F.split(_first_list(body), ","), lambda c: F.trim(c))


_KEY = r"\(\s*(?:cast\()?\s*(\w+#\d+L?)(?:\s+as\s+\w+\))?\s*=\s*(?:cast\()?\s*(\w+#\d+L?)(?:\s+as\s+\w+\))?\s*\)"


def join_refs(body: Column) -> Column:
    """Both sides of the first equality of a Join line."""
    return F.struct(
        F.regexp_extract(body, _KEY, 1).alias("left"), F.regexp_extract(body, _KEY, 2).alias("right")
    )


def clean_predicate(text: Column) -> Column:
    """Predicate text with null tests, casts and wrapping functions reduced to their column."""
    steps = [
        (r"\s*AND dynamicpruning\w*#\d+ \[[^\]]*\]", ""),
        (r"\b(?:isnotnull|isnull)\(", "("),
        (r"(>=|<=|=|<|>) CheckOverflow\(.*?(\w+#\d+L?).*?DecimalType\(\d+,\d+\)(?:, (?:true|false))?\)", "$1 $2"),
        (r"cast\(([^()]*) as \w+(?:\(\d+,\d+\))?\)", "$1"),
        (r"\b(?:avg|sum|min|max)\(([^()]*)\)", "$1"),
        (r"substring\((\w+#\d+L?),[^()]*\)", "$1"),
        (r"coalesce\((\w+#\d+L?),[^()]*\)", "$1"),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip_case(text: Column) -> Column:
    """CASE expressions reduced to their conditions."""
    conditions = F.regexp_replace(F.regexp_replace(text, r"(?s)\bTHEN\b.*?\bEND\b", ""), r"\bCASE WHEN\b", "")
    return F.when(F.contains(text, F.lit("CASE WHEN ")), conditions).otherwise(text)


def _protect(text: Column) -> Column:
    """IN lists in square brackets and pattern calls as infix operators, so that the remaining
    parentheses only group."""
    text = F.regexp_replace(text, r"\bIN \(([^()]*)\)", "IN [$1]")
    return F.regexp_replace(text, r"\b(StartsWith|EndsWith|Contains)\(([^(),]+), ([^()]*)\)", "$2 $1 $3")


# A connective counts only before an operand, so that the same word inside a literal does not.
_CONNECTIVE = r"\b(?:(?:AND|OR)(?= (?:\(|NOT |exists|\S*\w#))|NOT(?= (?:\(|exists|\w+#)))"
_TOKEN = rf"\(|\)|{_CONNECTIVE}|(?:(?!{_CONNECTIVE})[^()])+"


def predicate_nodes(condition: Column) -> Column:
    """Nested predicate of a Filter line as an array of (level, kind, text, negated), pre-order.

    Parentheses nest groups; a group with AND or OR directly inside is a logical node, any other
    group only wraps its content. Operands of a logical node become its children whether or not
    they have parentheses of their own. AND binds closer than OR: operands of AND between two ORs of
    a group are a group of their own.
    """
    return F.get(_nested(F.array(_tokens(condition))), F.lit(0))


def _tokens(condition: Column) -> Column:
    return F.regexp_extract_all(_protect(strip_case(clean_predicate(condition))), F.lit(_TOKEN), F.lit(0))


_NESTED = "array<array<struct<level:int,kind:string,text:string,negated:boolean>>>"


def _by_precedence(tokens: list[str]) -> list[str]:
    """Tokens with a second pair of parentheses in each group, closed and opened again at every OR."""
    out = ["("]
    for token in tokens:
        if token == "(" or token == ")":
            out += (token, token)
        elif token == "OR":
            out += (")", token, "(")
        else:
            out.append(token)
    out.append(")")
    return out


def _nodes_of_tokens(tokens: list[str], out: list[tuple[int, str, str | None, bool]]) -> None:
    """Append the nodes of one condition. A group is the position of its opening, -1 what is outside all."""
    open_, parents, ands, ors, entries = [-1], {}, set(), set(), []
    for i, token in enumerate(tokens):
        group = open_[-1]
        if token == "(":
            entries.append((i, token, group))
            parents[i] = group
            open_.append(i)
        elif token == ")":
            if len(open_) > 1:
                open_.pop()
        elif token == "AND":
            ands.add(group)
        elif token == "OR":
            ors.add(group)
        elif token != "NOT" and ("#" in token or "exists" in token):
            entries.append((i, token, group))
    # Of each group: logical groups around its content, NOTs before it and its wrappers inside the last of these.
    above = {-1: (1, 0) if -1 in ands or -1 in ors else (0, 0)}
    for group, parent in parents.items():
        level, nots = above[parent]
        if group in ands or group in ors:
            above[group] = (level + 1, 0)
        else:
            above[group] = (level, nots + (group > 0 and tokens[group - 1] == "NOT"))
    if above[-1][0]:
        out.append((0, "AND" if -1 in ands else "OR", None, False))
    for i, token, group in entries:
        level, nots = above[group]
        negated = (nots + (i > 0 and tokens[i - 1] == "NOT")) % 2 == 1
        if token != "(":
            out.append((level, "exist" if "exists" in token else "Predicate", token, negated))
        elif i in ands:
            out.append((level, "AND", None, negated))
        elif i in ors:
            out.append((level, "OR", None, negated))


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())


def _nest(plans: pa.Array) -> pa.Array:
    """Nodes of every condition of every plan of a batch, from their tokens; no tokens, no nodes."""
    conditions = plans.flatten()
    texts = conditions.flatten().to_numpy(zero_copy_only=False).tolist()
    nodes: list[tuple[int, str, str | None, bool]] = []
    sizes, at = [], 0
    for n in pc.fill_null(pc.list_value_length(conditions), 0).to_pylist():
        before = len(nodes)
        tokens = [t for t in (text.strip(" ") for text in texts[at : at + n]) if t]
        if tokens:
            _nodes_of_tokens(_by_precedence(tokens), nodes)
        sizes.append(len(nodes) - before)
        at += n
    columns = zip(*nodes) if nodes else ((), (), (), ())
    types = (pa.int32(), pa.string(), pa.string(), pa.bool_())
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["level", "kind", "text", "negated"])
    counts = pc.fill_null(pc.list_value_length(plans), 0).to_pylist()
    return pa.ListArray.from_arrays(_offsets(counts), pa.ListArray.from_arrays(_offsets(sizes), rows))


def _nested(tokens: Column) -> Column:
    """Tokens of a plan's conditions to their nodes. The fold over tokens runs in Arrow batches: as array lambdas
    it took six parts in seven of the time of a condition."""
    return F.arrow_udf(_nest, _NESTED)(tokens)


def atom(text: Column) -> Column:
    """Predicate text as (col, op, values): comparisons, IN list, pattern, or a bare column."""
    return S.let(text, _atom)


def _atom(text: Column) -> Column:
    cases: list[tuple[Column, Column, Column, Column]] = [
        (F.contains(text, F.lit(c)), F.lit(c), F.substring_index(text, c, 1), F.substring(text, F.instr(text, c) + len(c), F.length(text)))
        for c in _COMPARE
    ]
    in_list = r"^(.*?) IN \[(.*)\]$"
    pattern = rf"^(.*?) ({_PATTERN}) (.*)$"
    cases = [
        (text.rlike(in_list), F.lit("IN"), F.regexp_extract(text, in_list, 1), F.regexp_extract(text, in_list, 2)),
        (text.rlike(pattern), F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)),
        *cases,
    ]
    found = F.struct(F.lit("").alias("op"), text.alias("before"), F.lit("").alias("rest"))
    for test, name, left, right in reversed(cases):
        found = F.when(test, F.struct(name.alias("op"), left.alias("before"), right.alias("rest"))).otherwise(found)

    def parts(f: Column) -> Column:
        op, rest = f["op"], f["rest"]
        values = (
            F.when(op == "IN", F.transform(F.split(rest, ","), lambda v: F.trim(v)))
            .when(op == "", F.array().cast("array<string>"))
            .otherwise(F.array(F.trim(rest)))
        )
        return F.struct(F.trim(F.substring_index(f["before"], "#", 1)).alias("col"), op.alias("op"), values.alias("values"))

    return S.let(found, parts)


_NO_NAMES = "array<string>"


def _relational_node(line: Column) -> Column:
    word, body = line["word"], line["body"]
    none = F.array().cast(_NO_NAMES)
    is_scan = word.isin("RelationV2", "Relation")
    operator = (
        F.when(is_scan, "Scan")
        .when(word == "Join", F.concat(F.lit("Join "), F.regexp_extract(body, r"^Join (\w+)", 1)))
        .otherwise(word)
    )
    # A global aggregate prints its output list only, so it has no keys.
    keys = F.when((word == "Aggregate") & (_list_count(body) >= 2), _names(_first_list(body))).otherwise(none)
    limit = F.when(F.contains(word, F.lit("Limit")), F.regexp_extract(body, r"Limit (\d+)", 1).try_cast("int"))
    return F.struct(
        line["depth"].alias("depth"),
        operator.alias("operator"),
        body.alias("body"),
        F.when(is_scan, scan_table(body)).alias("table"),
        F.when(is_scan, _names(_first_list(body))).otherwise(none).alias("scan_cols"),
        F.when(word == "Project", _names(_first_list(body))).otherwise(none).alias("project_cols"),
        keys.alias("agg_cols"),
        F.when(word == "Sort", F.regexp_extract_all(body, F.lit(r"(\w+)#"), F.lit(1))).otherwise(none).alias("sort_cols"),
        F.coalesce(limit, F.lit(0)).alias("limit"),
        F.lit(None).cast("struct<col:string,op:string,values:array<string>>").alias("pred"),
        F.lit(False).alias("negated"),
    )


def line_nodes(lines: DataFrame) -> DataFrame:
    """Add ``nodes`` with one entry per plan line; Filter lines stay one node."""
    return lines.withColumn("nodes", F.transform("lines", _relational_node))


def _predicate_node(line: Column, p: Column) -> Column:
    none = F.array().cast(_NO_NAMES)
    return F.struct(
        (line["depth"] + p["level"]).alias("depth"),
        p["kind"].alias("operator"),
        F.coalesce(p["text"], F.lit("")).alias("body"),
        F.lit(None).cast("string").alias("table"),
        none.alias("scan_cols"),
        none.alias("project_cols"),
        none.alias("agg_cols"),
        none.alias("sort_cols"),
        F.lit(0).alias("limit"),
        F.when(p["text"].isNotNull(), atom(p["text"])).alias("pred"),
        p["negated"].alias("negated"),
    )


def plan_nodes(lines: DataFrame) -> DataFrame:
    """Add ``nodes``: one entry per operator, with every Filter line replaced by its predicate tree.

    The top of a predicate tree takes the place of the Filter, so the input of the Filter becomes
    a child of that node.
    """
    tokens = F.transform("lines", lambda l: F.when(l["word"] == "Filter", _tokens(F.regexp_replace(l["body"], r"^Filter ", ""))))

    def expand(line: Column, predicate: Column) -> Column:
        return F.when(
            F.size(predicate) > 0, F.transform(predicate, lambda p: _predicate_node(line, p))
        ).otherwise(F.array(_relational_node(line)))

    staged = lines.withColumn("filters", _nested(tokens))
    return staged.withColumn("nodes", F.flatten(F.zip_with("lines", "filters", expand))).drop("filters")


def with_join_keys(plans: DataFrame) -> DataFrame:
    """Add ``join_keys``: per node, the tables and columns of its first equality.

    Each side belongs to the first scan after the join that lists the column; without such a
    scan the bare column name stays.
    """
    def scan(n: Column, i: Column) -> Column:
        return F.when(n["operator"] == "Scan", F.struct(i.alias("i"), n["table"].alias("table"), scan_refs(n["body"]).alias("refs")))

    scans = F.filter(F.transform("nodes", scan), lambda s: s.isNotNull())

    def side(ref: Column, i: Column) -> Column:
        later = F.filter("_scans", lambda s: (s["i"] > i) & F.array_contains(s["refs"], ref))
        name = F.substring_index(ref, "#", 1)
        return S.let(
            F.get(later, F.lit(0))["table"],
            lambda owner: F.when(owner.isNotNull() & (owner != ""), F.concat("benchmark", F.lit("_"), owner, F.lit("."), name)).otherwise(name),
        )

    def keys(n: Column, i: Column) -> Column:
        none = F.array().cast(_NO_NAMES)

        def sides(refs: Column) -> Column:
            return F.when(refs["left"] != "", F.array(side(refs["left"], i), side(refs["right"], i))).otherwise(none)

        return F.when(F.startswith(n["operator"], F.lit("Join")), S.let(join_refs(n["body"]), sides)).otherwise(none)

    return plans.withColumn("_scans", scans).withColumn("join_keys", F.transform("nodes", keys)).drop("_scans")


def relation_columns(files: DataFrame) -> DataFrame:
    """Distinct (benchmark_table, column) of all ``RelationV2[...] catalog.db.table`` mentions."""
    pattern = r"RelationV2\[([^\]]*)\] ?((?:\w+\.)*)(\w+)"

    # The text is searched once; the parts of a mention come from the mention alone.
    def parts(mention: Column) -> Column:
        return F.struct(*[F.regexp_extract(mention, pattern, g).alias(name) for g, name in enumerate(("cols", "db", "name"), 1)])

    found = F.explode_outer(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), parts))
    bench = F.regexp_extract("m.db", r"(job|tpcds|ssb|tpch)_iceberg_10g", 1)
    return (
        files.select(found.alias("m"))
        .where("m IS NOT NULL")
        .select(F.concat(bench, F.lit("_"), F.col("m.name")).alias("table_name"), F.explode(_names(F.col("m.cols"))).alias("column"))
        .distinct()
    )


def with_table_prefix(plans: DataFrame, benchmarks: Sequence[str] = ("job", "ssb")) -> DataFrame:
    """Plans of these benchmarks with predicate columns under the initials of the table their filter reads.

    A filter reads a table where the next node after its predicates is a scan; other filters keep their
    columns. Columns of the other benchmarks carry their table's prefix already.
    """
    logic = ["AND", "OR", "Predicate"]

    def named(node: Column, i: Column) -> Column:
        below = F.get(F.filter(F.slice("nodes", i + 2, F.size("nodes")), lambda n: ~n["operator"].isin(logic)), F.lit(0))
        scanned = F.when(below["operator"] == "Scan", below["table"])
        prefix = F.concat(S.table_initials(scanned), F.lit("_"))
        column = F.coalesce(F.concat(prefix, node["pred"]["col"]), node["pred"]["col"])
        return F.when(node["pred"].isNotNull(), node.withField("pred.col", column)).otherwise(node)

    applies = F.col("benchmark").isin(*benchmarks)
    return plans.withColumn("nodes", F.when(applies, F.transform("nodes", named)).otherwise(F.col("nodes")))
