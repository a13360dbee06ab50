"""Plan nodes to numeric vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import MATCH_SHARE, PREFIX_TABLES
from lakewright.operators import histograms as H
from lakewright.operators.skew import lookup, split_scan
from lakewright.operators.trees import _flat, _lists, children
from lakewright.session import materialize

KINDS = ["scan", "join", "project", "agg", "sort"]
HEAD = 4  # numbers of a vector before its lists


def operator_ids(plans: DataFrame) -> DataFrame:
    """(operator, op_id): ids by first appearance in plan and node order; Dummy comes last."""
    listed = plans.select("plan_key", F.transform("nodes", lambda n: n["operator"]).alias("operators"))
    seen = listed.mapInArrow(_first_seen, "plan_key string, node_id int, operator string")
    first = seen.groupBy("operator").agg(F.min(F.struct("plan_key", "node_id")).alias("f"))
    # Written first: ranges are drawn from the rows before they are sent, which would read every plan twice.
    first = materialize(first.select("operator", "f.plan_key", "f.node_id"))
    ranked = split_scan(first, [], ["plan_key", "node_id"], out="op_id")
    return ranked.select("operator", "op_id")


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first node of each operator of a batch, so that few rows are sorted for the least one of all."""
    for batch in batches:
        keys, (operators, begin) = batch.column(0), _flat(batch.column(1))
        if not len(operators):
            continue
        # Nodes in the order of their plans' keys; the last one written of an operator is its first from behind.
        ranks = pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
        order = np.argsort(ranks, kind="stable")
        sizes = np.diff(begin)[order]
        node = np.arange(len(operators)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = np.repeat(order, sizes)
        if ranks.max() < len(keys):  # plans of one key
            merged = np.lexsort((node, ranks[rows]))
            node, rows = node[merged], rows[merged]
        at = begin[rows] + node
        named = operators.dictionary_encode(null_encoding="encode")
        first = np.empty(len(named.dictionary), np.int64)
        first[named.indices.to_numpy(zero_copy_only=False)[at[::-1]]] = np.arange(len(at))[::-1]
        columns = [keys.take(pa.array(rows[first])), pa.array(node[first], pa.int32()), operators.take(pa.array(at[first]))]
        yield pa.RecordBatch.from_arrays(columns, ["plan_key", "node_id", "operator"])


def scan_tables(plans: DataFrame) -> DataFrame:
    return plans.select(F.explode_outer(F.transform("nodes", lambda n: n["table"])).alias("table_name")).where("table_name <> ''").distinct()


def known_columns(relations: DataFrame) -> DataFrame:
    """(benchmark, column, table_name): first table of a benchmark that lists the column."""
    bench = F.substring_index("table_name", "_", 1)
    return relations.groupBy(bench.alias("benchmark"), "column").agg(F.min("table_name").alias("table_name"))


def column_magnitudes(relations: DataFrame, rows: dict[str, dict[str, int]]) -> DataFrame:
    """(name, magnitude): digits of the table's row count for each known ``table.column``.

    ``rows`` has the row counts of each benchmark's tables; a table without one counts as one row.
    """
    counts = {f"{b}_{t}": n for b, tables in rows.items() for t, n in tables.items()}
    n_rows = F.coalesce(F.try_element_at(S.literal_map(counts), F.col("table_name")), F.lit(1))
    return relations.select(
        F.concat("table_name", F.lit("."), "column").alias("name"), S.digit_count(n_rows).alias("magnitude")
    )


def _as_map(df: DataFrame, key: Column, value: Column) -> Column:
    """A catalog table as one map value. Only for tables of the schema: their size is that of
    the tables' columns, operators or histograms, not of the data."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def prefix_table(benchmark: Column, column: Column) -> Column:
    maps = F.create_map(
        *[x for b, m in PREFIX_TABLES.items() for x in (F.lit(b), S.literal_map(m))]
    )
    chosen = F.coalesce(F.try_element_at(maps, benchmark), S.literal_map(PREFIX_TABLES["job"]))
    return F.try_element_at(chosen, F.substring_index(column, "_", 1))


def resolve(benchmark: Column, columns: Column, known: Column) -> Column:
    """Column names as ``benchmark_table.column``; names without a table are left out.

    The prefix decides; an unknown prefix is searched in the columns seen in relations.
    """

    def one(name: Column) -> Column:
        by_prefix = F.concat(benchmark, F.lit("_"), prefix_table(benchmark, name))
        owner = F.coalesce(by_prefix, F.try_element_at(known, F.concat(benchmark, F.lit("."), name)))
        return F.when(F.contains(name, F.lit("_")), F.concat(owner, F.lit("."), name))

    return F.filter(F.transform(columns, one), lambda c: c.isNotNull())


def node_vectors(plans: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``vectors``: per node the resolved column lists, predicate, limit and height."""
    seen = _as_map(known, F.concat("benchmark", F.lit("."), "column"), F.col("table_name"))

    def join_names(keys: Column) -> Column:
        return F.when(F.contains(F.get(keys, F.lit(0)), F.lit(".")), keys).otherwise(resolve(F.col("benchmark"), keys, F.col("_seen")))

    def vector(pair: Column) -> Column:
        n, keys = pair["nodes"], pair["join_keys"]
        bench, names = F.col("benchmark"), F.col("_seen")
        return F.struct(
            n["operator"].alias("operator"),
            n["limit"].alias("limit"),
            resolve(bench, n["scan_cols"], names).alias("scan"),
            join_names(keys).alias("join"),
            resolve(bench, n["project_cols"], names).alias("project"),
            resolve(bench, n["agg_cols"], names).alias("agg"),
            resolve(bench, n["sort_cols"], names).alias("sort"),
            n["pred"].alias("pred"),
            n["negated"].alias("negated"),
            (n["depth"] + 1).alias("height"),
        )

    return (
        plans.withColumn("_seen", seen)
        .withColumn("vectors", F.transform(F.arrays_zip("nodes", "join_keys"), vector))
        .drop("_seen")
    )


def list_widths(plans: DataFrame) -> DataFrame:
    """Longest list per kind and benchmark, from the lists or from ``widths`` of each plan."""
    if "widths" in plans.columns:
        return plans.groupBy("benchmark").agg(*[F.max(F.get("widths", F.lit(i))).alias(f"w_{k}") for i, k in enumerate(KINDS)])

    def longest(kind: str) -> Column:
        return F.max(F.array_max(F.transform(f"vectors.{kind}", F.size))).alias(f"w_{kind}")

    return plans.groupBy("benchmark").agg(*[longest(k) for k in KINDS])


_WHOLE_END = r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z"
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_DAY = re.compile(rf"([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_WHOLE_END}")
_CONTROL = "".join(map(chr, range(33)))


def _literal(text: str) -> tuple[float | None, str]:
    """Number or day of a text as ``scalars.parse_literal``, and the text that is compared otherwise."""
    trimmed = text.strip(" ")
    end = trimmed[-1:]
    if "0" <= end <= "9" or end == ".":
        number = trimmed.lstrip(_CONTROL)
        if _NUMBER.fullmatch(number):
            return float(number), text
    day = _DAY.match(trimmed)
    if day:
        try:
            return float(np.datetime64(f"{day[1]}-{int(day[2]):02d}-{int(day[3]):02d}", "D").astype(np.int64)), text
        except ValueError:
            pass
    return None, trimmed


_OPS = {
    "<": (lambda b, x: b < x, lambda low, high, x: high <= x),
    "<=": (lambda b, x: b <= x, lambda low, high, x: high <= x),
    ">": (lambda b, x: b > x, lambda low, high, x: low >= x),
    ">=": (lambda b, x: b >= x, lambda low, high, x: low >= x),
    "=": (lambda b, x: b == x, lambda low, high, x: low <= x <= high),
}


def _share(buckets: list, op: str, values: list[str]) -> float:
    """``histograms.selectivity``: summed height of the matching buckets over every value."""
    total = 0.0
    if op not in _OPS:
        return total
    point, ranged = _OPS[op]
    for text in values:
        number, word = _literal(text)
        # The height of a value is summed alone, as there.
        height = 0.0
        for low, high, num, name, share, low_text, high_text in buckets:
            if low_text is not None:
                hit = high_text is not None and ranged(low_text, high_text, word)
            elif low is not None:
                hit = number is not None and high is not None and ranged(low, high, number)
            elif number is not None:
                hit = num is not None and point(num, number)
            else:
                hit = name is not None and point(name, word)
            if hit:
                height += share
        total += height
    return total


def predicate_rows(
    atoms: Iterator[tuple[str, str, str, list[str], bool]], buckets: dict[str, list], rows: dict[str, dict[str, int]]
) -> list[float]:
    """Estimated rows of predicate atoms (benchmark, column, op, values, negated); ``rows`` as from the tables of a benchmark."""
    counts = {f"{b}|{p}": rows[b][t] for b, m in PREFIX_TABLES.items() for p, t in m.items() if t in rows.get(b, {})}
    out = []
    for benchmark, column, op, values, negated in atoms:
        known = counts.get(f"{benchmark}|{column.split('_', 1)[0]}")
        total = float(1 if known is None else known)
        if op == "":
            kept = float(known or 0)
        elif op in H.PATTERN_OPS:
            kept = total * MATCH_SHARE
        elif any("#" in v for v in values):
            kept = total
        else:
            found = buckets.get(column)
            kept = 0.0 if found is None else _share(found, "=" if op == "IN" else op, values) * total
        out.append(total - kept if negated else kept)
    return out


def _numbers(names: pa.Array, values: dict[str, int]) -> np.ndarray:
    """Value of each name, NaN for those without one."""
    at = pc.index_in(names, pa.array(list(values), pa.string()))
    return pa.array(list(values.values()), pa.float64()).take(at).to_numpy(zero_copy_only=False)


def flat_features(
    plans: DataFrame,
    operators: DataFrame,
    magnitudes: DataFrame,
    hist: DataFrame,
    rows: dict[str, dict[str, int]],
) -> DataFrame:
    """(plan_key, benchmark, features, children): one numeric vector per node.

    Layout: operator id, digits of the limit, estimated rows, logic flag (1 AND, 2 OR), then the
    magnitudes of scan, join, project, aggregate and sort columns, each list padded to the
    longest one of its benchmark. Operators, magnitudes and histograms are as large as the schema.
    """
    ids = {r.operator: r.op_id for r in operators.collect()}
    sizes = {r.name: r.magnitude for r in magnitudes.collect()}
    fields = ("lo", "hi", "num", "text", "height", "lo_text", "hi_text")
    buckets = {r.column: [tuple(b[f] for f in fields) for b in r.buckets] for r in hist.collect()}

    def flat(vectors: pa.Array, benchmark: pa.Array, *widths: pa.Array) -> pa.Array:
        nodes, begin = _flat(vectors)
        of = dict(zip((f.name for f in nodes.type), nodes.flatten()))
        plan = np.repeat(np.arange(len(vectors)), np.diff(begin))
        wide = np.stack([pc.fill_null(w, 0).to_numpy(zero_copy_only=False) for w in widths]).astype(np.int64)
        starts = HEAD + np.concatenate([np.zeros((1, len(vectors)), np.int64), np.cumsum(wide, axis=0)])
        offsets = np.concatenate([[0], np.cumsum(starts[-1][plan])])
        out, at = np.zeros(offsets[-1]), offsets[:-1]
        operator = of["operator"]
        op_ids = _numbers(operator, ids)
        unknown = at[np.isnan(op_ids)]
        out[at] = op_ids
        out[at + 1] = np.maximum(pc.utf8_length(pc.fill_null(of["limit"], 0).cast(pa.string())).to_numpy(zero_copy_only=False), 1)
        preds = of["pred"]
        held = np.flatnonzero(preds.is_valid().to_numpy(zero_copy_only=False))
        columns, ops, values = preds.take(pa.array(held)).flatten()
        texts, first = _flat(values)
        texts, ends = texts.to_numpy(zero_copy_only=False).tolist(), first.tolist()
        parts = [p.to_numpy(zero_copy_only=False) for p in (benchmark, columns, ops, of["negated"])]
        listed = (texts[i:j] for i, j in zip(ends, ends[1:]))
        parts = zip(parts[0][plan[held]], parts[1], parts[2], listed, parts[3][held].tolist())
        out[at[held] + 2] = predicate_rows(parts, buckets, rows)
        out[at + 3] = pc.equal(operator, "AND").cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[at[pc.equal(operator, "OR").to_numpy(zero_copy_only=False)] + 3] = 2.0
        for kind, start, width in zip(KINDS, starts, wide):
            names, first = _flat(of[kind])
            node = np.repeat(np.arange(len(nodes)), np.diff(first))
            place = np.arange(len(names)) - np.repeat(first[:-1], np.diff(first))
            fits = place < width[plan[node]]
            node, place = node[fits], place[fits]
            out[at[node] + start[plan[node]] + place] = np.nan_to_num(_numbers(names, sizes)[fits])
        mask = None
        if len(unknown):
            mask = np.zeros(len(out), bool)
            mask[unknown] = True
        return _lists(begin, _lists(offsets, pa.array(out, mask=mask)))

    widths = list_widths(plans)
    features = F.arrow_udf(flat, "array<array<double>>")("vectors", "benchmark", *[f"w_{k}" for k in KINDS])
    staged = lookup(plans, widths, ["benchmark"])
    return staged.select("plan_key", "benchmark", features.alias("features"), children().alias("children"))


def _padded(vectors: pa.Array, wide: int) -> pa.Array:
    """Vectors with ``wide`` entries: cut on the right or filled with zeros."""
    nodes, begin = _flat(vectors)
    values, first = _flat(nodes)
    place = np.arange(len(values)) - np.repeat(first[:-1], np.diff(first))
    fits = place < wide
    at = (np.repeat(np.arange(len(nodes)), np.diff(first)) * wide + place)[fits]
    out = np.zeros(len(nodes) * wide)
    kept = values.filter(pa.array(fits))
    out[at] = pc.fill_null(kept, 0.0).to_numpy(zero_copy_only=False)
    mask = None
    if kept.null_count:
        mask = np.zeros(len(out), bool)
        mask[at] = kept.is_null().to_numpy(zero_copy_only=False)
    return _lists(begin, _lists(np.arange(len(nodes) + 1) * wide, pa.array(out, mask=mask)))


def common_width(features: DataFrame) -> DataFrame:
    """Vectors of all benchmarks zero-padded to the widest one."""
    # Read at once: a subquery over Arrow batches inside Arrow batches cannot be sent to the tasks.
    width = features.agg(F.max(F.size(F.get("features", F.lit(0))))).first()[0] or 0
    padded = F.arrow_udf(lambda vectors: _padded(vectors, width), "array<array<double>>")
    return features.withColumn("features", padded("features"))


def _fixed(vectors: pa.Array, digits: int) -> pa.Array:
    """``scalars.fixed_point`` of the vectors of each row: halves are rounded away from zero."""
    nodes, begin = _flat(vectors)
    values, first = _flat(nodes)
    if values.null_count:  # a missing entry is left out
        kept = np.cumsum(np.concatenate([[0], values.is_valid().to_numpy(zero_copy_only=False)]))
        values, first = values.drop_null(), kept[first]
    scaled = values.to_numpy(zero_copy_only=False) * float(10**digits)
    whole = np.trunc(scaled)
    rounded = whole + np.where(np.abs(scaled - whole) >= 0.5, np.copysign(1.0, scaled), 0.0)
    text = pc.cast(pc.cast(pa.array(rounded), pa.int64()), pa.string())
    joined = pc.binary_join(_lists(first, text), ",")
    if nodes.null_count:
        joined = pc.if_else(nodes.is_valid(), joined, pa.scalar(None, pa.string()))
    return _lists(begin, joined)


def fixed_points(vectors: Column, digits: int = 4) -> Column:
    """``scalars.fixed_point`` of a list of vectors, in Arrow batches."""
    return F.arrow_udf(lambda rows: _fixed(rows, digits), "array<string>")(vectors)


def one_hot_nodes(plans: DataFrame, operators: DataFrame, tables: DataFrame) -> DataFrame:
    """(plan_key, node_id, encoding): operator slot, table number of scans, dummy flag."""
    ids = _as_map(operators, F.col("operator"), F.col("op_id"))
    numbered = split_scan(tables, [], ["table_name"], out="t")
    table_no = _as_map(numbered, F.col("table_name"), F.col("t") + 1)
    n_ops = operators.agg(F.count("*").cast("int")).scalar()
    rows = plans.select("plan_key", F.posexplode_outer("nodes").alias("node_id", "n"))
    staged = rows.withColumn("_ids", ids).withColumn("_t", table_no).withColumn("_k", n_ops)
    hot = S.one_hot(F.try_element_at("_ids", F.col("n.operator")).cast("int"), F.col("_k"))
    table_slot = F.coalesce(F.try_element_at("_t", F.col("n.table")), F.lit(0)).cast("double")
    return staged.select("plan_key", "node_id", F.concat(hot, F.array(table_slot, F.lit(0.0))).alias("encoding"))
