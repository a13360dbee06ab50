"""Plan texts, vectors, features and embeddings in Arrow batches, against the operators on columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import features as X
from lakewright.operators import histograms as H
from lakewright.operators import plan_batches as B
from lakewright.operators import plan_lines as P
from lakewright.operators import treeconv as C
from lakewright.operators import trees as G
from lakewright.plans import plan_log
from lakewright.sources import derived

CONDITIONS = [
    "isnotnull(a_x#1)", "(a_x#1 >= 5.5)", "NOT (b_y#2L = X Y)", "c_z#3 IN (1, 2,x)", "NOT StartsWith(c_z#3, MED PL)",
    "o#4 LIKE %a%b%", "o#4 NOT LIKE a%", "(cast(d_t#5 as date) <= 1995-01-01)", "exists#9 []", "((e_e#6 < f_f#7))", "(isnull(a_x#1) OR x#2 <> 4)",
    "(avg(q#1) > CheckOverflow((1.2 * promote_precision(y#2)), DecimalType(14,7), true))", "substring(c_p#2, 1, 2) IN (25,27)",
    "(a#1 > coalesce(b#2L, 0))", "CASE WHEN (a#1 > 2) THEN ((b#2 * 3.0) > 1.0) ELSE false END", "(p#1 = 4-NOT SPECIFIED AND SALT)",
    "isnotnull(k#1) AND dynamicpruning#9 [k#1]", "(r#1 = a\r)", "(é#1 = ü AND ANDé#2 = 3)", "plain", "()", "isisnull(z#1)",
]
RELATIONAL = [
    "Join Inner, (cast(a_x#1 as bigint) = b_y#2L)", "Join LeftSemi", "Join Cross, (u#1 = v#2)", "JoinHint (a_x#1 = zz_q#9)", "Project [a_x#1, tag_q#2 AS n_m#3, plain#4]",
    "Project", "Aggregate [a_x#1], [a_x#1, sum(b#2) AS s_t#3]", "Aggregate [sum(b#2) AS s_t#3]", "Sort [a_x#1 ASC, tag_q#2 DESC], true",
    "GlobalLimit 21", "LocalLimit 99999999999", "RelationV2[a_x#1, tag_q#2] c.tpch_iceberg_10g.alpha", "Relation x.beta[b_y#2L,l_w#4] parquet",
    "Relation [c_k#5,c_v#6] parquet", "Window [x[1]#2], [y]", "Union", "RelationV2[a\r_x#1] c.gamma\r",
]


def _condition(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(CONDITIONS)
    kind = rng.choice([" AND ", " OR "])
    text = f"({kind.join(_condition(rng, depth - 1) for _ in range(rng.choice([2, 2, 3])))})"
    text = rng.choice([text, text, f"({text})", f"NOT {text}", f"NOT ({text})", text[:-1], text + ")", f"f{text}"])
    return text


def _plan(rng):
    body = lambda: "Filter " + _condition(rng, rng.randrange(4)) if rng.random() < 0.4 else rng.choice(RELATIONAL)
    lines = [rng.choice(["", "", "+- ", ":- "]) + body()]
    lines += [rng.choice(["   ", ":  ", "  "]) * rng.randrange(4) + rng.choice(["+- ", ":- ", ":- ", "- ", "+-", ""]) + body() for _ in range(rng.randrange(9))]
    mark = rng.choice(["==", "==", "==="])
    tail = rng.choice([f"\n{mark} Physical Plan {mark}\nx", f"\n\n{mark} Physical Plan {mark}\nx", "\nnothing"])
    return f"{rng.choice(['', 'head'])}{mark} Optimized Logical Plan {mark}\n" + "\n".join(lines) + tail


def test_batches_find_what_the_columns_find(spark):
    rng = random.Random(8)
    texts = [_plan(rng) for _ in range(1500)] + [None, "", "== Optimized Logical Plan ==\n\n== Physical Plan ==\n"]
    names = [f"{rng.choice(['tpch', 'job', 'ssb', 'else'])}_{i}_plan.txt" for i in range(len(texts))]
    files = spark.createDataFrame(list(zip(names, texts)), "file_name string, text string")
    known = spark.createDataFrame([("tpch", "tag_q", "tpch_extra"), ("", "tag_q", "x")], "benchmark string, column string, table_name string")
    plans = P.with_join_keys(P.plan_nodes(P.plan_lines(files)))
    wanted = X.node_vectors(G.with_paths(plans, F.transform("nodes", lambda n: n["depth"])), known)
    wanted = {r.plan_key: r for r in wanted.select("plan_key", "benchmark", "vectors", "parents").collect()}
    got = B.plan_vectors(files, known)
    rows = got.collect()
    assert len(rows) == len(wanted) > 900
    for r in rows:
        assert r.vectors == wanted[r.plan_key].vectors, texts[names.index(f"{r.plan_key}_plan.txt")]
        assert (r.benchmark, r.parents) == (wanted[r.plan_key].benchmark, wanted[r.plan_key].parents)
    widths = X.list_widths(got.drop("widths"))
    assert sorted(map(tuple, X.list_widths(got).collect())) == sorted(map(tuple, widths.collect()))


def test_conditions_nest_alike():
    rng = random.Random(5)
    for _ in range(4000):
        tokens = [rng.choice(["(", "(", ")", ")", "AND", "OR", "NOT", "a#1", "exists", "word"]) for _ in range(rng.randrange(1, 14))]
        wanted = []
        P._nodes_of_tokens(P._by_precedence(tokens), wanted)
        assert B.nest(tokens) == wanted, tokens


def test_shares_of_literals(spark):
    rng = random.Random(2)
    texts = ["5", " 5 ", "+5.", ".5", "1e2", "1d", "0x1A", "NaN", "1_0", "1995-01-15", "1995-1-1", "1995-02-30", "0000-01-01", "a", "b b", "", " a ", "٣5", "\t7", "5-"]
    ranges = [(i * 2.5, i * 2.5 + 2.5, None, None, 0.1 + i / 97, None, None) for i in range(5)]
    kinds = {
        "ranges": ranges,
        "points": [(None, None, float(i), None, 0.1 + i / 89, None, None) for i in range(9)] + [(None, None, None, "a", 0.3, None, None)],
        "words": [(None, None, None, None, 0.4, "a", "b"), (None, None, None, None, 0.6, "b b", "z")],
    }
    bucket = "array<struct<lo:double,hi:double,num:double,text:string,height:double,lo_text:string,hi_text:string>>"
    rows = [(k, rng.choice(["=", "<", "<=", ">", ">=", "NOT LIKE"]), [rng.choice(texts) for _ in range(rng.choice([1, 1, 2]))]) for k in kinds for _ in range(120)]
    df = spark.createDataFrame([(*r, kinds[r[0]]) for r in rows], f"kind string, op string, vals array<string>, buckets {bucket}")
    df = df.withColumn("share", H.selectivity(F.col("buckets"), F.col("op"), F.col("vals")))
    for r in df.collect():
        assert X._share(kinds[r.kind], r.op, r.vals) == r.share, r


def test_features_by_hand(spark):
    vectors = [
        ("AND", 0, [], [], [], [], [], None, False, 1),
        ("Predicate", 0, [], [], [], [], [], ("o_x", "", []), True, 2),
        ("Predicate", 0, [], [], [], [], [], ("o_x", "LIKE", ["a"]), False, 2),
        ("Predicate", 0, [], [], [], [], [], ("q", "=", ["b#2"]), False, 2),
        ("Predicate", 0, [], [], [], [], [], ("o_n", "IN", ["1", "3"]), False, 2),
        ("Limit", 125, ["t.a", "t.none"], ["t.b"], [], [], [], None, False, 3),
        ("OR", 0, ["t.b"], [], [], [], [], None, False, 3),
    ]
    plans = [("p", "tpch", vectors, [None, 0, 0, 0, 0, 0, 1]), ("q", "job", vectors[:1], [None])]
    df = spark.createDataFrame(plans, f"plan_key string, benchmark string, vectors {B.VECTORS}, parents array<int>")
    ids = spark.createDataFrame([("AND", 4), ("Predicate", 1), ("Limit", 2), ("OR", 3)], "operator string, op_id bigint")
    sizes = spark.createDataFrame([("t.a", 7), ("t.b", 5)], "name string, magnitude int")
    bucket = "array<struct<lo:double,hi:double,num:double,text:string,height:double,lo_text:string,hi_text:string>>"
    hist = spark.createDataFrame([("o_n", [(None, None, float(i), None, 0.25, None, None) for i in range(4)])], f"column string, buckets {bucket}")
    got = {r.plan_key: r for r in X.flat_features(df, ids, sizes, hist, {"tpch": {"orders": 200}}).collect()}
    assert got["q"].features == [[4.0, 1.0, 0.0, 1.0]] and got["q"].children == [[]]
    assert got["p"].children == [[1, 2, 3, 4, 5], [6], [], [], [], [], []]
    head = [[4, 1, 0, 1], [1, 1, 0, 0], [1, 1, 20, 0], [1, 1, 1, 0], [1, 1, 100, 0]]
    assert got["p"].features == [*[h + [0, 0, 0] for h in head], [2, 3, 0, 0, 7, 0, 5], [3, 1, 0, 2, 5, 0, 0]]
    wide = {r.plan_key: r.features for r in X.common_width(X.flat_features(df, ids, sizes, hist, {})).collect()}
    assert wide["q"] == [[4.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0]]


def test_fixed_points(spark):
    rng = random.Random(4)
    values = [[rng.uniform(-9, 9) for _ in range(5)], [0.00005, -0.00005, 0.00004999, 2.5e-5, -0.0], [], [1e12, None, 3.0]]
    df = spark.createDataFrame([([*values, None],), ([],)], "v array<array<double>>")
    df = df.select(X.fixed_points(F.col("v")).alias("a"), F.transform("v", lambda v: S.fixed_point(v)).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_first_operators(spark):
    rng = random.Random(6)
    plans = [(f"p{rng.randrange(40):02d}", [(rng.choice("abcdef"),) for _ in range(rng.randrange(5))]) for _ in range(90)]
    plans += [("a", [("f",), ("g",)]), ("a", [("h",), ("f",), ("i",), ("i",)]), ("a", [("f",), ("f",), ("f",), ("g",), ("k",), ("h",)])]
    df = spark.createDataFrame(plans, "plan_key string, nodes array<struct<operator:string>>").coalesce(1)
    rows = pa.RecordBatch.from_arrays([pa.array([k for k, _ in plans]), pa.array([[o for o, in n] for _, n in plans])], ["k", "o"])
    first = {}
    for key, nodes in plans:
        for i, (o,) in enumerate(nodes):
            first[o] = min(first.get(o, (key, i)), (key, i))
    (found,) = X._first_seen(iter([rows]))
    assert {o: (k, i) for k, i, o in zip(*(c.to_pylist() for c in found.columns))} == first
    first = {o: f for o, f in first.items() if sum(f == g for g in first.values()) == 1}  # any order is right for the others
    ids = {r.operator: r.op_id for r in X.operator_ids(df).collect()}
    assert sorted(first, key=first.get) == sorted(first, key=ids.get)


def test_parents_of_children(spark):
    data = [([0, 1, 2, 2, 1, 3, 2],), ([0],), ([0, 0, 1, 5],)]
    df = G.with_paths(spark.createDataFrame(data, "d array<int>").withColumn("plan_key", F.lit("p")), F.col("d"))
    df = df.withColumn("kids", G.children()).withColumn("back", G.parents_of("kids"))
    assert all(r.back == r.parents for r in df.collect())


@pytest.mark.parametrize("sizes", [[9, 7, 8], [9, 5, 6, 8], [9, 8]])
def test_variants_share_what_is_not_swapped(spark, sizes):
    """Copies of a plan are convolved once where their children are the same, and every slice is as before."""
    rng = np.random.default_rng(7)
    layers = C.seeded_layers([3 * 3, *sizes[1:-1], 4 * 3])
    kids = [[1, 4], [2, 3], [], [], [5, 6, 7], [], [8], [], []]
    swapped = [[4, 1], *kids[1:]]
    features = rng.normal(size=(9, 3))
    trees = [("a", features, kids), ("a1", features, kids), ("a2", features, swapped), ("b", rng.normal(size=(9, 3)), kids)]
    values, begin = np.concatenate([t[1] for t in trees]), [0, 9, 18, 27, 36]
    rows, pairs, roots = C._forest(values, begin, [t[2] for t in trees])
    assert len(rows) == 9 + 0 + 1 + 9 and roots[0] == roots[1] != roots[2]
    schema = "plan_key string, features array<array<double>>, children array<array<int>>"
    df = spark.createDataFrame([(k, f.tolist(), c) for k, f, c in trees], schema).coalesce(1)
    got = {r.plan_key: r.embedding for r in C.plan_embeddings(df, layers, 4).collect()}

    def slow(node, x, below):
        if not below[node]:
            return np.tile(x[node], (4, 1))
        parts = [slow(k, x, below) if isinstance(k, int) else k for k in below[node]]
        while len(parts) > 2:
            parts[-2:] = [mixed(np.zeros(3), parts[-2], parts[-1])]
        return mixed(x[node], parts[0], parts[1] if len(parts) > 1 else np.zeros((4, 3)))

    def mixed(own, left, right):
        return np.stack([C.mlp(np.concatenate([own, left[k], right[k]])[None], layers)[0][3 * k : 3 * k + 3] for k in range(4)])

    for key, x, below in trees:
        assert np.allclose(got[key], slow(0, x, below).ravel())
    with pytest.raises(Exception, match="entries in one forest"):
        C.plan_embeddings(spark.createDataFrame([("x", [[1.0], [1.0, 2.0]], [[1], []])], schema), layers).collect()


def test_plan_texts_are_those_of_the_marks(spark, tmp_path):
    orders = [(i, i * 7, f"{i}-URGENT") for i in range(40)] + [(None, 1, "a"), (1, None, "a"), (2, 3, None), (3, 4, "@D@ @K@"), (-5, 6, "b")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    wanted = spark.read.parquet(str(tmp_path / "orders.parquet")).selectExpr(*derived._select(derived.PLAN_COLUMNS))
    got = derived.plan_files(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_features_come_from_batches(spark, folder):
    """No array lambda parses, resolves or pads; the vectors are written once and the features by those who read them twice."""
    plan = plan_log.plan_features(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "regexp" not in plan
    texts = pa.array(["x", None]).to_pylist()
    assert [B.section(t) for t in texts] == [None, None]
