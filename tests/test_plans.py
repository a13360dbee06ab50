"""Predicates, plan nodes, trees, features and tree convolution."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import features as X
from lakewright.operators import plan_lines as P
from lakewright.operators import trees as G
from lakewright.operators.mapping import map_queries
from lakewright.operators.treeconv import Layer, binary, convolve, mlp, plan_embeddings, seeded_layers
from lakewright.plans import plan_log
from lakewright.plans.registry import QUERIES
from lakewright.sources.text_files import capture_plan, plan_table, read_logs, read_texts
from lakewright.sources.tree_cache import cached_trees, load_trees


def nodes_of(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(P.predicate_nodes(F.col("t")).alias("n")).first().n
    atoms = spark.createDataFrame([(r.text,) for r in rows], "t string").select(P.atom(F.col("t")).alias("a")).collect()
    out = []
    for r, a in zip(rows, atoms):
        out.append((r.level, r.kind if r.text is None else (a.a.col, a.a.op, *a.a["values"]), r.negated))
    return out


def test_binary_and_or(spark):
    got = nodes_of(spark, "((isnotnull(a#1) AND (a#1 >= 5)) AND ((b#2L = X) OR (c#3 <= 1995-01-01)))")
    assert got == [
        (0, "AND", False), (1, "AND", False), (2, ("a", ""), False), (2, ("a", ">=", "5"), False),
        (1, "OR", False), (2, ("b", "=", "X"), False), (2, ("c", "<=", "1995-01-01"), False),
    ]


def test_negation_is_kept(spark):
    got = nodes_of(spark, "((NOT (p_brand#30 = Brand#32) AND NOT StartsWith(p_type#31, MEDIUM PLATED)) AND NOT o#1 LIKE %x%y%)")
    assert got == [
        (0, "AND", False), (1, "AND", False), (2, ("p_brand", "=", "Brand#32"), True),
        (2, ("p_type", "StartsWith", "MEDIUM PLATED"), True), (1, ("o", "LIKE", "%x%y%"), True),
    ]
    assert nodes_of(spark, "NOT ((a#1 = 1) OR (b#2 = 2))")[0] == (0, "OR", True)


def test_in_lists_stay_whole(spark):
    assert nodes_of(spark, "p_size#32L IN (21,2, 20)") == [(0, ("p_size", "IN", "21", "2", "20"), False)]
    assert nodes_of(spark, "(p#1 IN (SM CASE,SM BOX) OR (q#2 = 1))")[1] == (1, ("p", "IN", "SM CASE", "SM BOX"), False)


def test_connectives_inside_literals(spark):
    got = nodes_of(spark, "((a#1 = 4-NOT SPECIFIED) AND (b#2 = SALT AND PEPPER))")
    assert got == [(0, "AND", False), (1, ("a", "=", "4-NOT SPECIFIED"), False), (1, ("b", "=", "SALT AND PEPPER"), False)]


def test_wrappers_and_bare_columns(spark):
    assert nodes_of(spark, "isnotnull(s_suppkey#1)") == [(0, ("s_suppkey", ""), False)]
    got = nodes_of(spark, "(cast(l_shipdate#16 as date) >= 1995-04-01)")
    assert got == [(0, ("l_shipdate", ">=", "1995-04-01"), False)]
    assert nodes_of(spark, "(substring(c_phone#2, 1, 2) IN (25,27) AND (c#1 > scalar-subquery#3 []))")[1][1] == ("c_phone", "IN", "25", "27")
    assert nodes_of(spark, "(a#1 > coalesce(b#2L, 0))") == [(0, ("a", ">", "b#2L"), False)]


def test_case_and_decimal_forms(spark):
    got = nodes_of(spark, "(CASE WHEN (a#1 > 2) THEN ((b#2 * 3.0) > 1.0) ELSE false END AND (c#3 = 1))")
    assert got == [(0, "AND", False), (1, ("a", ">", "2"), False), (1, ("c", "=", "1"), False)]
    assert nodes_of(spark, "(x#1 > CheckOverflow((1.2 * promote_precision(y#2)), DecimalType(14,7), true))") == [(0, ("x", ">", "y#2"), False)]


def test_dynamic_pruning_is_dropped(spark):
    got = nodes_of(spark, "(isnotnull(a#1) AND dynamicpruning#9 [a#1])")
    assert got == [(0, ("a", ""), False)]


PLAN = """== Optimized Logical Plan ==
Join Inner, (cast(a_x#1 as bigint) = b_y#2L)
:- RelationV2[a_x#1, a_z#3] spark_catalog.tpch_iceberg_10g.alpha
:- Relation tpch_hudi_10g.beta[b_y#2L,b_w#4] parquet
+- Project [c_k#5]
   +- Relation [c_k#5,c_v#6] parquet

== Physical Plan ==
anything"""


@pytest.fixture(scope="module")
def plan(spark):
    files = spark.createDataFrame([("tpch_1_plan.txt", PLAN), ("tpch_2_plan.txt", "no sections"), ("notes.txt", PLAN)], "file_name string, text string")
    plans = P.with_join_keys(P.plan_nodes(P.plan_lines(P.corpus(files))))
    return G.with_paths(plans, F.transform("nodes", lambda n: n["depth"]))


def test_scan_forms_and_third_child(spark, plan):
    row = plan.collect()
    assert [r.plan_key for r in row] == ["tpch_1"]
    nodes = row[0].nodes
    assert [n.operator for n in nodes] == ["Join Inner", "Scan", "Scan", "Project", "Scan"]
    assert [n.table for n in nodes if n.operator == "Scan"] == ["alpha", "beta", ""]
    assert nodes[4].scan_cols == ["c_k", "c_v"]
    assert row[0].join_keys[0] == ["tpch_alpha.a_x", "tpch_beta.b_y"]
    sides = {r.node_id: r.side for r in G.parent_rows(plan).collect()}
    assert sides == {1: "left", 2: "right", 3: "extra", 4: "left"}


def test_column_resolution(spark):
    known = spark.createDataFrame([("tpch", "tag_x", "tpch_extra")], "benchmark string, column string, table_name string")
    df = spark.createDataFrame([("tpch", ["c_name", "tag_x", "zz_x", "plain", "_hidden"]), ("else", ["mii_id"])], "benchmark string, cols array<string>")
    seen = X._as_map(known, F.concat("benchmark", F.lit("."), "column"), F.col("table_name"))
    rows = df.withColumn("_s", seen).select(X.resolve(F.col("benchmark"), F.col("cols"), F.col("_s")).alias("r")).collect()
    assert [r.r for r in rows] == [["tpch_customer.c_name", "tpch_extra.tag_x"], ["else_movie_info_idx.mii_id"]]


@pytest.fixture(scope="module")
def random_trees(spark):
    rng = random.Random(3)
    data = []
    for t in range(30):
        depths = [0]
        while len(depths) < rng.randrange(1, 25):
            depths.append(rng.randrange(1, depths[-1] + 2))
        data.append((f"p{t:02d}", depths))
    df = spark.createDataFrame(data, "plan_key string, d array<int>")
    return data, G.with_paths(df, F.col("d"))


def parents_of(depths):
    return [max((j for j in range(i) if depths[j] == d - 1), default=None) for i, d in enumerate(depths)]


def test_parents_match_rule(random_trees):
    data, trees = random_trees
    got = {r.plan_key: r.parents for r in trees.collect()}
    assert got == {k: parents_of(d) for k, d in data}


def test_distances_match_shortest_paths(random_trees):
    data, trees = random_trees
    got = {(r.plan_key, r.node_id): r.hops for r in G.distances(trees).collect()}
    for key, depths in data:
        n = len(depths)
        dist = np.full((n, n), np.inf)
        np.fill_diagonal(dist, 0)
        for child, parent in enumerate(parents_of(depths)):
            if parent is not None:
                dist[child, parent] = dist[parent, child] = 1
        for k in range(n):
            dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
        ours = np.array([got[key, i] for i in range(n)], dtype=float)
        assert np.array_equal(ours, dist) and np.array_equal(ours, ours.T)


def test_augmentation_share_zero_is_identity(random_trees):
    _, trees = random_trees
    still = G.augment(trees, copies=2, share=0.0)
    base = {r.plan_key: r.children for r in still.where("copy = 0").collect()}
    assert all(r.children == base[r.plan_key] for r in still.collect())
    always = G.augment(trees, copies=1, share=1.1).where("copy = 1").collect()
    for r in always:
        for kids, own in zip(r.children, base[r.plan_key]):
            assert kids == (own[::-1] if len(own) == 2 else own)


def recursive_embedding(node, features, kids, layers, kernels):
    if not kids[node]:
        return np.tile(features[node], (kernels, 1))
    parts = [recursive_embedding(k, features, kids, layers, kernels) for k in kids[node]]
    left, right = parts[0], parts[1] if len(parts) > 1 else np.zeros_like(parts[0])
    width = features.shape[1]
    rows = []
    for k in range(kernels):
        out = mlp(np.concatenate([features[node], left[k], right[k]])[None, :], layers)[0]
        rows.append(out[k * width:(k + 1) * width])
    return np.stack(rows)


def test_tree_convolution_matches_recursion(spark):
    rng = np.random.default_rng(1)
    width, kernels = 3, 2
    layers = seeded_layers([3 * width, 5, kernels * width])
    kids = [[1, 4], [2, 3], [], [], [5], []]
    rows = []
    for t in range(5):
        rows.append((f"t{t}", rng.normal(size=(6, width)).tolist(), kids))
    df = spark.createDataFrame(rows, "plan_key string, features array<array<double>>, children array<array<int>>")
    got = {r.plan_key: r.embedding for r in plan_embeddings(df, layers, kernels).collect()}
    for key, features, _ in rows:
        expected = recursive_embedding(0, np.array(features), kids, layers, kernels).ravel()
        assert np.allclose(got[key], expected)


def test_tree_convolution_by_hand():
    # One linear layer summing [self, left, right] into both kernels.
    layers = [Layer(np.array([[1.0, 1.0], [10.0, 10.0], [100.0, 100.0]]), np.zeros(2))]
    out = convolve(np.array([[1.0], [2.0], [3.0]]), [[1, 2], [], []], layers, 2)
    assert out.tolist() == [[321.0, 321.0], [2.0, 2.0], [3.0, 3.0]]
    out = convolve(np.array([[1.0], [2.0]]), [[1], []], layers, 2)
    assert out[0].tolist() == [21.0, 21.0]


def test_query_mapping_strategies(spark):
    names = {
        "sf1_query14_a": "tpcds_q14a", "sf1_tpcds_q_07": "tpcds_q7", "sf10_db3": "tpch_1_db3", "sf10_db4": "tpch_0_q4",
        "sf1_q2_1": "ssb_Q2.1", "sf1_q3_2": "ssb_q32", "sf1_ssb_q9": "ssb_q9", "sf1_job_1a": "job_1a", "sf1_q5": "tpch_0_q5",
        "sf1_q6": "tpcds_q6", "sf1_tpch_gpt_q8": "tpch_gpt_q8", "sf1_other": None,
    }
    keys = [(v,) for v in names.values() if v] + [("tpcds_q5",), ("x_aug1",)]
    queries = spark.createDataFrame([("b", n) for n in names], "benchmark string, query_id string")
    got = {r.query_id: r.plan_key for r in map_queries(queries, spark.createDataFrame(keys, "plan_key string")).collect()}
    assert got == names


def test_live_plan_round_trip(spark, folder, tmp_path):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    df = lines.where("l_quantity > 5 AND l_returnflag IN ('A', 'R')").groupBy("l_returnflag").agg(F.sum("l_tax").alias("t"))
    assert "== Physical Plan ==" in capture_plan(df)
    files = plan_table(spark, {"tpch_live": df, "tpch_other": lines.select("l_tax")})
    nodes = P.plan_nodes(P.plan_lines(files)).where("plan_key = 'tpch_live'").first().nodes
    operators = [n.operator for n in nodes]
    assert operators[0] == "Aggregate" and operators[-1] == "Scan"
    assert "l_quantity" in nodes[-1].scan_cols
    assert any(n.pred and n.pred.op == "IN" and n.pred["values"] == ["A", "R"] for n in nodes)
    (tmp_path / "q_plan.txt").write_text(PLAN)
    (tmp_path / "train_a.log").write_text("one\ntwo\n")
    (tmp_path / "other.log").write_text("three\n")
    assert read_texts(spark, str(tmp_path), "*_plan.txt").first().text == PLAN
    assert read_logs(spark, str(tmp_path)).count() == 2


def test_tree_cache_computes_what_changed(spark, tmp_path):
    root, built = str(tmp_path / "trees"), []

    def run(texts, settings="s", label=""):
        def build(missing):
            rows = missing.select("benchmark", "plan_key", "text").collect()
            built.append(sorted(r.plan_key for r in rows))
            out = [(r.benchmark, r.plan_key, f"{r.plan_key}_{i}", len(r.text or "")) for r in rows for i in range(2)]
            return spark.createDataFrame(out, "benchmark string, plan_key string, tree_key string, n int")

        files = spark.createDataFrame([(b, k, t) for (b, k), t in texts.items()], "benchmark string, plan_key string, text string")
        got = cached_trees(files, root, build, settings, label).collect()
        assert {(r.benchmark, r.plan_key) for r in got} == set(texts) and len(got) == 2 * len(texts)
        assert all(r.n == len(texts[r.benchmark, r.plan_key] or "") for r in got)
        return built.pop() if built else []

    assert load_trees(spark, root) is None
    texts = {("a", "a_1"): "x", ("a", "a_2"): "yy", ("b", "b_1"): None, ("c", "c_1"): "zzzz"}
    assert run(texts) == ["a_1", "a_2", "b_1", "c_1"]
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "trees").glob("benchmark=*/*.parquet")}
    assert run(texts) == []
    texts["a", "a_2"] = "changed"
    assert run(texts, label="2") == ["a_2"]
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "trees").glob("benchmark=[bc]/*.parquet")}
    assert after.items() <= before.items()  # other benchmarks stay as they are
    texts["d", "d_1"] = "new"
    del texts["c", "c_1"], texts["a", "a_1"]
    assert run(texts) == ["d_1"]
    assert run(texts, settings="other") == sorted(k for _, k in texts)


def test_one_hot_and_digits(spark):
    row = spark.range(1).select(S.one_hot(F.lit(1), 3).alias("h"), S.digit_count(F.lit(15000)).alias("d")).first()
    assert row.h == [0.0, 1.0, 0.0] and row.d == 5


def test_every_leaf_reaches_the_root():
    """Nodes with three and more children: a change of any leaf changes the embedding of the root."""
    kids = [[1, 2, 3, 6], [], [], [4, 5], [], [], [7, 8, 9], [], [], []]
    rng = np.random.default_rng(2)
    features = rng.normal(size=(len(kids), 3))
    layers = seeded_layers([9, 16, 6])
    root = convolve(features, kids, layers, 2)[0]
    for leaf in (i for i, k in enumerate(kids) if not k):
        changed = features.copy()
        changed[leaf] += 1.0
        assert not np.allclose(convolve(changed, kids, layers, 2)[0], root), leaf


def test_line_trees_read_depths_only_and_distances_compare_no_paths(spark, folder, capsys):
    from lakewright.plans.plan_log import line_trees

    rows = G.distances(line_trees(spark, folder))
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "regexp_extract" not in plan and "array_intersect" not in plan


def test_distances_of_a_forest_with_gaps(spark):
    depths = {"one": [0], "two": [0, 1, 2, 1, 2, 2, 0, 1], "gap": [0, 2, 1, 2, 3, 5], "same": [0, 1, 2, 1, 2, 2, 0, 1]}
    df = spark.createDataFrame(list(depths.items()), "plan_key string, d array<int>")
    got = {(r.plan_key, r.node_id): r.hops for r in G.distances(G.with_paths(df, F.col("d"))).collect()}
    assert len(got) == sum(map(len, depths.values()))
    for key, levels in depths.items():
        up = [next((j for j in reversed(range(i)) if levels[j] == d - 1), None) for i, d in enumerate(levels)]
        near = [[0 if i == j else None for j in range(len(up))] for i in range(len(up))]
        for i, p in enumerate(up):
            for j in range(i):
                if p is not None and near[p][j] is not None:
                    near[i][j] = near[j][i] = near[p][j] + 1
        assert [got[key, i] for i in range(len(up))] == near


def test_tree_cache_writes_trees_once_and_compares_keys_in_one_join(spark, tmp_path, monkeypatch):
    from lakewright.sources import tree_cache

    written = []
    monkeypatch.setattr(tree_cache, "materialize", lambda df, real=tree_cache.materialize: written.append(df.columns) or real(df))

    def run(texts):
        files = spark.createDataFrame(texts, "benchmark string, plan_key string, text string")
        got = cached_trees(files, str(tmp_path / "trees"), lambda m: m.select("benchmark", "plan_key", F.length("text").alias("n")), "s")
        return sorted((r.benchmark, r.plan_key, r.n) for r in got.collect())

    assert run([("a b", "1", "x"), ("c", "2", "yy"), ("c", "3", "z")]) == [("a b", "1", 1), ("c", "2", 2), ("c", "3", 1)]
    assert len(written) == 1  # the keys asked for; the trees go to the cache alone
    written.clear()
    assert run([("a b", "1", "xxx"), ("c", "2", "yy"), ("d", "4", "w")]) == [("a b", "1", 3), ("c", "2", 2), ("d", "4", 1)]
    assert len(written) == 2
    assert run([("c", "2", "yy")]) == [("c", "2", 2)]


def test_binary_children():
    pairs, level = binary([[1, 2, 3, 4], [], [], [], [5], []])
    assert pairs == [[1, 7], [], [], [], [5], [], [3, 4], [2, 6]]
    assert level.tolist() == [4, 0, 0, 0, 1, 0, 2, 3]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("((a#1 = 1 AND b#2 = 2) OR c#3 = 3)", [(0, "OR"), (1, "AND"), (2, "a"), (2, "b"), (1, "c")]),
        ("(a#1 = 1 AND b#2 = 2 OR c#3 = 3)", [(0, "OR"), (1, "AND"), (2, "a"), (2, "b"), (1, "c")]),
        ("(a#1 = 1 OR b#2 = 2 AND NOT (c#3 = 3 OR d#4 = 4 AND e#5 = 5))",
         [(0, "OR"), (1, "a"), (1, "AND"), (2, "b"), (2, "NOT OR"), (3, "c"), (3, "AND"), (4, "d"), (4, "e")]),
        ("a#1 = 1 AND b#2 = 2", [(0, "AND"), (1, "a"), (1, "b")]),
        ("(a#1 = 1)", [(0, "a")]),
    ],
)
def test_and_binds_closer_than_or(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(P.predicate_nodes(F.col("t")).alias("n"))
    got = [(n.level, ("NOT " if n.negated else "") + (n.text.split("#")[0] if n.text else n.kind)) for n in df.first().n]
    assert got == expected


def test_wide_relations_are_captured_whole(spark):
    df = spark.range(3).select(*[(F.col("id") + i).alias(f"col_{i}") for i in range(40)])
    df.write.mode("overwrite").saveAsTable("wide_relation")
    try:
        text = capture_plan(spark.table("wide_relation").where("col_39 > 1"))
    finally:
        spark.sql("DROP TABLE wide_relation")
    assert "more fields" not in text and all(f"col_{i}#" in text for i in range(40))
    assert spark.conf.get("spark.sql.debug.maxToStringFields") == "25"


def test_a_plan_text_is_built_once(spark):
    """The condition on the section does not repeat the expression that builds the text."""
    text = F.concat(F.lit("== Optimized Logical Plan ==\nJoin @mark@"), F.col("id").cast("string"), F.lit("\n== Physical Plan ==\n"))
    files = spark.range(3).select(F.concat(F.lit("tpch_q"), F.col("id"), F.lit("_plan.txt")).alias("file_name"), text.alias("text"))
    files = files.union(files.withColumn("text", F.lit(None)))
    lines = P.plan_lines(files)
    assert sorted((r.plan_key, [l.body for l in r.lines]) for r in lines.collect()) == [(f"tpch_q{i}", [f"Join @mark@{i}"]) for i in range(3)]
    one = P.plan_lines(spark.range(3).select(F.lit("q_plan.txt").alias("file_name"), text.alias("text")))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("@mark@") == 1


def test_the_text_of_an_atom_is_built_once(spark):
    """Column, operator and values of an atom come from one look at its text."""
    rows = spark.range(1).select(P.atom(F.concat(F.lit("total#1 > @mark@"), F.col("id").cast("string"))).alias("a"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("@mark@") == 1
    assert rows.first().a.asDict() == {"col": "total", "op": ">", "values": ["@mark@0"]}


def _random_condition(rng, depth, level=0, negated=False):
    """Text of a random condition and its nodes as (level, kind, column, negated)."""
    if depth == 0 or rng.random() < 0.25:
        name = f"c{rng.randrange(99)}"
        text = rng.choice(["({}#1 = 2)", "{}#1 IN (1,2)", "(({}#1 > 3))", "StartsWith({}#1, x)"]).format(name)
        return ("NOT " if negated else "") + text, [(level, "Predicate", name, negated)]
    kind = rng.choice(["AND", "OR"])
    sides = [_random_condition(rng, depth - 1, level + 1, rng.random() < 0.2) for _ in range(2)]
    text = f"({sides[0][0]} {kind} {sides[1][0]})"
    text = f"({text})" if rng.random() < 0.3 else text
    return ("NOT " if negated else "") + text, [(level, kind, None, negated), *sides[0][1], *sides[1][1]]


def test_nested_predicates_of_whole_plans(spark):
    """Conditions of many plans keep their nodes apart, and no array lambda folds over their tokens."""
    rng = random.Random(3)
    made = [[_random_condition(rng, rng.randrange(4)) for _ in range(rng.randrange(4))] for _ in range(60)]
    plans = [("q%02d" % i, "tpch", [(0, "Project", "Project [x#1]"), *[(1, "Filter", f"Filter {t}") for t, _ in c]]) for i, c in enumerate(made)]
    lines = spark.createDataFrame(plans, "plan_key string, benchmark string, lines array<struct<depth:int,word:string,body:string>>")
    df = P.plan_nodes(lines.repartition(7))
    for row, conditions in zip(df.orderBy("plan_key").collect(), made):
        got = [(n.depth, n.operator, n.pred and n.pred.col, n.negated) for n in row.nodes]
        wanted = [(1 + level, *rest) for _, nodes in conditions for level, *rest in nodes]
        assert got == [(0, "Project", None, False), *wanted]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("_nest(") == 1
    empty = spark.createDataFrame([(None,), ("",), ("()",)], "t string").select(P.predicate_nodes(F.col("t")).alias("n"))
    assert [r.n for r in empty.collect()] == [[], [], []]


def test_lookups_of_a_plan_are_made_once(spark):
    """The owner of a join side is searched once, only scans list references, and a text is searched for relations once."""
    body = ["Join Inner, (a#1 = b#2L)", "RelationV2[a#1, c#3] x.tpch_iceberg_10g.t", "Relation z.u[b#2L,a#1] parquet", "Join Inner, (c#3 = d#4)"]
    lines = [(i, b.split(" ")[0].split("[")[0], b) for i, b in enumerate(body)]
    rows = spark.createDataFrame([("q", "tpch", lines)], "plan_key string, benchmark string, lines array<struct<depth:int,word:string,body:string>>")
    plans = P.with_join_keys(P.line_nodes(rows).drop("lines"))
    assert plans.first().join_keys == [["tpch_t.a", "tpch_u.b"], [], [], ["c", "d"]]
    assert plans._jdf.queryExecution().analyzed().toString().count("array_contains(") == 2
    texts = spark.createDataFrame([(" ".join(body),), (None,)], "text string")
    found = P.relation_columns(texts)
    assert sorted(map(tuple, found.collect())) == [("tpch_t", "a"), ("tpch_t", "c")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_tables_of_plans_hold_what_is_read(spark, folder, monkeypatch):
    """Plans written for several readers leave out lines, paths and the texts of their nodes."""
    written, write = [], plan_log.materialize
    monkeypatch.setattr(plan_log, "materialize", lambda df: written.append(df.schema) or write(df))
    for name in ("p21_list_padding", "t13_one_hot_operator"):
        assert QUERIES[name](spark, folder).count() > 0
    assert [s.names for s in written] == [["plan_key", "benchmark", "vectors"], ["plan_key", "benchmark", "nodes"]]
    assert written[1]["nodes"].dataType.elementType.names == ["operator", "table"]
