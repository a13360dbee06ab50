"""Plan texts to node vectors in Arrow batches.

The operators of ``plan_lines``, ``trees`` and ``features`` one after the other over the plans of a batch:
section, lines, nodes, join keys, parents and vectors. As array lambdas they are interpreted for every node.
Patterns match what they match there: letters, digits and blanks of ASCII, and no dot for an end of line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions.catalog import PREFIX_TABLES
from lakewright.operators import plan_lines as P
from lakewright.operators.features import KINDS
from lakewright.operators.trees import _parents

CHUNK = 2000  # plans whose nodes are held as objects at a time
SCAN, JOIN, PROJECT, AGG, SORT = range(len(KINDS))
_END = "\n\r\x85\u2028\u2029"
_ANY = f"[^{_END}]"
_LAST = rf"(?=(?:\r\n|[{_END}])?\Z)"


def _re(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, re.ASCII | flags)


_LIST = _re(rf"\[({_ANY}*?)\]")
_CATALOG = _re(rf"\] *(?:\w+\.)*(\w+){_LAST}")
_PLAIN = _re(r"^Relation (?:\w+\.)*(\w+)\[")
_JOIN_KIND, _JOIN_KEY, _LIMIT, _REF = _re(r"^Join (\w+)"), _re(P._KEY), _re(r"Limit (\d+)"), _re(r"(\w+)#")
_LINE = _re(r"^([ :]*)(\+- |- )(([^ \[\n]*)[^\n]*)", re.MULTILINE)
# The steps of ``P.clean_predicate``, beginning with letters where they can, which are searched fast.
_PRUNING = _re(r"\s*AND dynamicpruning\w*#\d+ \[[^\]]*\]")
_NULL_TEST = _re(r"is(?<!\wis)(?:not)?null\(")
_OVERFLOW = _re(rf"(>=|<=|=|<|>) CheckOverflow\({_ANY}*?(\w+#\d+L?){_ANY}*?DecimalType\(\d+,\d+\)(?:, (?:true|false))?\)")
_CAST = _re(r"cast\(([^()]*) as \w+(?:\(\d+,\d+\))?\)")
_FOLD = _re(r"\b(?:avg|sum|min|max)\(([^()]*)\)")
_PART, _FIRST = _re(r"substring\((\w+#\d+L?),[^()]*\)"), _re(r"coalesce\((\w+#\d+L?),[^()]*\)")
_CASE, _WHEN = _re(r"\bTHEN\b.*?\bEND\b", re.DOTALL), _re(r"\bCASE WHEN\b")
_IN, _CALL = _re(r"\bIN \(([^()]*)\)"), _re(r"\b(StartsWith|EndsWith|Contains)\(([^(),]+), ([^()]*)\)")
# What ends a run of other text in ``P._TOKEN``; every choice begins with a letter of its own, which is searched fast.
_CUT = _re(
    r"(\(|\)|A(?<!\wA)ND(?= (?:\(|NOT |exists|\S*\w#))|O(?<!\wO)R(?= (?:\(|NOT |exists|\S*\w#))|N(?<!\wN)OT(?= (?:\(|exists|\w+#)))"
)
_IN_ATOM = _re(rf"^({_ANY}*?) IN \[({_ANY}*)\]{_LAST}")
_PATTERN_ATOM = _re(rf"^({_ANY}*?) ({P._PATTERN}) ({_ANY}*){_LAST}")

_PRED = pa.struct([("col", pa.string()), ("op", pa.string()), ("values", pa.list_(pa.string()))])
VECTORS = (
    "array<struct<operator:string,limit:int,scan:array<string>,join:array<string>,project:array<string>,agg:array<string>,"
    "sort:array<string>,pred:struct<col:string,op:string,values:array<string>>,negated:boolean,height:int>>"
)


def section(text: str | None) -> str | None:
    """``P.optimized_section``."""
    if text is None:
        return None
    for mark in ("===", "=="):
        head, tail = f"{mark} Optimized Logical Plan {mark}\n", f"\n{mark} Physical Plan {mark}"
        at = text.find(head)
        end = text.find(tail, at + len(head)) if at >= 0 else -1
        if end >= 0:
            return text[at + len(head) : end].strip(P._BLANK)
    return None


def lines(text: str) -> list[tuple[int, str, str]]:
    """Depth, body and word of the lines of a section, as ``P.plan_lines``."""
    first, _, rest = text.partition("\n")
    bare = first.lstrip(" :")
    body = bare[3:] if bare.startswith("+- ") else bare[2:] if bare.startswith("- ") else first
    found = [(0, body, body.split(" ", 1)[0].split("[", 1)[0])]
    for indent, mark, body, word in _LINE.findall(rest):
        cut = len(indent) if mark == "+- " else max(len(indent) - 1, 0)
        found.append((cut // 3 + 1, body, word))
    return found


def _lists(body: str) -> list[str]:
    """The first two bracketed lists of a line."""
    if not body.isascii() or "\r" in body:
        return _LIST.findall(body)[:2]
    found: list[str] = []
    end = -1
    while len(found) < 2:
        begin = body.find("[", end + 1)
        end = body.find("]", begin + 1) if begin >= 0 else -1
        if end < 0:
            break
        found.append(body[begin + 1 : end])
    return found


def _listed(body: str) -> str:
    found = _lists(body)
    return found[0] if found else ""


def _names(listed: str) -> list[str]:
    return [c.split("#", 1)[0].strip(" ") for c in listed.split(",")]


def _group(found: re.Match | None) -> str:
    return found[1] if found else ""


def tokens(condition: str) -> list[str]:
    """``P._tokens`` without blanks: the text cleaned, without CASE, lists and calls protected, and cut."""
    if "AND dynamicpruning" in condition:
        condition = _PRUNING.sub("", condition)
    if "null(" in condition:
        condition = _NULL_TEST.sub("(", condition)
    if " CheckOverflow(" in condition:
        condition = _OVERFLOW.sub(r"\1 \2", condition)
    if "cast(" in condition:
        condition = _CAST.sub(r"\1", condition)
    if "avg(" in condition or "sum(" in condition or "min(" in condition or "max(" in condition:
        condition = _FOLD.sub(r"\1", condition)
    if "substring(" in condition:
        condition = _PART.sub(r"\1", condition)
    if "coalesce(" in condition:
        condition = _FIRST.sub(r"\1", condition)
    if "CASE WHEN " in condition:
        condition = _WHEN.sub("", _CASE.sub("", condition))
    if "IN (" in condition:
        condition = _IN.sub(r"IN [\1]", condition)
    if "With(" in condition or "Contains(" in condition:
        condition = _CALL.sub(r"\2 \1 \3", condition)
    return [t for piece in _CUT.split(condition) if (t := piece.strip(" "))]


def nest(tokens: list[str]) -> list[tuple[int, str, str | None, bool]]:
    """Nodes of one condition, as ``P._nodes_of_tokens`` finds them.

    Levels count from the group at hand: a logical group that ends moves its nodes one level down and comes before them.
    """
    out: list[tuple[int, str, str | None, bool]] = []
    outer: list[tuple[int, bool, bool, int, bool]] = []
    start, negated, has_or, since, has_and, before = 0, False, False, 0, False, ""
    for token in tokens:
        if token == "(":
            outer.append((start, negated, has_or, since, has_and))
            start = since = len(out)
            negated, has_or, has_and = before == "NOT", False, False
        elif token == "AND":
            has_and = True
        elif token == ")" or token == "OR":
            if has_and:
                out[since:] = [(0, "AND", None, False), *[(level + 1, k, t, n) for level, k, t, n in out[since:]]]
                has_and = False
            if token == "OR":
                has_or, since = True, len(out)
            elif not outer:
                break
            else:
                if has_or:
                    out[start:] = [(0, "OR", None, negated), *[(level + 1, k, t, n) for level, k, t, n in out[start:]]]
                elif negated:
                    out[start:] = [(level, k, t, n ^ (level == 0)) for level, k, t, n in out[start:]]
                start, negated, has_or, since, has_and = outer.pop()
        elif token != "NOT" and ("#" in token or "exists" in token):
            out.append((0, "exist" if "exists" in token else "Predicate", token, before == "NOT"))
        before = token
    else:
        if not outer:
            if has_and:
                out[since:] = [(0, "AND", None, False), *[(level + 1, k, t, n) for level, k, t, n in out[since:]]]
            if has_or:
                out[:] = [(0, "OR", None, False), *[(level + 1, k, t, n) for level, k, t, n in out]]
            return out
    out = []  # a parenthesis without its other one
    P._nodes_of_tokens(P._by_precedence(tokens), out)
    return out


def atom(text: str) -> tuple[str, str, list[str]]:
    """``P.atom``."""
    found = _IN_ATOM.search(text) if " IN [" in text else None  # the text it looks for is searched much faster
    if found:
        return found[1].split("#", 1)[0].strip(" "), "IN", [v.strip(" ") for v in found[2].split(",")]
    found = _PATTERN_ATOM.search(text) if "LIKE " in text or "With " in text or "Contains " in text else None
    if found:
        return found[1].split("#", 1)[0].strip(" "), found[2], [found[3].strip(" ")]
    if "=" in text:
        op = ">=" if ">=" in text else "<=" if "<=" in text else ">" if ">" in text else "<" if "<" in text else "="
    else:
        op = ">" if ">" in text else "<" if "<" in text else ""
    if not op:
        return text.split("#", 1)[0].strip(" "), "", []
    before, _, rest = text.partition(op)
    return before.split("#", 1)[0].strip(" "), op, [rest.strip(" ")]


def _table(body: str) -> str:
    return _group((_CATALOG if body.startswith("RelationV2") else _PLAIN).search(body))


@lru_cache(256)
def _owners(benchmark: str) -> dict[str, str]:
    prefixes = PREFIX_TABLES.get(benchmark) or PREFIX_TABLES["job"]
    return {prefix: f"{benchmark}_{table}." for prefix, table in prefixes.items()}


def _resolved(benchmark: str, names: list[str], known: dict[str, str]) -> list[str]:
    """``features.resolve``."""
    owners, out = _owners(benchmark), []
    for name in names:
        prefix, mark, _ = name.partition("_")
        if mark:
            owner = owners.get(prefix)
            if owner is not None:
                out.append(owner + name)
            else:
                table = known.get(f"{benchmark}.{name}")
                if table is not None:
                    out.append(f"{table}.{name}")
    return out


class _Nodes:
    """Columns over the nodes of many plans; values that few nodes have stand beside the number of their node."""

    def __init__(self) -> None:
        self.depth: list[int] = []
        self.operator: list[str] = []
        self.sizes: list[int] = []  # nodes of each plan
        self.limits: list[tuple[int, int]] = []
        self.negated: list[int] = []
        self.named: list[tuple[list[int], list[int], list[str]]] = [([], [], []) for _ in KINDS]
        self.atoms: tuple[list[int], list[str], list[str], list[int], list[str]] = ([], [], [], [], [])

    def add(self, text: str, benchmark: str, known: dict[str, str]) -> None:
        """The plan of a section: ``P.plan_nodes``, ``P.with_join_keys`` and ``features.node_vectors``."""
        depths, operators, named = self.depth, self.operator, self.named
        at, cols, ops, counts, values = self.atoms
        begin = len(depths)
        scans: list[tuple[int, str, str]] = []
        joins: list[tuple[int, re.Match]] = []
        for depth, body, word in lines(text):
            if word == "Filter":
                predicate = nest(tokens(body.removeprefix("Filter ")))
                for level, kind, words, negated in predicate:
                    if words is not None:
                        col, op, vals = atom(words)
                        at.append(len(depths))
                        cols.append(col)
                        ops.append(op)
                        counts.append(len(vals))
                        values += vals
                    if negated:
                        self.negated.append(len(depths))
                    depths.append(depth + level)
                    operators.append(kind)
                if predicate:
                    continue
            operator, kind = word, -1
            if word == "RelationV2" or word == "Relation":
                operator, kind, listed = "Scan", SCAN, _listed(body)
                names = _names(listed)
                scans.append((len(depths), body, listed))
            elif word == "Project":
                kind, names = PROJECT, _names(_listed(body))
            elif word == "Aggregate":
                lists = _lists(body)
                if len(lists) >= 2:  # a global aggregate prints its output list only
                    kind, names = AGG, _names(lists[0])
            elif word == "Sort":
                kind, names = SORT, _REF.findall(body)
            elif word == "Join":
                operator = "Join " + _group(_JOIN_KIND.search(body))
            if operator.startswith("Join"):
                found = _JOIN_KEY.search(body)
                if found:
                    joins.append((len(depths), found))
            elif "Limit" in word:
                found = _LIMIT.search(body)
                if found and int(found[1]) < 1 << 31:
                    self.limits.append((len(depths), int(found[1])))
            if kind >= 0:
                names = _resolved(benchmark, names, known)
                named[kind][0].append(len(depths))
                named[kind][1].append(len(names))
                named[kind][2].extend(names)
            depths.append(depth)
            operators.append(operator)
        self.sizes.append(len(depths) - begin)
        if joins:
            refs = [(i, body, [c.strip(" ") for c in listed.split(",")]) for i, body, listed in scans]
            for i, found in joins:
                names = []
                for ref in found.groups():
                    owner = next((_table(body) for k, body, listed in refs if k > i and ref in listed), "")
                    name = ref.split("#", 1)[0]
                    names.append(f"{benchmark}_{owner}.{name}" if owner else name)
                if "." not in names[0]:
                    names = _resolved(benchmark, names, known)
                named[JOIN][0].append(i)
                named[JOIN][1].append(len(names))
                named[JOIN][2].extend(names)

    def arrays(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Vectors and parents of the plans, as lists over their nodes, and the longest list of each kind."""
        n = len(self.depth)
        depths, limits, negated = np.array(self.depth, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
        for i, limit in self.limits:
            limits[i] = limit
        negated[self.negated] = True
        at, cols, ops, counts, values = self.atoms
        places = np.zeros(n, np.int32)
        places[at] = np.arange(len(at))
        missing = np.ones(n, bool)
        missing[at] = False
        lists = pa.ListArray.from_arrays(_offsets(counts), pa.array(values, pa.string()))
        take = pa.array(places, mask=missing)
        atoms = [a.take(take) for a in (pa.array(cols, pa.string()), pa.array(ops, pa.string()), lists)]
        fields = {"operator": pa.array(self.operator, pa.string()), "limit": pa.array(limits)}
        begin = _offsets(self.sizes)
        first = begin.to_numpy()[:-1]  # a plan has a node at least
        widths = np.empty((len(first), len(KINDS)), np.int32)
        for k, (kind, (nodes, found, names)) in enumerate(zip(KINDS, self.named)):
            sizes = np.zeros(n, np.int64)
            sizes[nodes] = found
            widths[:, k] = np.maximum.reduceat(sizes, first)
            fields[kind] = pa.ListArray.from_arrays(_offsets(sizes), pa.array(names, pa.string()))
        fields["pred"] = pa.StructArray.from_arrays(atoms, fields=list(_PRED), mask=pa.array(missing))
        fields["negated"], fields["height"] = pa.array(negated), pa.array(depths + 1)
        vectors = pa.ListArray.from_arrays(begin, pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        parents = _parents(pa.ListArray.from_arrays(begin, pa.array(depths)))
        return vectors, parents, pa.ListArray.from_arrays(_offsets(np.full(len(first), len(KINDS))), pa.array(widths.ravel()))


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())


def plan_vectors(files: DataFrame, known: DataFrame) -> DataFrame:
    """(plan_key, benchmark, vectors, parents, widths) of plan files; ``widths`` has the longest list of each kind.

    ``known`` is ``features.known_columns``: its size is that of the columns of the schema.
    """
    tables = {f"{r.benchmark}.{r.column}": r.table_name for r in known.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                keys, benchmarks, texts = (c.to_pylist() for c in part.columns)
                kept = [(k, b, s) for k, b, s in zip(keys, benchmarks, map(section, texts)) if s is not None]
                if kept:
                    nodes = _Nodes()
                    for _, benchmark, text in kept:
                        nodes.add(text, benchmark, tables)
                    keys, benchmarks, _ = zip(*kept)
                    columns = [pa.array(keys, pa.string()), pa.array(benchmarks, pa.string()), *nodes.arrays()]
                    yield pa.RecordBatch.from_arrays(columns, ["plan_key", "benchmark", "vectors", "parents", "widths"])

    read = files.select(*P._keys(), F.col("text"))
    return read.mapInArrow(run, f"plan_key string, benchmark string, vectors {VECTORS}, parents array<int>, widths array<int>")
