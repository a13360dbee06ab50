"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities: mail addresses, IP addresses, card and phone numbers. Each stands for
itself and for what it belongs to: the domain of an address, the network of an IP address, the digits of a
number but for the last four. So a text that is the only one with an address still tells something about the
words beside it, if other texts hold addresses of the same domain.

Corpus co-occurrence then tells which words give an entity away. With df the number of distinct texts,
P(e) = df(e) / N and P(e|t) = (df(e, t) + k P(e)) / (df(t) + k), a term t discloses of entity e the share

    log(P(e|t) / P(e)) / -log P(e)

of its information content: 1 if every text with the term holds the entity, 0 if the term says nothing.
The prior weight k keeps terms seen once or twice from looking certain. In every text that holds them, terms
above ``generalise_at`` are generalised and those above ``remove_at`` removed.

Entities and terms are counted, never listed: pairs come from the texts that hold an entity, merged before
they are sent, and df(t) is one partial aggregate over all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.skew import lookup
from lakewright.session import materialize

KINDS = ["email", "ip", "card", "phone", "term"]
# The given patterns. Possessive runs, and looking back for the start of a run, find the same matches
# without trying every place of a long run. \G: a mail address may begin where the one before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+"  # shorter runs could not pass the check of the digits
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}+"
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"
_FLAGS = "array<struct<term:string,score:double>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, value), counted in code points."""
    none = F.expr(f"CAST(array() AS {_SPANS})")

    def walk(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["gap"])
            end = start + F.length(pair["value"])
            span = F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value")
            )
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
        return F.when(F.size(found) == 0, none).otherwise(walked)

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), walk)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    number = F.concat(F.lit("0"), F.regexp_replace(part, "^0+", "")).try_cast("int")
    return F.coalesce(number <= 255, F.lit(False))


def base_spans(text: Column) -> Column:
    """Spans of the four given kinds, by kind, then start; matches that fail their check are dropped."""
    none = F.expr(f"CAST(array() AS {_SPANS})")

    def kind(place: int, hint: Column, pattern: str, valid) -> Column:
        return F.when(hint, F.filter(_matches(text, F.lit(pattern), place), lambda s: valid(s["value"]))).otherwise(none)

    return F.concat(
        kind(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        kind(1, text.rlike(r"[0-9]\.[0-9]"), IP, lambda v: F.forall(F.split(v, r"\."), _small)),
        kind(2, text.rlike("[0-9]{2}|[0-9][ -][0-9]"), CARD, lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v))),
        kind(3, F.contains(text, F.lit("+")), PHONE, lambda v: F.length(_digits(v)).between(8, 15)),
    )


def _entities(span: Column) -> Column:
    """What a span protects, whatever its writing: itself, and the domain, network or number range it is in."""
    digits = _digits(span["value"])
    whole = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(digits)
    range_of = (
        F.when(span["kind"] == 0, F.substring_index(F.lower(span["value"]), "@", -1))
        .when(span["kind"] == 1, F.substring_index(span["value"], ".", 3))
        .otherwise(F.left(digits, F.length(digits) - 4))
    )
    kind = span["kind"].cast("string")
    return F.array(F.concat(kind, F.lit(":"), whole), F.concat(kind, F.lit("*"), range_of))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _told(together: DataFrame, rows: DataFrame, texts: int, generalise_at: float, prior: float) -> DataFrame:
    """(entity, term, score) of the pairs from the threshold on."""
    words = rows.select("w", F.explode(_terms(F.col("text"))).alias("term"))
    holding = lookup(words, together.select("term").distinct(), ["term"], "inner")
    holding = holding.groupBy("term").agg(F.round(F.sum("w")).alias("with_term"))
    chance = F.col("with_entity") / float(max(texts, 1))
    given = (F.col("both") + prior * chance) / (F.col("with_term") + prior)
    told = together.join(holding, "term").withColumn(
        "score", F.when(chance < 1, F.log(given / chance) / -F.log(chance)).otherwise(F.lit(0.0))
    )
    return told.where(F.col("score") >= generalise_at).select("entity", "term", "score")


def disclosing_terms(keyed: DataFrame, found: DataFrame, generalise_at: float, min_support: int, prior: float) -> DataFrame:
    """(k1, k2, term, score): the terms of each text that disclose an entity, with their highest score."""
    copies = materialize(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")))
    # Each row of a text that n rows share counts 1 / n, so the sum counts distinct texts.
    shared = copies.where("copies > 1").select("k1", "k2", "copies")
    rows = lookup(keyed.select("k1", "k2", "text"), shared, ["k1", "k2"], "left")
    rows = rows.select("k1", "k2", "text", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("w"))
    spans = found.where("size(spans) > 0").select("k1", "k2", F.explode("spans").alias("s"))
    held = spans.select("k1", "k2", F.explode(_entities(F.col("s"))).alias("entity")).distinct()
    held = materialize(held)
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))
    entities = entities.where(F.col("with_entity") >= min_support)
    known = lookup(held, entities, ["entity"], "inner").groupBy("k1", "k2").agg(F.collect_set(F.struct("entity", "with_entity")).alias("e"))
    pairs = lookup(rows, known, ["k1", "k2"], "inner").select("w", F.explode("e").alias("e"), "text")
    pairs = pairs.select("w", "e.*", F.explode(_terms(F.regexp_replace("text", EMAIL, " "))).alias("term"))
    together = pairs.groupBy("entity", "term").agg(
        F.round(F.sum("w")).alias("both"), F.first("with_entity").alias("with_entity")
    )
    together = materialize(together.where(F.col("both") >= min_support))
    told = _told(together, rows, copies.count(), generalise_at, prior).groupBy("term").agg(F.max("score").alias("score"))
    words = rows.select("k1", "k2", F.explode(_terms(F.col("text"))).alias("term"))
    return lookup(words, told, ["term"], "inner").groupBy("k1", "k2", "term").agg(F.max("score").alias("score"))


def find(
    docs: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.9, min_support: int = 2, prior: float = 2.0
) -> DataFrame:
    """doc_id, text, spans (kind, start, end, label) of every row, by kind, then start.

    Starts and ends count code points, ends are exclusive. ``label`` is what the span becomes: a kind's
    name, ``[TERM]`` for a generalised and nothing for a removed term. Null texts are empty and have no
    spans. Copies of a text count once in the statistics and are treated alike; an entity or a pair in
    fewer than ``min_support`` distinct texts is no evidence. Terms inside another span are not listed.
    Texts of any length are searched whole; an empty table gives no row; other columns are neither read nor
    returned, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("k1", F.xxhash64("text"))
    keyed = keyed.withColumn("k2", F.xxhash64(F.lit(1), "text"))
    spotted = keyed.select("doc_id", "k1", "k2", "text", base_spans(F.col("text")).alias("spans"))
    found = materialize(spotted.select("doc_id", "k1", "k2", "spans"))
    flags = (
        disclosing_terms(keyed, found, generalise_at, min_support, prior)
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("term", "score")).alias("flags"))
    )
    rows = lookup(keyed, flags, ["k1", "k2"], "left").withColumn("spans", base_spans(F.col("text")))
    names = F.array_join(F.transform("flags", lambda f: f["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), names, F.lit(r")(?!\p{L})"))
    terms = F.when(F.coalesce(F.size("flags"), F.lit(0)) > 0, _matches(F.col("text"), pattern, 4))
    rows = rows.withColumn("terms", F.coalesce(terms, F.expr(f"CAST(array() AS {_SPANS})")))
    apart = "filter(terms, t -> NOT exists(spans, s -> s.start < t.end AND t.start < s.end))"
    score = "aggregate(flags, 0D, (a, f) -> IF(f.term = lower(s.value), f.score, a))"
    label = f"CASE WHEN s.kind < 4 THEN concat('[', upper(element_at(array('email', 'ip', 'card', 'phone'), s.kind + 1)), ']') WHEN {score} >= {remove_at} THEN '' ELSE '[TERM]' END"
    spans = f"transform(concat(spans, {apart}), s -> struct(s.kind AS kind, s.start AS start, s.end AS end, {label} AS label))"
    return rows.select("doc_id", "text", F.expr(spans).alias("spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id, text of the rows of ``find`` with each span replaced by its label.

    Where spans of different kinds overlap, the earlier start decides and the later one loses its label.
    """
    ordered = "array_sort(transform(spans, s -> struct(CAST(s.start AS int) AS start, CAST(s.end AS int) AS end, s.label AS label)))"
    step = (
        "(a, s) -> named_struct('at', greatest(a.at, s.end), 'out', IF(s.start < a.at, a.out, "
        "concat(a.out, array(substr(text, a.at + 1, s.start - a.at), s.label))))"
    )
    parts = f"aggregate({ordered}, named_struct('at', 0, 'out', CAST(array() AS array<string>)), {step}, a -> concat(a.out, array(substr(text, a.at + 1))))"
    return found.select("doc_id", F.expr(f"array_join({parts}, '')").alias("text"))
