"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. The training texts are tokenised and the words of the benchmark counted in them. A window (``WINDOW``
   consecutive words of an item, or all words of a shorter item) with a word that never occurs is out.
2. The index: postings (text, term, place) of the rarest ``ANCHORS`` terms of every remaining window.
3. Query: a posting of the item's word q at place p lies on the offset p - q. Postings that share text,
   item and offset are the intersection of the offset-adjusted lists; a window all of whose rarest terms
   meet there is a candidate.
4. Candidates are compared in full with the words at their place.

The terms, the anchors and the windows are a table of the benchmark's size; they are broadcast below a
measured limit and joined by salted shuffles beyond it. Texts are never shuffled below that limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.skew import lookup
from lakewright.session import materialize

WINDOW = 10
ANCHORS = 2
CANDIDATE_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: runs of digits, a-z and characters outside ASCII."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # A sign in front makes the first part always empty; the last is empty if the text ends with one.
    parts = F.split(F.concat(F.lit(" "), low, F.lit(" ")), _SIGNS)
    return F.slice(parts, F.lit(2), F.size(parts) - 2)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_k1", F.xxhash64(text)).withColumn("_k2", F.xxhash64(F.lit(1), text))


def _windows(items: DataFrame, counts: DataFrame, size: int, anchors: int) -> DataFrame:
    """Windows that can occur: item, window start s, length n, hash of the words, rarest places."""
    spots = items.select("ik", F.posexplode("iw").alias("q", "term")).join(counts, "term", "left")
    spots = spots.groupBy("ik").agg(
        F.expr("transform(array_sort(collect_list(struct(q, coalesce(n, 0L) AS n))), x -> x.n)").alias("freq")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("iw") - size, F.lit(0)))
    rows = items.join(spots, "ik").select("ik", "item_id", "iw", "freq", F.explode(starts).alias("s"))
    rows = rows.withColumn("n", F.least(F.size("iw"), F.lit(size)))
    rows = rows.withColumn("f", F.expr("slice(freq, s + 1, n)")).where("array_min(f) > 0")
    rarest = F.expr(f"transform(slice(array_sort(transform(f, (x, i) -> struct(x, s + i AS q))), 1, {anchors}), x -> x.q)")
    phrase = F.concat_ws(" ", F.expr("slice(iw, s + 1, n)"))
    return rows.select(
        "ik", "item_id", "iw", "s", "n", rarest.alias("rarest"),
        F.xxhash64(phrase).alias("h1"), F.xxhash64(F.lit(1), phrase).alias("h2"),
    )


def _index(docs: DataFrame, benchmark: DataFrame, size: int, anchors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, anchor places, postings): what the benchmark asks for and the index of the texts."""
    items = benchmark.select("item_id", words(F.col("text")).alias("iw")).where("size(iw) > 0")
    items = materialize(items.withColumn("ik", F.xxhash64("item_id", "iw")).dropDuplicates(["ik"]))
    terms = items.select(F.explode("iw").alias("term")).distinct()
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counts = lookup(tokens, terms, ["term"], "inner").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    windows = materialize(_windows(items, materialize(counts), size, anchors))
    spots = windows.select("ik", "iw", F.explode("rarest").alias("q"))
    spots = spots.select("ik", "q", F.expr("iw[q]").alias("term")).distinct()
    places = _keyed(docs).select("_k1", "_k2", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    postings = lookup(places, spots.select("term").distinct(), ["term"], "inner")
    return windows, spots, materialize(postings)


def _meetings(postings: DataFrame, spots: DataFrame) -> DataFrame:
    """Postings on the items' words they stand for: text, item, item place q, offset."""
    return lookup(postings, spots, ["term"], "inner").select(
        "_k1", "_k2", "ik", "q", "pos", (F.col("pos") - F.col("q")).alias("offset")
    )


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """The rows of ``docs`` with columns n_words, n_hit, items (ids of items with an occurring window).

    A word inside any occurrence of a window is hit; n_hit counts such words. Null and wordless texts
    have no words; wordless items have no window. Items that share an id are one item; items without an
    id hit words but are not listed. Result columns replace columns of ``docs`` of the same name.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    docs = docs.select(F.struct(*kept).alias("_row"), "text")
    windows, spots, postings = _index(docs, benchmark, window, anchors)
    lists = _meetings(postings, spots).groupBy("_k1", "_k2", "ik", "offset").agg(F.collect_set("q").alias("held"))
    ready = windows.groupBy("ik").agg(
        F.collect_list(F.struct("item_id", "s", "n", "rarest", "h1", "h2")).alias("ws")  # windows of one item
    )
    met = "filter(ws, w -> size(array_except(w.rarest, held)) = 0 AND offset + w.s >= 0)"
    found = lookup(lists, ready, ["ik"], "inner").select("_k1", "_k2", "offset", F.explode(F.expr(met)).alias("w"))
    claims = found.groupBy("_k1", "_k2").agg(
        F.expr("collect_set(struct(w.item_id, offset + w.s AS at, w.n, w.h1, w.h2))").alias("_claims")
    )
    joined = lookup(_keyed(docs), claims, ["_k1", "_k2"], "left", limit_bytes=CANDIDATE_BYTES)
    phrase = "concat_ws(' ', slice(_words, c.at + 1, c.n))"
    true = f"c -> c.at + c.n <= size(_words) AND xxhash64({phrase}) = c.h1 AND xxhash64(1, {phrase}) = c.h2"
    checked = joined.withColumn("_words", words(F.col("text"))).select(
        "_row", F.size("_words").alias("n_words"),
        F.expr(f"filter(coalesce(_claims, array()), {true})").alias("_true"),
    )
    hit = "size(array_distinct(flatten(transform(_true, c -> sequence(c.at, c.at + c.n - 1)))))"
    ids = "array_distinct(filter(transform(_true, c -> c.item_id), x -> x IS NOT NULL))"
    return checked.select(
        "_row.*", F.col("n_words").cast("long"), F.expr(hit).cast("long").alias("n_hit"), F.expr(ids).alias("items")
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int, window: int = WINDOW, anchors: int = ANCHORS
) -> DataFrame:
    """doc_id, item_id, s: windows whose rarest ``anchors`` terms stand near each other as in the item.

    Each of them stands within ``slop`` words of the place that the rarest one's posting gives it; with
    slop 0 that is a phrase of those terms. The lists of one text and item meet in one row.
    """
    windows, spots, postings = _index(docs, benchmark, window, anchors)
    lists = _meetings(postings, spots).groupBy("_k1", "_k2", "ik").agg(
        F.collect_set(F.struct("q", "pos", "offset")).alias("held")
    )
    near = (
        "exists(held, a -> a.q = rarest[0] AND forall(rarest, r -> "
        f"exists(held, b -> b.q = r AND abs(b.offset - a.offset) <= {int(slop)})))"
    )
    found = lookup(lists, windows.select("ik", "item_id", "s", "rarest"), ["ik"], "inner").where(near)
    found = found.select("_k1", "_k2", "item_id", "s").distinct()
    return lookup(_keyed(docs).select("doc_id", "_k1", "_k2"), found, ["_k1", "_k2"], "inner").select(
        "doc_id", "item_id", "s"
    )
