"""Column histograms: build, write and parse as text, and row estimates from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import MATCH_SHARE, PREFIX_TABLES
from lakewright.operators.skew import BROADCAST_BYTES, in_memory_bytes, lookup, split_scan
from lakewright.session import materialize
from lakewright.sources.tables import table

FEW_VALUES = 25
BUCKETS = 10
PATTERN_OPS = ["StartsWith", "EndsWith", "Contains", "LIKE"]


def column_counts(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """(column, value, number of rows), one pass over the table for all columns."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("num"), F.lit(None).cast("string").alias("text"))
        for c in numeric
    ] + [
        F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("text"))
        for c in text
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .where("num IS NOT NULL OR text IS NOT NULL")
        .groupBy("column", "num", "text")
        .agg(F.count("*").alias("w"))
    )


def build(counts: DataFrame, few_values: int = FEW_VALUES, buckets: int = BUCKETS) -> DataFrame:
    """One frequency bucket per value of columns with up to ``few_values`` values, else equal-height ranges.

    Range edges come from exact ranks, by number or by text (``lo_text``, ``hi_text``). A value held by
    many rows is one counted row here and may span several buckets. The switch by the number of values
    is the two bucket kinds of the text format; no column is left out.
    """
    # One row per profiled column.
    widths = counts.groupBy("column").agg(F.count("*").alias("n_values"), F.sum("w").alias("total"))
    tagged = counts.join(F.broadcast(widths), "column")
    whole = F.col("num") == F.floor("num")
    number = F.when(whole, F.col("num").cast("bigint").cast("string")).otherwise(F.col("num").cast("string"))
    points = tagged.where(F.col("n_values") <= few_values).select(
        "column",
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.coalesce("text", number).alias("value"),
        F.col("num").alias("avg"),
        (F.col("w") / F.col("total")).alias("height"),
        F.lit(False).alias("closed"),
        F.lit(None).cast("string").alias("lo_text"),
        F.lit(None).cast("string").alias("hi_text"),
    )
    wide = counts.join(F.broadcast(widths.where(F.col("n_values") > few_values).select("column")), "column")
    ranked = split_scan(wide, ["column"], ["num", "text"], F.col("w"), out="start", total="total")
    base, extra = F.floor(F.col("total") / buckets), F.col("total") % buckets

    def bucket_of(rank: Column) -> Column:
        head = extra * (base + 1)
        return F.when(rank < head, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - head) / base))

    def begin(bucket: Column) -> Column:
        return bucket * base + F.least(bucket, extra)

    end = F.col("start") + F.col("w")
    spread = ranked.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("start")), bucket_of(end - 1))))
    share = F.least(end, begin(F.col("bucket") + 1)) - F.greatest(F.col("start"), begin(F.col("bucket")))
    ranges = (
        spread.withColumn("share", share)
        .groupBy("column", "bucket", "total")
        .agg(
            F.min("num").alias("lo"),
            F.max("num").alias("hi"),
            F.min("text").alias("lo_text"),
            F.max("text").alias("hi_text"),
            F.sum(F.col("num") * F.col("share")).alias("s"),
            F.sum("share").alias("k"),
        )
        .select(
            "column", "lo", "hi", F.lit(None).cast("string").alias("value"), (F.col("s") / F.col("k")).alias("avg"),
            (F.col("k") / F.col("total")).alias("height"), (F.col("bucket") == buckets - 1).alias("closed"),
            "lo_text", "hi_text",
        )
    )
    return points.unionByName(ranges)


def to_text(hist: DataFrame) -> DataFrame:
    """(column, text): the histogram of a column in its text form."""
    edge = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    low, high = F.coalesce(edge("lo"), quoted("lo_text")), F.coalesce(edge("hi"), quoted("hi_text"))
    head = F.when(low.isNull(), F.concat(F.lit("    "), F.col("value"))).otherwise(
        F.concat(F.lit("    ["), low, F.lit(", "), high, F.when(F.col("closed"), "]").otherwise(")"))
    )
    average = F.coalesce(F.col("avg").cast("decimal(18,4)").cast("string"), F.col("value"), F.col("lo_text"))
    line = F.concat(head, F.lit(": avg = "), average, F.lit(", height = "), F.col("height").cast("decimal(6,4)").cast("string"))
    order = F.struct(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("lo_text", F.lit("")).alias("t"), (-F.col("height")).alias("h"), F.coalesce("value", F.lit("")).alias("v"), line.alias("line"))
    # A histogram has at most FEW_VALUES or BUCKETS lines.
    lines = F.transform(F.array_sort(F.collect_list(order)), lambda s: s["line"])
    return hist.groupBy("column").agg(
        F.concat(F.lit("  Column: "), F.col("column"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text")
    )


def parse_text(files: DataFrame) -> DataFrame:
    """Histogram texts to one row per bucket.

    A column's part runs from its ``Column:`` line to the next one. A bucket is a range only
    when its text starts with a bracket, so a comma inside a value is no range. Edges of text ranges
    are quoted.
    """
    part = F.explode(F.slice(F.split("text", "Column:"), 2, F.size(F.split("text", "Column:"))))
    lines = files.select(part.alias("part")).select(
        F.trim(F.substring_index("part", "\n", 1)).alias("column"),
        F.explode(F.split("part", "\n")).alias("line"),
    )
    trimmed = F.trim("line")
    parsed = lines.select(
        "column",
        F.regexp_extract(trimmed, r"^(.*?):\s*.*?height\s*=\s*([\d.]+)", 1).alias("head"),
        F.regexp_extract(trimmed, r"^(.*?):\s*.*?height\s*=\s*([\d.]+)", 2).try_cast("double").alias("height"),
    ).where("height IS NOT NULL")
    inner = F.regexp_replace("head", r"^[\[(]|[\])]$", "")
    is_range = F.col("head").rlike(r"^\[.*,.*[\])]$")
    texts = r'^"(.*)", "(.*)"$'
    is_text = inner.rlike(texts)
    return parsed.select(
        "column",
        F.when(is_range & ~is_text, S.to_number(F.split_part(inner, F.lit(","), F.lit(1)))).alias("lo"),
        F.when(is_range & ~is_text, S.to_number(F.split_part(inner, F.lit(","), F.lit(2)))).alias("hi"),
        F.when(~is_range, F.col("head")).alias("value"),
        "height",
        F.when(is_range & is_text, F.regexp_extract(inner, texts, 1)).alias("lo_text"),
        F.when(is_range & is_text, F.regexp_extract(inner, texts, 2)).alias("hi_text"),
    )


def nest(hist: DataFrame) -> DataFrame:
    """One row per column with its buckets; at most FEW_VALUES of them."""
    value = S.parse_literal(F.col("value"))
    bucket = F.struct(
        "lo", "hi", value["num"].alias("num"), F.when(value["num"].isNull(), value["text"]).alias("text"), "height",
        "lo_text", "hi_text",
    )
    return hist.groupBy("column").agg(F.collect_list(bucket).alias("buckets"))


def _matches(b: Column, op: Column, lit: Column, compat: bool) -> Column:
    """Whether bucket ``b`` counts for ``column op literal``."""
    num, text = lit["num"], lit["text"]
    ranged, texts = b["lo"].isNotNull(), b["lo_text"].isNotNull()
    # A literal that reads as a number is compared as its text with ranges of texts.
    word = F.coalesce(text, lit["raw"])
    if compat:
        # Reference direction: '<' takes buckets above the literal, '>' those below.
        below = F.when(texts, word > b["hi_text"]).when(ranged, num > b["hi"]).when(num.isNotNull(), num > b["num"]).otherwise(text > b["text"])
        above = F.when(texts, word < b["lo_text"]).when(ranged, num < b["lo"]).when(num.isNotNull(), num < b["num"]).otherwise(text < b["text"])
        less, less_eq, more, more_eq = above, above, below, below
    else:
        less = F.when(texts, b["hi_text"] <= word).when(ranged, b["hi"] <= num).when(num.isNotNull(), b["num"] < num).otherwise(b["text"] < text)
        less_eq = F.when(texts, b["hi_text"] <= word).when(ranged, b["hi"] <= num).when(num.isNotNull(), b["num"] <= num).otherwise(b["text"] <= text)
        more = F.when(texts, b["lo_text"] >= word).when(ranged, b["lo"] >= num).when(num.isNotNull(), b["num"] > num).otherwise(b["text"] > text)
        more_eq = F.when(texts, b["lo_text"] >= word).when(ranged, b["lo"] >= num).when(num.isNotNull(), b["num"] >= num).otherwise(b["text"] >= text)
    equal = F.when(texts, word.between(b["lo_text"], b["hi_text"])).when(ranged, num.between(b["lo"], b["hi"])).when(num.isNotNull(), b["num"] == num).otherwise(b["text"] == text)
    hit = F.when(op == "=", equal).when(op == "<", less).when(op == "<=", less_eq).when(op == ">", more).when(op == ">=", more_eq)
    return F.coalesce(hit, F.lit(False))


def selectivity(buckets: Column, op: Column, values: Column, compat: bool = False) -> Column:
    """Summed height of the matching buckets, over every value of the list."""

    def one(text: Column) -> Column:
        parsed = S.parse_literal(text)
        lit = F.struct(
            parsed["num"].alias("num"), F.when(parsed["num"].isNull(), parsed["text"]).alias("text"), text.alias("raw")
        )
        return S.let(
            lit,
            lambda v: F.aggregate(
                buckets, F.lit(0.0), lambda acc, b: acc + F.when(_matches(b, op, v, compat), b["height"]).otherwise(F.lit(0.0))
            ),
        )

    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + one(v))


def bucket_hits(rows: DataFrame, hist: DataFrame, value: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``n_buckets`` and ``height`` to rows (column, value): the range buckets that hold the value, both ends included.

    Histograms up to ``limit_bytes`` go to every task. Larger ones are met in order: a bucket holds a value
    if it begins at or before it and does not end before it, so its hits are the running sum, over bucket
    starts, distinct values and bucket ends sorted together, of what began less what ended. That is one split
    scan, whatever the number of buckets, and a value that very many rows have is one row of it.
    """
    rows = rows.drop("n_buckets", "height")
    ranges = materialize(hist.where("lo IS NOT NULL").select("column", "lo", "hi", "height"))
    known = rows.join(F.broadcast(ranges.select("column").distinct()), "column", "left_semi")  # a row per column of the schema
    if in_memory_bytes(ranges) <= limit_bytes:
        nested = ranges.groupBy("column").agg(F.collect_list(F.struct("lo", "hi", "height")).alias("_b"))
        hit = F.filter("_b", lambda b: F.col(value).between(b["lo"], b["hi"]))
        found = known.join(F.broadcast(nested), "column").withColumn("_hit", hit)
        height = F.aggregate("_hit", F.lit(0.0), lambda acc, b: acc + b["height"])
        found = found.withColumn("n_buckets", F.size("_hit").cast("bigint")).withColumn("height", height)
        return found.drop("_b", "_hit")
    at = F.col(value).cast("double")
    values = known.select("column", at.alias("x")).where("x IS NOT NULL").distinct()
    events = values.select("column", "x", F.lit(1).alias("kind"), F.lit(0).alias("n"), F.lit(0.0).alias("h"))
    events = events.unionByName(ranges.select("column", F.col("lo").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("n"), F.col("height").alias("h")))
    events = events.unionByName(ranges.select("column", F.col("hi").alias("x"), F.lit(2).alias("kind"), F.lit(-1).alias("n"), (-F.col("height")).alias("h")))
    # Buckets with the same start (or end) are added up first, so no sort key has many rows.
    merged = events.groupBy("column", "x", "kind").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    order = ["x", "kind"]
    counted = split_scan(merged, ["column"], order, F.col("n").cast("bigint"), out="n_buckets")
    summed = split_scan(counted, ["column"], order, F.col("h"), out="height")
    found = summed.where("kind = 1").select("column", F.col("x").alias("_x"), "n_buckets", "height")
    joined = lookup(known.withColumn("_x", at), found, ["column", "_x"])
    # No bucket holds a missing value.
    none = [F.coalesce("n_buckets", F.lit(0)).alias("n_buckets"), F.coalesce("height", F.lit(0.0)).alias("height")]
    return joined.select(*rows.columns, *none)


def prefix_rows(table_rows: DataFrame, benchmark: str) -> DataFrame:
    """(prefix, rows) from (table, rows); as many rows as the benchmark has tables."""
    prefixes = S.literal_map(PREFIX_TABLES[benchmark])
    return (
        table_rows.select(F.explode(prefixes).alias("prefix", "name"), "table_name", "n_rows")
        .where("name = table_name")
        .select("prefix", "n_rows")
    )


def estimate(predicates: DataFrame, nested: DataFrame, rows: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``estimated`` rows to predicates (column, op, values, negated).

    ``nested`` has one row per profiled column and ``rows`` one per table; both are measured before they
    are sent to all tasks.
    """
    prefix = F.substring_index("column", "_", 1)
    joined = lookup(lookup(predicates.withColumn("prefix", prefix), rows, ["prefix"]), nested, ["column"])
    op = F.when(F.col("op") == "IN", "=").otherwise(F.col("op"))
    total = F.coalesce("n_rows", F.lit(1)).cast("double")
    by_buckets = F.when(F.col("buckets").isNotNull(), selectivity(F.col("buckets"), op, F.col("values"), compat) * total)
    kept = (
        F.when(F.col("op").isin(PATTERN_OPS), total * MATCH_SHARE)
        .when(F.exists("values", lambda v: F.contains(v, F.lit("#"))), total)
        .otherwise(F.coalesce(by_buckets, F.lit(0.0)))
    )
    negated = F.coalesce("negated", F.lit(False))
    return joined.withColumn("estimated", F.when(negated, total - kept).otherwise(kept)).drop("prefix", "n_rows", "buckets")


def table_rows(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table_name, n_rows) for the given tables."""
    counts = [
        table(spark, folder, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)
