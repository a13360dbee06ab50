"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import alignment, ann, contamination, html_main, jaccard, langid, mixing, privacy, repeats, resample, toxicity, warc, wavelet
from lakewright.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs))


@_query("op2_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Class and links of every document: 5-word runs, similarity 0.8."""
    return jaccard.jaccard_classes(table(spark, folder, "documents")).drop("row_hash", "class_key")


@_query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@_query("op4_token_shards")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written as wavelet matrices and read back."""
    return wavelet.read_shards(spark, wavelet.write_shards(table(spark, folder, "documents"), tokenizer_path()))


@_query("op5_main_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(table(spark, folder, "pages"))


@_query("op6_privacy_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    found = privacy.find(table(spark, folder, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind_name(s), s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [
        F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(privacy.KINDS[:4])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans")
    )


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def _kind_name(span):
    return F.element_at(F.array(*[F.lit(k) for k in privacy.KINDS]), span["kind"] + 1)


@_query("op7_nearest_neighbours")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), ann.train(vectors))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query(
    "op8_benchmark_contamination",
    f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item_id, len(w) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, least(m, 10) AS n, array_to_string(w[s:s + least(m, 10) - 1], ' ') AS phrase FROM bw),
sizes AS (SELECT DISTINCT n FROM wins),
dp AS (SELECT doc_id, len(w) AS m, w, n FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, w, unnest(range(1, m - n + 2)) AS p FROM dp),
hits AS (
  SELECT doc_id, item_id, p, wins.n FROM dw JOIN wins ON dw.n = wins.n AND array_to_string(w[p:p + dw.n - 1], ' ') = phrase),
spots AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    hits = contamination.phrase_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op9_mixing_rates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of every document for the target shares of the labelled domains."""
    return mixing.document_rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query(
    "op10_warc_archives",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT sha1(h) AS s, min(page_id) AS first FROM p GROUP BY h),
x AS (SELECT page_id, h, sha1(h) AS s FROM p),
digits AS (SELECT s, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', s[i]) - 1) || [0] AS d FROM f),
coded AS (
  SELECT s, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((d[(5 * i) // 4 + 1] * 16 + d[(5 * i) // 4 + 2]) // CAST(power(2, 3 - (5 * i) % 4) AS BIGINT)) % 32, 1)), '') AS b
  FROM digits)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM x JOIN f USING (s) JOIN coded USING (s)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    folder = warc.write_archives(table(spark, folder, "pages"))
    return warc.page_records(warc.read_archives(spark, folder, payloads=False))


@_query("op11_tokenizer_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level and piece tokens of every document, aligned, with the corpus counts of their links."""
    return alignment.align(table(spark, folder, "documents"), tokenizer_path(), tokenizer_path(PIECES))


@_query(
    "op12_importance_resampling",
    f"""
WITH steps AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS step),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
runs AS (
  SELECT doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
wanted AS (SELECT list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(f) AS f FROM runs) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(f) AS f FROM wanted) GROUP BY f),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
codes AS (
  SELECT f, xor(list_reduce(range(0, length(h) // 2), lambda c, i: xor(c >> 8, step[1 + (xor(c,
    strpos('0123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 17) & 255)]),
    4294967295), 4294967295) % 10000 AS bucket FROM names, steps),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN codes USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN codes USING (f) GROUP BY bucket),
sizes AS (
  SELECT coalesce((SELECT sum(n) FROM s), 0) + 10000 AS all_s, coalesce((SELECT sum(n) FROM t), 0) + 10000 AS all_t),
gain AS (
  SELECT s.bucket, floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(all_s AS DOUBLE)
    / (CAST(s.n + 1 AS DOUBLE) * CAST(all_t AS DOUBLE)))) AS g
  FROM s LEFT JOIN t USING (bucket), sizes),
weights AS (
  SELECT doc_id, CAST(floor(sum(g * n) / sum(n)) AS BIGINT) AS weight FROM df JOIN codes USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
draws AS (
  SELECT doc_id, len(w) AS n_words, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    list_reduce(range(1, 9), lambda v, i: v * 16 + strpos('0123456789abcdef', x[i]) - 1, 0) AS h
  FROM (SELECT *, sha256('7:' || doc_id) AS x FROM runs) LEFT JOIN weights USING (doc_id)),
scores AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM draws),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)
""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark texts, with every document's weight."""
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.drop("n_words")


@_query(
    "op13_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM places),
lows AS (SELECT h, min(doc_id) AS low FROM wins GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM wins JOIN lows USING (h) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without passages of 50 words that a document of smaller id has too."""
    return repeats.remove_repeats(table(spark, folder, "documents"))
