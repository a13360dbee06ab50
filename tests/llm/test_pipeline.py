from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lakewright.llm import jaccard
from lakewright.session import materialize
from lakewright.sources.tables import table
from .test_contamination import brute as hits_of
from .test_jaccard import brute as classes_of


def texts(docs):
    return Counter((r.doc_id, r.text) for r in docs.collect())


def test_stages(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs = table(spark, folder, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts(docs)
        docs = materialize(stage(spark, docs, folder))
        assert docs.columns == columns
        seen[name] = (before, texts(docs))
    before, after = seen["language identification"]
    assert after == Counter({k: n for k, n in before.items() if k[1] and any(c.isalpha() for c in k[1])})
    before, after = seen["n-gram Jaccard join"]
    classes = classes_of(sorted(before.elements()))
    assert Counter(i for i, _ in after.elements()) == Counter({c for _, c, _ in classes})
    before, after = seen["benchmark decontamination"]
    assert after == Counter({k: n for k, n in before.items() if hits_of(k[1], items)[1] == 0})
    before, after = seen["mixing to target weights"]
    assert after.keys() <= before.keys() and len(after) > 0.8 * len(before)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(i for i, _ in after.elements())


def test_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base), (2, base.upper()), (2, base.upper()), (None, base), (5, ""), (5, ""), (6, None), (7, base + " x"), (8, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_mark", F.lit(3)).withColumn("row_hash", F.lit(4))
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 5, 5, 6, 8])
    assert jaccard.keep_one_of_each(docs.limit(0)).count() == 0


def test_odd_columns_and_empty_tables(spark, folder):
    """Extra columns of any name and nested type pass through every stage; no rows give no rows."""
    docs = table(spark, folder, "documents").limit(60)
    odd = docs.withColumns({"my col": F.lit(1), "a:b": F.struct(F.lit("x").alias("in: ner")), "rate": F.lit("r"), "label": F.lit(2)})
    for start in (materialize(odd), materialize(odd.limit(0))):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialize(stage(spark, kept, folder))
            assert kept.columns == odd.columns
        tokens = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
        assert tokens.count() == kept.count()
        assert (kept.count() > 0) == (start.count() > 0)
