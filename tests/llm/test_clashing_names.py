"""Columns of a table keep their values where they are named like helper columns of an operator."""

from __future__ import annotations

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tallymart.llm.decontamination import drop_contaminated
from tallymart.llm.secrets import find_secrets, redact
from tallymart.llm.simhash import keep_one

CLASHES = ("_no_id", "_of", "_hash", "_base", "_extra", "_quality", "_QUALITY_", "secrets", "_secrets", "root", "r",
           "text_hash", "fingerprint", "spans", "items", "_id", "_text", "_words", "_at")
PROSE = ("The harbour master wrote down every vessel that came in before noon and noted which of them carried salt, "
         "timber or wool, because the council wished to know how trade had changed since the bridge was opened. ")


def table(spark):
    rows = [(1, PROSE + "password = hunter22x", 10), (2, PROSE * 2, 20), (3, None, 30), (None, "", 40), (4, PROSE * 2, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in CLASHES})


def unchanged(rows):
    return all(r[c] == f"{c}{r['doc_id'] or 0}" for r in rows for c in CLASHES)


def test_operators_keep_columns_of_any_name(spark):
    docs = table(spark)
    items = spark.createDataFrame([("i", PROSE, 1, 2)], "item_id string, text string, _key int, items int")
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, None}
    assert unchanged(kept.collect())
    one = keep_one(docs)
    assert one.columns == docs.columns and unchanged(one.collect())
    assert sorted(r["doc_id"] for r in one.collect()) in ([1, 2, 3], [1, 3])  # the ends may differ enough in bits
    marked = redact(find_secrets(docs, out="_found"), secrets="_found").drop("_found")
    assert marked.columns == docs.columns and unchanged(marked.collect())
    assert {r["text"] for r in marked.where("doc_id = 1").collect()} == {PROSE + "[SECRET]"}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = table(spark)
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert unchanged(rows) and {1, 2} & {r["doc_id"] for r in rows}, name
