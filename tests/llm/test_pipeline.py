"""The pipeline, stage by stage against plain versions of the operators."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as CP
from postura.llm import decontaminate, line_dedup, quality
from postura.operators.ordered import stage
from tests.llm.test_decontaminate import table
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_row", F.lit("extra"))
    blank = docs.where("doc_id in (7, 8)").withColumns({"doc_id": F.col("doc_id") + 10 ** 6, "text": F.lit(None).cast("string")})
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(blank)
    tables = [docs]
    for _, step in CP.STAGES:
        tables.append(stage(step(spark, tables[-1], SF)))
    rows = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[1:-1])
    order = lambda r: (r.doc_id, r.text or "")

    fitted = quality.fit_corpus(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {(r.doc_id, r.keep) for r in quality.score(fitted).collect()}
    assert all((r.doc_id, True) in keep for r in rows[1]) and 0 < len(rows[0]) - len(rows[1]) < 60

    before, after = sorted(rows[1], key=order), sorted(rows[2], key=order)
    want = sorted(((r.doc_id, t) for r, t in zip(before, plain_lines([(r.source, r.text) for r in before], line_dedup.RATIO, line_dedup.MIN_PAGES))),
                  key=lambda x: (x[0], x[1] or ""))
    assert [(r.doc_id, r.text) for r in after] == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)

    assert sorted(r.doc_id for r in rows[3]) == plain_kept([(r.doc_id, r.text) for r in after]) and len(rows[3]) < len(rows[2])

    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontaminate.plain(r.text) for r in rows[3]}
    leaks = {d for d, t in texts.items() if any(i in t for i in items)}
    left = {r.doc_id for r in rows[4]}
    assert not leaks & left
    for d in set(texts) - left - leaks:  # few: near hits that are not exact
        assert any(table(i, texts[d]) <= int(decontaminate.RATE * len(i)) for i in items)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(rows[5], {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows[4]})
    assert all(len(r.ids) == 4 * r.length for r in rows[5])


def test_run(spark):
    assert CP.run(spark, SF).count() > 50


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, step in CP.STAGES:
        out = stage(step(spark, docs, SF))
        assert out.count() == 0, name
        docs = out if name != "packing" else docs


def test_blank_documents_and_clashing_columns(spark):
    """Only null, empty and blank texts without a source or language, beside columns named like the operators' own."""
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (3, " \n ", None, None, 3), (None, "a b", None, None, 3), (3, " \n ", None, None, 3)]
    docs = spark.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in ("host", "n", "cls", "keep", "score", "ids", "_salt")})
    for name, step in CP.STAGES:
        docs = stage(step(spark, docs, SF))
        if name == "near_dedup":  # blank texts are copies of each other
            assert docs.count() <= 2
    assert docs.count() <= 2
