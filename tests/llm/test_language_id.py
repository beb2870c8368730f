"""Operator 8: held-out accuracy on the pages' and documents' languages, fusion and odd rows."""

import pytest
from pyspark.sql import functions as F

from tagwave.llm.language_id import identify, keep_identified, page_evidence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_text_alone_agrees_with_declared_language(docs):
    out = identify(docs, carry=["doc_id", "lang"]).where("trigrams > 100")
    share = out.select(F.avg((F.col("text_language") == F.col("lang")).cast("double"))).first()[0]
    assert share > 0.95


def test_held_out_rows_without_declared_language(docs):
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).join(
        docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    out = identify(hidden, carry=["doc_id", "truth"]).where("doc_id % 3 = 0 and trigrams > 30")
    share = out.select(F.avg((F.col("language") == F.col("truth")).cast("double"))).first()[0]
    assert share > 0.95


def test_clean_documents_stay(docs):
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.98 * docs.count()


def test_pages_by_markup_suffix_and_host(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = page_evidence(pages)
    page = "<html lang='fr'><script>if (a < b) x</script><p>Le <b>mot</b>&nbsp;la"
    made = spark.createDataFrame([(1, "https://a.example.com/fr/9?q", page), (2, "http://b.example.de/x", page)],
                                 "page_id bigint, url string, html string")
    assert [(r.declared, r.suffix, r.host, r.text.split()) for r in page_evidence(made).collect()] == [
        ("fr", "fr", "a.example.com", ["Le", "mot", "la"]), ("fr", "de", "b.example.de", ["Le", "mot", "la"])]
    options = dict(declared_col="declared", host_col="host", suffix_col="suffix", carry=["page_id", "declared"])
    out = identify(rows, **options)
    share = out.select(F.avg((F.col("language") == F.col("declared")).cast("double"))).first()[0]
    assert share > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "no address", "<p>"), (3, "http://x", "")],
                                "page_id bigint, url string, html string")
    assert [r.kept for r in identify(page_evidence(odd), **options).collect()] == [False] * 3


def test_odd_rows(spark, docs):
    rows = [(9001, None, "en", "src1"), (9002, "", "en", None), (9003, "123 456", None, None),
            (9004, "漢字仮名交じり文漢字仮名交じり文" * 20, None, "src1"), (9005, "xqzvkj wqxzj kqvzx jzqkw " * 40, None, None)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(odd).unionByName(odd)
    out = {r.doc_id: r for r in identify(both).where("doc_id > 9000").collect()}
    assert not any(out[d].kept for d in (9001, 9002, 9003, 9004, 9005))
    assert out[9001].trigrams == 0 and out[9003].language is None
    assert keep_identified(both).where("doc_id > 9000").count() == 0


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, lang string, source string, best int, loglik string, trigrams string"
    assert identify(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(1, "le chat et la souris", "fr", "a.b.org", 1, "x", "y")], schema)
    assert keep_identified(one).columns == one.columns
    assert keep_identified(one).count() <= 1


def test_suffix_and_host_decide_short_texts(spark):
    long = "the cat sat on the mat and that was the end of it " * 5
    lang = "der hund und die katze sind nicht auf dem dach und das ist gut " * 5
    rows = [(i, long, "en", "a.example.com", "com") for i in range(30)] + \
           [(100 + i, lang, "de", "b.example.de", "de") for i in range(30)] + \
           [(200, "an", None, "a.example.com", "com"), (201, "an", None, "b.example.de", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, host string, suffix string")
    out = {r.doc_id: r.language for r in identify(df, host_col="host", suffix_col="suffix").collect()}
    assert out[200] == "en" and out[201] == "de"
