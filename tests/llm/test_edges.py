"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, html_tree, langid, licenses, masked_lm, mixing, quality, secrets, simhash, substring

LONG = " ".join(f"word{i % 997} token" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "s"), (1, "the quick brown fox jumps over the lazy dog", "en", "s"),
    (2, None, None, None), (3, "", "en", "s"), (4, " \n\t", None, "t"), (None, "a text without an id", "en", None), (5, LONG, "en", "t"),
    (6, "token = \"abcdef123456\" 🙂 é", "fr", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["words", "n", "key1", "host", "rate", "copies", "target", "size", "fp", "spans", "of_fp", "kept", "found"]

OPERATORS = {
    "secrets": secrets.scan,
    "lm": masked_lm.score_documents,
    "simhash": simhash.components,
    "quality": quality.judge,
    "licenses": licenses.scan,
    "substring": substring.deduplicated,
    "decontam": lambda d: decontam.contamination(d, bench(d.sparkSession)),
    "mixing": mixing.plan_documents,
    "langid": langid.identify,
}
KEEPING = {
    "quality": quality.keep_good,
    "simhash": simhash.keep_first,
    "decontam": lambda d: decontam.keep_clean(d, bench(d.sparkSession)),
    "secrets": secrets.redact,
    "mixing": mixing.mix,
    "substring": substring.remove,
}


def bench(spark):
    rows = [("a", "the QUICK brown fox"), ("b", None), ("c", ""), (None, "lazy dog"), ("a", "the QUICK brown fox")]
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_for_rows(docs, name):
    found = OPERATORS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    twice = [repr(r) for r in found if r["doc_id"] == 1]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_keeps_columns(docs, spark, name):
    found = KEEPING[name](docs)
    assert found.columns == docs.columns
    assert {str(r["doc_id"]) for r in found.collect()} <= {str(r[0]) for r in ROWS}
    assert KEEPING[name](docs.where("false")).count() == 0


def test_defined_results(docs):
    by = lambda rows: {r["doc_id"]: r for r in rows}
    prints = by(simhash.components(docs).collect())
    assert prints[2].fp == prints[3].fp == prints[4].fp == 0 and prints[4].component_id == 2
    clean = by(decontam.contamination(docs, bench(docs.sparkSession)).collect())
    assert (clean[1].n_words, clean[1].n_hit, clean[1]["items"], clean[2].n_words) == (9, 4, ["a"], 0)
    judged = by(quality.judge(docs).collect())
    assert judged[2].base_failed and not judged[2].kept and judged[5].n_words == 120_000
    langs = by(langid.identify(docs).collect())
    assert (langs[2].lang_pred, langs[3].lang_pred, langs[4].score) == ("und", "und", 0.0)
    scored = by(masked_lm.score_documents(docs).collect())
    assert (scored[2].n_tokens, scored[2].score, scored[2].mean_score) == (0, 0.0, None)
    planned = by(mixing.plan_documents(docs).collect())
    assert planned[2]["size"] == 0 and planned[5].taken <= 2 * planned[5]["size"]
    found = by(secrets.scan(docs).collect())
    assert [tuple(s) for s in found[6].base] == [(0, 0, 21)] and found[2].base == []


def test_rows_stand_for_themselves(spark):
    """A null or shared doc_id never takes another row along."""
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(None, good, "s"), (None, "short", "s"), (7, good + " end", "s"), (7, "also short", "s"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = lambda found: sorted((r.text or "" for r in found.collect()))
    assert kept(quality.keep_good(df)) == sorted([good, good + " end"])
    item = spark.createDataFrame([("a", "also short")], "item_id string, text string")
    assert kept(decontam.keep_clean(df, item)) == sorted([good, "short", good + " end", ""])
    other = df.where("text is not null").withColumn("doc_id", F.lit("same"))
    assert kept(quality.keep_good(other)) == sorted([good, good + " end"])
    found = {r.text: r.line_spans for r in substring.deduplicated(df.where("doc_id = 7").unionByName(df.where("doc_id = 7"))).collect()}
    assert set(found) == {good + " end", "also short"}


def test_pages(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", "<p>" * 5000 + "x", 0), (3, "u", "<article><p>One sentence is here." * 3, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    pages = pages.withColumns({c: F.lit("clash") for c in ("n_chars", "key", "block", "nodes", *CLASHING)})
    found = {r.page_id: r.text for r in html_tree.extract(pages).collect()}
    assert found[1] == found[2] == "" and len(found) == 4
    assert html_tree.extract(pages.where("false")).count() == 0


def test_words_alone_make_no_mixing_of_null_sources(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c", "x")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in mixing.plan_documents(docs).collect()}
    # x ranks first (weight 5) and stops at twice its size; null gets the rest.
    assert found[2].target == 2.0 and found[1].target == pytest.approx(2.5)
