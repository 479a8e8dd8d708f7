"""No column of the caller is overwritten, dropped or crashes an operator, whatever its name."""
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from panelyard.llm import bpe, chunk_dedup, html_extract, lexical_search, line_rules, pii, sharding, shingle_dedup, simhash, url_filters
from tests_llm_data import rows  # noqa: F401  (fixture)

INNER = "_url _judged _r _w _t _o _text _g _l _s _full _one _k _id _gone _key _e _host _html _blocks _dead _shape _h _m _row _low h s piece at before uid id n term tf bucket m".split()
DOCS = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, "call +1 (464) 555-9887 or a@b.org")]


def crowded(rows, second="text", data=DOCS):
    d = rows(data, f"doc_id long, {second} string")
    return d.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in INNER])


def intact(out, gone=()):
    back = out.collect()
    for r in back:
        for c in INNER:
            if c not in gone:
                assert r[c] == f"{c}:{r.doc_id}"
    return back


CASES = {
    "quality_rules": lambda d: line_rules.quality_rules(d),
    "without_passages": lambda d: chunk_dedup.without_passages(d),
    "pseudonymise": lambda d: pii.pseudonymise(d, "k"),
    "encode_texts": lambda d: bpe.encode_texts(d, public_tokenizers.path("word_bpe_49k.json")),
    "place": lambda d: sharding.place(d, 2),
    "shingle_keep_first": lambda d: shingle_dedup.keep_first(d),
    "simhash_keep_first": lambda d: simhash.keep_first(d),
}


@pytest.mark.parametrize("name", CASES)
def test_columns_of_documents_pass_through(rows, name):
    assert len(intact(CASES[name](crowded(rows)))) in (3, 4)


def test_columns_of_pages_pass_through(spark, rows):
    urls = [(1, "http://a.net/es/x"), (2, None), (3, "http://a.net/es/x")]
    got = intact(url_filters.judge_urls(crowded(rows, "url", urls), url_filters.rule_table(spark)))
    assert sorted(r.verdict for r in got) == ["allow", "block", "block"]
    pages = [(1, "<p>one"), (2, None), (3, "<article>two")]
    d = crowded(rows, "html", pages).withColumn("url", F.lit("http://h/"))
    assert sorted(r.text for r in intact(html_extract.extract_text(d))) == ["", "one", "two"]


def test_operator_columns_with_inner_names(rows):
    d = rows(DOCS).toDF("_id", "_text")
    assert chunk_dedup.without_passages(d, "_id", "_text").columns == ["_id", "_text"]
    assert line_rules.quality_rules(d, "_text").count() == 4 and shingle_dedup.keep_first(d, "_id", "_text").count() == 3
    found = lexical_search.rank_documents(crowded(rows), crowded(rows).withColumnRenamed("doc_id", "item_id"))
    assert found.filter("item_id = 1").count() == 2
