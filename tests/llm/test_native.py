"""URL filters, quality rules and pseudonyms: against SQL and brute force."""
import datetime as dt
import random
import re

import duckdb
import pandas as pd

from check_oracle import compare
from panelyard.llm import line_rules, pii, sql, url_filters
from tests_llm_data import ODD_URLS, odd, rows  # noqa: F401  (fixtures)


def judged(spark, urls, **kw):
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return url_filters.judge_urls(d, url_filters.rule_table(spark, **kw))


def test_urls_match_every_rule_against_every_url(spark):
    got = judged(spark, ODD_URLS)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "pattern", "verdict"]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(ODD_URLS)), "url": ODD_URLS}))
    assert compare(got.drop("url").toPandas(), con.execute(sql.url_filters()).df()) == "ok"


def test_urls_repeated_rows_empty_table_and_no_rules(spark):
    assert judged(spark, ["http://a.com/en/"] * 3 + [None, None]).count() == 5
    assert judged(spark, []).count() == 0
    none = judged(spark, ["http://a.net/es/x"], listed=(), general=())
    assert none.first().verdict == "allow"


def test_rule_without_literal_is_still_tried(spark):
    rules = spark.createDataFrame([("dashes", "block", "--", [], 0, 1)], url_filters.RULE_SCHEMA)
    d = spark.createDataFrame([(1, "http://h/--"), (2, "http://h/-")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(d, rules).collect()} == {1: "block", 2: "allow"}


def base_figures(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 500 else None
    lines = [x for x in text.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), None if twice is None else len(twice)


def test_quality_figures_by_brute_force(rows, odd):
    texts = ["a b c a b c", "a b c d\na b c d\n\n x\n x", "x" * 10, "# $ | é\u2028é", "a b a b a b a", "w " * 60] + [t for (t,) in [(r.text,) for r in odd.collect()]]
    got = line_rules.quality_rules(rows(list(enumerate(texts)))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        want = base_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        if want[4] is not None:
            assert r.n_repeat_words == want[4]
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    q = line_rules.quality_rules(odd)
    assert q.count() == odd.count() and q.columns[:3] == ["doc_id", "text", "other"] and q.columns.count("kept") == 1
    assert line_rules.quality_rules(rows([])).count() == 0


def test_lines_decide(rows):
    rng = random.Random(1)
    prose = "\n".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(12)) + "." for _ in range(12))
    menu = "\n".join(f"Home | News {i} | About | Contact" for i in range(30))
    shout = "\n".join(f"BUY THIS NOW!! NUMBER {chr(65 + i)} IS CHEAP!!" for i in range(20))
    legal = prose + "\nAll rights reserved.\nLicensed under the Apache License, Version 2.0."
    got = {r.doc_id: r for r in line_rules.quality_rules(rows([(1, prose), (2, menu), (3, shout), (4, legal)])).collect()}
    assert got[1].kept and got[1].cleaned_text == prose
    assert not got[2].kept and not got[3].kept
    assert got[4].kept and got[4].cleaned_text == prose


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(s)) % 10 == 0


def test_pseudonyms_keep_formats_and_links(rows):
    text = "Card 4984763833005551, mail jo.do7@mail.example.com, call +1 (464) 555-9887 from 79.156.100.90, born 1984-02-29; DE89370400440532013000, 123-45-6789."
    out = pii.pseudonymise(rows([(1, text), (2, "again 4984763833005551!"), (3, "4984763833005552 1985-02-29 999.1.1.1 000-12-3456 nothing")]), "k").orderBy("doc_id").collect()
    a = out[0].text
    assert out[0].n_replaced == 7 and out[1].n_replaced == 1 and out[2].n_replaced == 0
    assert out[2].text.startswith("4984763833005552 1985-02-29")
    odd_phone = pii.pseudonymise(rows([(1, "+1 (017) 555-7713 or (017) 555-7713, +1 (300) 155-0000")]), "k").first().text
    m = re.fullmatch(r"(\+1 \(([01]\d\d)\) \d{3}-\d{4}) or (\([01]\d\d\) \d{3}-\d{4}), \+1 \([2-9]\d\d\) [01]\d\d-\d{4}", odd_phone)
    assert m and m[1] == "+1 " + m[3] and "555-7713" not in odd_phone
    for secret in ("4984763833005551", "jo.do7", "555-9887", "79.156.100.90", "1984-02-29", "370400440532013000", "123-45-6789"):
        assert secret not in a
    number = re.search(r"Card (\d{16}),", a)[1]
    assert luhn(number) and out[1].text == f"again {number}!"
    assert re.search(r"mail [a-z]{2}\.[a-z]{2}\d@mail\.example\.com", a)
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} from", a)
    assert all(int(x) < 256 for x in re.search(r"from (\S+), born", a)[1].split("."))
    assert 1800 <= dt.date.fromisoformat(re.search(r"born (\S+);", a)[1]).year < 2200
    account = re.search(r"DE\d{20}", a)[0]
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    n = spark.range(2000)
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    word = F.concat(F.char(97 + F.col("id") % 26), F.lpad(F.col("id").cast("string"), 4, "0"))
    r = n.select(F.countDistinct(pii.date(day, "k")), F.countDistinct(pii.permuted(word, "k", "t")), F.countDistinct(pii.date(day, "other"))).first()
    assert tuple(r) == (2000, 2000, 2000)
    small = spark.range(100).select(pii.permuted(F.lpad(F.col("id").cast("string"), 2, "0"), "k", "t").alias("p")).distinct()
    assert small.count() == 100


def test_pseudonyms_odd_rows(odd, rows):
    got = pii.pseudonymise(odd, "k")
    assert got.columns == [*odd.columns, "n_replaced"] and got.count() == odd.count()
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(r.doc_id), str(r.text)) for r in odd.collect())
    assert pii.pseudonymise(rows([]), "k").count() == 0
