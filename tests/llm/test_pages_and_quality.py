"""HTML extraction, the quality classifier and the pipeline."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import html_extract as H
from panelyard.llm import quality
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>a</a></ul></nav><div class="cookie-notice">We use</div><main><article><header class="entry-header"><h1>Tit &amp; le</h1></header>
<p>One <b>two<br>three <p>Four&nbsp;five<div class="ad">buy</div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>tail <span>in</span>
<section class="comments"><p>c1</p></section></article></main><aside>s</aside><form><input>f</form><footer>&copy;</footer></body></html>"""


def test_blocks_of_one_page():
    assert [t for _, t in H.Page(PAGE).candidates()] == ["Tit & le", "One two three", "Four five", "x", "y", "1", "2", "tail in"]


@pytest.mark.parametrize("source", ["", "plain", "<", "<p", "<p>a</b></p>", "<!-- open", "<script>never closed", "<a href='x>y</a>", "</div></div>x", "<p>" * 3000, "<div>" * 3000 + "deep", "&#0; &bogus; &lt;"])
def test_broken_markup_does_not_crash(source):
    H.Page(source).candidates()


BODY = "<p>The first long paragraph of the body.</p><p>And after it <a href=x>one linked title</a>.</p>"


@pytest.mark.parametrize("around", [
    "<div class='content with-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>", "<div class='post has-comments'>{}</div>",
    "<div class='hidden-gems'>{}</div>", "<div class='copyright-law-article'>{}</div>", "<div class='Entry-Content'>{}</div>",
    "<div class=widget><article><p>A teaser.</p></article></div><div>{}</div>", "<div id=header-image-story>{}</div>", "<form id=aspnet><main>{}</main></form>",
])
def test_words_inside_class_names_are_hints(around):
    page = f"<body><div class=site-footer><p>f</p></div><div class='post-comments'><p>c</p></div><div class=cookie-notice>n</div>{around.format(BODY)}<div class=sidebar>s</div></body>"
    assert [t for _, t in H.Page(page).candidates()] == ["The first long paragraph of the body.", "And after it one linked title."]


def test_links_outside_articles():
    def texts(body):
        return [t for _, t in H.Page(f"<body><p>Some text of the page.</p>{body}").candidates()][1:]

    assert texts("<p><a href=x>One linked title</a></p>") == ["One linked title"]
    assert texts("<p><a href=x>One</a> <a href=y>Two</a></p>") == [] and texts("<ul><li><a href=x>One</a><li><a>Two</a></ul>") == []
    assert texts("<div class=my-menu-links-here><p><a href=x>One</a></p><p>words of a text</p></div>") == ["words of a text"]
    assert texts("<p>a <math><mi>x</mi></math> b</p>") == ["a x b"]


def test_deep_pages_align(spark):
    deep = [(i, "http://deep.org/", "<div>" * (1500 + i % 2) + f"<p>text {i}</p>") for i in range(4)]
    shape = ["\n".join(["-1 #"] + [f"{i} div" for i in range(n)]) for n in (1500, 1501)]
    assert H.tree_match(*shape) == list(range(1501))
    got = H.extract_text(spark.createDataFrame(deep, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}" for i in range(4)}


def slow_match(la, ca, lb, cb, x, y):
    if la[x] != lb[y]:
        return 0
    p, q = ca[x], cb[y]

    def best(i, j):
        if i == len(p) or j == len(q):
            return 0
        return max(best(i + 1, j), best(i, j + 1), slow_match(la, ca, lb, cb, p[i], q[j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_tree_matching_by_brute_force():
    rng = random.Random(4)

    def shape():
        lines = ["-1 #"]
        for i in range(1, 9):
            lines.append(f"{rng.randrange(max(0, i - 4), i)} {rng.choice('abc')}")
        return "\n".join(lines)

    for _ in range(60):
        a, b = shape(), shape()
        m = H.tree_match(a, b)
        (la, ca), (lb, cb) = H.tree(a), H.tree(b)
        pairs = [(i, j) for i, j in enumerate(m) if j >= 0]
        assert len(pairs) == slow_match(la, ca, lb, cb, 0, 0)
        assert all(la[i] == lb[j] for i, j in pairs) and len({j for _, j in pairs}) == len(pairs)


def site(n, seed=0, host="h.org", notice="Read our terms before you go on, dear reader."):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        paragraphs = ["".join(rng.choice("abcdefg ") for _ in range(80)) for _ in range(rng.randint(1, 5))]
        extra = "<div class=x9><p>side</p></div>" if i % 4 == 0 else ""
        out.append((i, f"http://{host}/{i}", f"<body><div class=x1><p>{notice}</p></div>{extra}<div class=x2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class=x3><p>The end of {host}</p></div>", [" ".join(p.split()) for p in paragraphs]))
    return out


def test_constant_slots_are_template_without_any_hint(spark):
    pages = site(20)
    d = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(d).collect()}
    for i, _, _, want in pages:
        assert got[i].replace("side\n\n", "") == "\n\n".join(want)


def test_copies_do_not_make_an_article_a_template(spark):
    pages = site(6)
    copies = [(100 + i, f"http://h.org/c{i}", pages[0][2]) for i in range(60)]
    d = spark.createDataFrame([p[:3] for p in pages] + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(d).collect()}
    assert all(got[100 + i].replace("side\n\n", "") == "\n\n".join(pages[0][3]) for i in range(60))


def test_extraction_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "http://a/", "<p>é😀</p>", "x"), (3, "http://a/", "<p>é😀</p>", "x")], "page_id long, url string, html string, text string")
    got = H.extract_text(d)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "", 0), (2, "", 0), (3, "é😀", 2), (3, "é😀", 2)]
    assert H.extract_text(d.limit(0)).count() == 0


def corpus(n):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        text = " ".join(w + rng.choice(["***", "###"]) for w in words) if bad else " ".join(words).capitalize() + "."
        docs.append((i, text))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_classifier_separates_held_out_rows(spark, rows, odd):
    docs, labels = corpus(400)
    d, y = rows(docs).withColumn("score", F.lit("clash")), spark.createDataFrame([*labels, (5, None, 0), (999_999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(d, y)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    back = got.collect()
    assert len(back) == 400
    import zlib

    for r in back:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in back if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.97
    kept = quality.keep_good(d, y)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in back if r.predicted} and kept.columns == d.columns
    assert quality.score_documents(odd, y).count() == odd.count()
    assert quality.score_documents(rows([]), y).count() == 0
    assert {r.score for r in quality.score_documents(d, y.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_do_not_matter(spark, rows):
    docs, labels = corpus(120)
    import zlib

    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in quality.score_documents(rows(docs), spark.createDataFrame(y, "doc_id long, quality int, toxic int")).collect()} for y in (labels, flipped))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_isotonic_by_definition():
    knots, levels = quality.pooled(np.array([1.0, 2, 3, 4]), np.array([1.0, 0, 3, 2]), np.array([1.0, 1, 3, 2]))
    assert np.allclose(levels, [0.5, 1.0]) and np.allclose(knots, [1.5, (9 + 8) / 5])


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    from panelyard.llm import bpe, decontaminate
    from test_shingle_dedup import slow_kept

    docs, labels = corpus(160)
    item = " ".join(f"benchmark{i} words" for i in range(12))
    good = next(t for _, t in docs[1:])
    docs += [(500, docs[1][1] + " " + item), (501, good), (502, docs[2][1] + " call +1 (464) 555-9887 now"), (503, None), (504, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = spark.read.parquet(f"{tmp_path}/documents.parquet")
    d, seen = base, {}
    for name, f in cp.STAGES:
        d = cp.written(f(spark, d, str(tmp_path)), "test")
        seen[name] = {r.doc_id: r for r in d.collect()}
        if name != "tokens":
            assert d.columns == base.columns
    text = dict(docs)
    predicted = {r.doc_id for r in quality.score_documents(base, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
    assert set(seen["quality"]) == predicted
    # One document of each component of the pairs of Jaccard 0.8 and more stays.
    group = slow_kept([(i, text[i]) for i in sorted(predicted)])
    assert set(seen["near_dedup"]) == group and 501 not in group
    p = decontaminate.plain(item)
    assert set(seen["decontaminate"]) == {i for i in group if p not in decontaminate.plain(text[i] or "")} and 500 not in seen["decontaminate"]
    assert set(seen["pii"]) == set(seen["decontaminate"])
    assert all(r.text == text[i] for i, r in seen["pii"].items() if i != 502)
    if 502 in seen["pii"]:
        assert "464) 555-9887" not in seen["pii"][502].text
    e = bpe.encoder(cp.VOCABULARY)
    for i, r in seen["tokens"].items():
        assert r.token_ids == e.encode(seen["pii"][i].text or "").tolist()
    assert cp.run(spark, str(tmp_path)).count() == len(seen["tokens"])
