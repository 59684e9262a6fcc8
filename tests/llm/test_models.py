import random

import pytest
from pyspark.sql import functions as F

from parapet.llm import htmltext, quality, toxicity

BAD = ["nasty", "vile", "rotten"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        if poor:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text), f"s{i % 4}", "clash"))
        if i % 2:
            labels.append((i, int(not poor), int(toxic)))
    docs += [(None, None, None, "x"), (700, "", "s1", "x"), (701, "ok " * 30000 + "vile nasty rotten", "s2", "x"), (3, docs[3][1], "s3", "x")]
    labels += [(1, None, 1), (None, 1, 0), (3, 1, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, toxicity string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_chain_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    chain = toxicity.fit(docs, labels, toxicity.categories())
    got = {r["doc_id"]: r["toxicity"]["is_toxic"] for r in toxicity.score(docs, chain).collect()}
    held_out = [i for i in range(0, 600, 2)]
    assert sum(got[i] == (i % 5 == 0) for i in held_out) >= 0.98 * len(held_out)
    assert not got[None] and not got[700]
    kept = toxicity.rejected(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not x for x in got.values()) + 1  # row 3 is there twice
    empty = toxicity.fit(docs, labels.limit(0), toxicity.categories())
    assert toxicity.rejected(docs, empty).count() == docs.count()


def test_quality_shrinks_sparse_sites(spark, corpus):
    docs, labels = corpus
    evidence = quality.fit(docs, labels)
    got = quality.posterior(docs, evidence, F.col("source"), F.col("source")).collect()
    assert len(got) == docs.count()
    right = [r["keep"] == (r["doc_id"] % 7 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(right) >= 0.97 * len(right)
    scored = spark.createDataFrame([("a", "a/1", 0.0)] + [("b", "b/1", 1.0)] * 500 + [("c", "c/1", 0.2)] * 500, "site string, path string, p double")
    overall, groups = quality.shrunk(scored)
    rate = {r["site"]: r["site_rate"] for r in groups.collect()}
    assert 0.0 < rate["a"] < overall and rate["b"] > 0.9 and rate["c"] < 0.3
    assert quality.posterior(docs.limit(0), evidence, F.col("source"), F.col("source")).count() == 0


PAGE = """<html><head><title>T</title></head><body><header class="top"><h1>Site</h1><nav><a>Home</a></nav></header>
<div id="cookie-notice">We use cookies. Accept them all.</div>{open}<h1>Big  title</h1><p>First paragraph of the story with words,
and <a href="x>y">a link</a> too.<p>Second &amp; more &lt;b&gt; words<aside>Related stories</aside><p>Third<br>one.
<script>if (a<b) "</p>"</script>{close}<div class=comments><p>User says nice post</p></div><form>Name <button>Go</button></form>
<footer>Copyright</footer></body>"""
TEXT = "Big title\nFirst paragraph of the story with words, and a link too.\nSecond & more <b> words\nThird one."


def test_pages(spark):
    named = PAGE.format(open="<article>", close="</article>")
    plain = PAGE.format(open='<div class="content">', close="</div>")
    rows = [(i, f"http://h/{i}", named, "own") for i in range(20)]
    rows += [(20, "u", plain, "own"), (21, None, None, "own"), (22, "u", "", "own"), (23, "u", "<p>", "own"), (23, "u", "<!-- open", "own"),
             (24, "u", "<p>" + "word " * 50000, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.main_text(pages, htmltext.fit(pages)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["page_id"], r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(by_id[i] == TEXT for i in range(21))
    assert by_id[21] == by_id[22] == by_id[23] == "" and by_id[24] == " ".join(["word"] * 50000)
    assert htmltext.main_text(pages.limit(0), htmltext.fit(pages.limit(0))).count() == 0


STORY = "<h1>Big title</h1><p>" + "Words of the story. " * 20 + "</p><p>And " + "more of it. " * 20 + "</p>"
STORY_TEXT = "Big title\n" + " ".join(["Words of the story."] * 20) + "\nAnd " + " ".join(["more of it."] * 20)


@pytest.mark.parametrize("before", [
    "<datalist><option value=a><option value=b></datalist>", "<div><button>Go</div>", "<button>Go", "<select><option>One",
    "<div><svg><path d='M0'></div>", "<div><video src=x></div>", "<svg/>", "<div><template>No</div>"])
def test_missing_end_tags_drop_no_article(before):
    for article in ("article", "div"):
        page = f"<html><body>{before}<{article}>{STORY}</{article}></body></html>"
        assert htmltext.extract(page, htmltext.Weights({}, {})) == STORY_TEXT


def test_formulas_stay():
    page = f"<body><article>{STORY}<p>So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds</p></article></body>"
    assert htmltext.extract(page, htmltext.Weights({}, {})) == STORY_TEXT + "\nSo x = 2 holds"


@pytest.mark.parametrize("open_, close", [
    ('<div class="content has-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"),
    ('<div class="layout no-sidebar"><form><div id="page-with-nav">', "</div></form></div>")])
@pytest.mark.parametrize("article", ["article", "div"])
def test_wrappers_are_no_furniture(open_, close, article):
    comments = "<div class=comments><article>Nice post, " + "I liked it. " * 40 + "</article></div>"
    side = "<div class=sidebar><p>Latest news and links</p></div><nav>Home</nav>"
    page = f"<body>{open_}{side}<{article}>{STORY}</{article}>{side}{comments}{close}<footer>Imprint</footer></body>"
    assert htmltext.extract(page, htmltext.Weights({}, {})) == STORY_TEXT


def test_ids_inside_an_article_are_places_in_it():
    page = ('<body><nav>a b</nav><article><p id="search">' + "word " * 40 + '</p><section id="comments-on-policy"><p>' + "more " * 30
            + '</p></section><div class="comments">bad bad</div><div id="related-articles">bad</div><p title="x>stray ' + "text " * 20
            + '</p><p class="y">next ' + "para " * 10 + '</p><p title="a > b" data-x=\'<b>in</b>\'>' + 'end ' * 5 + '</p></article></body>')
    lines = htmltext.extract(page, htmltext.Weights({}, {})).split("\n")
    assert [line.split()[0] for line in lines] == ["word", "more", "stray", "next", "end"]
    assert [len(line.split()) for line in lines] == [40, 30, 21, 11, 5]


def test_deeply_nested_wrappers_take_linear_time():
    import time
    start = time.perf_counter()
    assert htmltext.extract("<div class=sidebar>word " * 10_000, htmltext.Weights({}, {})) is not None
    assert time.perf_counter() - start < 5  # about half a second; the square of it was an hour


def test_a_labelled_id_with_a_third_of_the_rows_counts_once(spark):
    rows = [(i, f"text number {i} " + ("vile " if i % 2 else "kind ") * 5, 1) for i in range(60)] + [(5, f"copy {i}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, labels, toxicity.categories(), 100).count() == 60
    from parapet.llm.common import one_text
    one = one_text(docs.select("doc_id", "text"))
    assert one.count() == 60 and one.collect() is not None
    assert quality.fit(docs, labels) is not None
