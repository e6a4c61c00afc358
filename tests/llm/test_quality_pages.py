"""Quality scores, main text of pages, the pipeline and its registration."""

import itertools
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from partwright.llm.html_text import extract_pages, main_text
from partwright.llm.queries import QUERIES, TRAINING, vocabulary_path
from partwright.llm.quality import Machine, fit_quality, interactions, labelled_sample, quality_scores
from partwright.llm.tokens import vocabulary as loaded
from test_alike import brute_components
from test_texts import brute_copies, brute_lines
from test_tokens import best_fit_decreasing, check_packed

SMALL = "/root/testdata/sf0.01"


def test_linear_time_interactions_equal_all_pairs():
    rng = np.random.default_rng(0)
    x, v = rng.normal(size=9), rng.normal(size=(9, 4))
    pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for i, j in itertools.combinations(range(9), 2))
    assert abs(interactions(x, v) - pairs) < 1e-9


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_quality_machine"](spark, SMALL).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 100 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_scores_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (9, 0), (7, 5), (8, None), (None, 1), (5, 0), (5, 1)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.label) for r in labelled_sample(odd, labels).collect()) == [(1, 1), (2, 1), (9, 0)]
    model = fit_quality(odd, labels)
    scored = quality_scores(odd, model)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_scores(odd, model, with_row=True).select("row.*").columns == odd.columns
    assert quality_scores(none, model).count() == 0
    flat = fit_quality(odd, labels.limit(0))
    assert {round(r.score, 1) for r in quality_scores(odd.where("doc_id = 5"), flat).collect()} == {0.5}
    assert TRAINING.count("doc_id") == 1


def test_scores_are_probabilities_when_labels_are_uneven():
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    true = 1 / (1 + np.exp(-(2.1 + x)))
    labels = (rng.random(2000) < true).astype(float)
    assert 0.8 < labels.mean() < 0.9
    machine = Machine().fit([(np.array([3]), np.array([v])) for v in x], labels)
    scores = np.array([1 / (1 + np.exp(-machine.raw(np.array([3]), np.array([v])))) for v in x])
    assert abs(scores.mean() - labels.mean()) < 0.04 and np.abs(scores - true).mean() < 0.06
    assert (scores[true > 0.65] >= 0.5).all()


BODY = "<p>First paragraph, with commas, and words.<p>Second &amp; <b>bold</b>\n text &lt;here&gt;, more of it.</p>"
SHELLS = [
    "<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy, now, cheap, things</div><article><h1>Title</h1>{}</article><footer>Foot, note</footer></body></html>",
    "<body><header><a href=/>Site</a></header><main><header><h1>Title</h1></header>{}<aside>Side</aside><form><label>Mail</label><input></form></main></body>",
    "<div id=page><div class=sidebar><p>Side text, that is, long enough, to count, for something, else.</p></div><div class='post-content'><h1>Title</h1>{}</div><div id='comments'><p>I, too, think, so, very, much, indeed, yes.</p></div></div>",
    "<body><div class=cookie-notice>We use cookies, lots, of, them.</div><section class=main><h1>Title</h1>{}</section><script>var a='<p>no</p>';</script><style>p{{x:y}}</style></body>",
]


def test_boilerplate_of_several_layouts_is_left_out():
    want = "Title\nFirst paragraph, with commas, and words.\nSecond & bold text <here>, more of it."
    for shell in SHELLS:
        assert main_text(shell.format(BODY)) == want, shell


LONG = "<p>" + "A long sentence, of several words, and a comma. " * 12 + "</p>"


def test_names_do_not_delete_inside_the_article():
    named = "<h2 id=related-work>Related</h2><p>Work, of others.</p><section id=discussion><p>We discuss, at length.</p></section><p class=warning>Mind the gap.</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>"
    want = "Related\nWork, of others.\nWe discuss, at length.\nMind the gap.\nSo x=1."
    for shell in ("<article><h1>T</h1>{}{}</article>", "<div class='post-content has-sidebar'><h1>T</h1>{}{}</div>", "<div id=a><div class=search>Find, this</div></div><main><h1>T</h1>{}{}</main>"):
        lines = main_text(shell.format(LONG, named)).split("\n")
        assert lines[0] == "T" and lines[1].startswith("A long") and "\n".join(lines[2:]) == want, shell
    assert main_text(f"<div class=widget>{LONG}</div>").startswith("A long")


def test_linked_blocks_of_the_article_are_kept():
    linked = "<h1><a href=#t>Title</a></h1>{}<p><a href=x>One link only</a></p><ol><li><a href=a>First reference</a></li><li><a href=b>Second</a></li></ol>"
    for shell in ("<nav><a href=/>Menu</a></nav><article>{}</article>", "<div><div id=content>{}</div><div><a href=x>Elsewhere</a></div></div>"):
        lines = main_text(shell.format(linked.format(LONG))).split("\n")
        assert [lines[0], *lines[2:]] == ["Title", "One link only", "First reference", "Second"], shell


READERS = "<p>I, for one, do not agree with this, and I have read it twice.</p><p>Thank you, this was, as ever, a pleasure to read.</p>"
BOILERPLATE = [
    f"<section class=comments id=comments><h3>Comments</h3>{READERS}</section>", f"<ol class='comment-list'><li><article class=comment>{READERS * 2}</article></li></ol>", f"<div id=disqus_thread>{READERS}</div>",
    f"<article class=comment>{READERS}</article>", f"<div class=post-comments>{READERS}</div>", "<div class=ad>Buy now, while it is cheap, and tell your friends.</div>", "<div class=advert><p>Buy now, today, here.</p></div>",
    "<div class=ad-slot-top>Advertisement</div>", "<div class='share social'><a href=x>Share</a> <a href=y>Send</a></div>", "<ul class=share-buttons><li>Share</li><li>Send</li></ul>",
    "<div class=newsletter><h4>Stay informed</h4><p>Join our letter, it is free, and leave whenever you want.</p></div>", "<div class=newsletter-signup-box><p>Join us, please.</p></div>",
    "<p class=cookie-notice>We use cookies, as everybody does, to make this site better.</p>", "<div class=notice>This site moves, on Monday, to a new address.</div>", "<div class=pagination>1 2 3 4</div>", "<div class=breadcrumbs>Home / News</div>",
    "<div class=related><ul><li><a href=a>A first story to read</a></li><li><a href=b>A second story, to read after it</a></li></ul></div>", "<div class=related-posts><p>A story, and another story.</p></div>", "<div class=tags>one two three</div>",
    "<div class=sidebar><p>About us, briefly, and where we are.</p></div>", "<div class=widget><p>The weather, today, is fine.</p></div>", "<ul class=menu><li>Home</li><li>News</li></ul>", "<div role=navigation>Home</div>", "<aside>Elsewhere, too.</aside>",
    "<form><p>Name, please.</p></form>", "<div hidden>Not shown, at all.</div>", "<div style='display: none'>Not shown, at all.</div>", "<div class=login-form>Enter your name, and then your word.</div>",
]


def test_boilerplate_inside_the_article_is_left_out():
    text = "\n".join(["Title", LONG[3:-4].strip(), LONG[3:-4].strip()])
    for shell in ("<article><h1>Title</h1>{p}{x}{p}</article>", "<div class=content><h1>Title</h1>{p}{p}{x}</div>", "<main><h1>Title</h1><div>{p}{x}{p}</div></main>", "<div class='post-content has-sidebar'>{x}<h1>Title</h1>{p}{p}</div>"):
        for x in [*BOILERPLATE, "".join(BOILERPLATE)]:
            assert main_text(f"<html><body>{shell.format(p=LONG, x=x)}</body></html>") == text, (shell, x)


def test_boilerplate_beside_the_article_is_left_out():
    text = "\n".join(["Title", LONG[3:-4].strip(), LONG[3:-4].strip()])
    for x in [*BOILERPLATE, "".join(BOILERPLATE)]:
        assert main_text(f"<html><body><div>{x}<article><h1>Title</h1>{LONG * 2}</article>{x}</div></body></html>") == text, x


def test_doubtful_names_with_sentences_stay():
    said = "A sentence, and what follows from it, in full length. And a second one, to be sure."
    for x in (f"<p class=warning>{said}</p>", f"<section id=discussion><p>{said}</p></section>", f"<section id=related-work><p>{said}</p></section>", f"<div role=alert><p>{said}</p></div>", f"<div class=comments-on-theory><p>{said}</p></div>",
              f"<div id=search><p>{said}</p></div>", f"<div class=disclaimer>{said}</div>"):
        assert said in main_text(f"<article><h1>Title</h1>{LONG}{x}</article>").split("\n"), x
    for head in ("<h2 id=comments>Remarks</h2>", "<h2 class=share>Remarks</h2>", "<h3 id=related-work>Remarks</h3>"):
        assert "Remarks" in main_text(f"<article><h1>Title</h1>{head}{LONG}</article>").split("\n")


def test_article_and_main_are_ranked_with_the_others():
    long = LONG[3:-4].strip()
    card = "<article><h3>Card</h3><p>A teaser.</p></article>"
    assert main_text(f"<body><div id=content><h1>T</h1>{LONG}</div><div>{card}</div></body>") == f"T\n{long}"
    assert main_text(f"<main><h1>T</h1>{LONG}{card}</main>") == f"T\n{long}\nCard\nA teaser."
    assert main_text(f"<main><h1>T</h1><article>{LONG}</article></main>") == f"T\n{long}"
    assert main_text(f"<main><header><h1>T</h1></header><article>{LONG}</article><div class=comments><p>I, too, think so.</p></div></main>") == f"T\n{long}"
    assert main_text(f"<main><div class=content>{LONG}</div><div class=comments><p>I, too, think so.</p></div></main>") == long
    # One long section does not stand for its article, nor one card for a list of them.
    assert main_text(f"<article><h1>T</h1><section>{LONG * 9}</section><section><p>Short.</p></section></article>").split("\n")[-1] == "Short."
    assert main_text(f"<main>{card * 9}</main>").count("A teaser.") == 9


def test_pages_of_the_tables(spark):
    got = QUERIES["op3_main_text"](spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html
    import re

    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", inner)))
        lines = [" ".join(html.unescape(x).split()) for x in inner.split("\0")]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    deep = "<div>" * 2000 + "deep, text" + "</span>" * 50
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain, text"), (3, "u", deep), (3, "u", deep), (4, "u", "<p>" + "long, word " * 50_000), (5, "u", "<nav>only <a>menu</a></nav>"), (6, "u", "<p class=\"x>broken")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("points", F.lit(1))
    got = sorted([tuple(r) for r in extract_pages(df).collect()], key=str)
    assert [(i, t) for i, _, t in got if i != 4] == [(1, ""), (2, ""), (3, "deep, text"), (3, "deep, text"), (5, ""), (6, got[-2][2]), (None, "plain, text")]
    assert [t for i, _, t in got if i == 4] == [("long, word " * 50_000).strip()]
    assert extract_pages(df.limit(0)).count() == 0


def test_registration():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == [n for k in range(1, 14) for n in QUERIES if n.startswith(f"op{k}_")]
    assert len(QUERIES) == 13 and "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()


def test_pipeline_stage_by_stage(spark):
    """Every stage on a small table with planted copies, against plain Python on that stage's own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120")
    docs = docs.unionByName(docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 5000))
    # Whole sentences of their own make near copies that line dedup leaves alone.
    words = [f"near copy word {k}" for k in range(60)]
    near = [(6000 + k, " ".join(words[: 60 - k]) + f" end {k}", "en", "src1", 0) for k in range(3)]
    docs = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = stage(spark, docs, SMALL).cache()
        rows = after.collect()
        if name != "best_fit_packing":
            assert after.columns == columns
        if name == "quality_filter":
            scores = {x.doc_id: x.score for x in quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), train=F.expr(TRAINING))).collect()}
            assert sorted(rows) == sorted(x for x in before if scores[x.doc_id] >= 0.5) and 0 < len(rows) < len(before)
        elif name == "line_dedup":
            assert sorted((x.doc_id, x.text) for x in rows) == [x[:2] for x in sorted(brute_lines([(x.doc_id, x.text) for x in before]))]
            assert all(x.n_chars == len(x.text) for x in rows) and {x.text for x in rows} != {x.text for x in before}
        elif name == "near_dedup":
            groups = brute_components([(x.doc_id, x.text) for x in before], 5, 80)
            assert sorted(x.doc_id for x in rows) == sorted(i for i, _, c in groups if i == c) and len(rows) < len(before)
        elif name == "source_mixing":
            copies = brute_copies([(x.doc_id, x.text, x.source) for x in before])
            assert Counter(x.doc_id for x in rows) == Counter({i: n for i, n in copies.items() if n})
        else:
            lengths = Counter()
            for x in rows:
                lengths[x.doc_id] += x.length
            lib = loaded(vocabulary_path()).library
            assert lengths == sum((Counter({x.doc_id: len(lib.encode(x.text, add_special_tokens=False).ids) + 1}) for x in before), Counter())
            assert check_packed(rows, 2048) == best_fit_decreasing([x.length for x in rows], 2048)
        docs = after


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none):
    """Nulls, ties, repeated rows, very long texts and clashing columns in every stage; the columns stay those given."""
    rows = odd.collect()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, odd, SMALL)
        got = after.collect()
        assert stage(spark, none, SMALL).count() == 0, name
        if name == "best_fit_packing":
            tokens = Counter()
            for x in got:
                tokens[x.doc_id] += x.length
            lib = loaded(vocabulary_path()).library
            assert tokens == sum((Counter({x.doc_id: len(lib.encode(x.text or "", add_special_tokens=False).ids) + 1}) for x in rows), Counter())
            assert all(0 <= x.offset and x.offset + x.length <= 2048 for x in got)
            continue
        assert after.columns == odd.columns, name
        if name == "line_dedup":
            assert sorted(str(tuple(x)[2:4]) for x in got) == sorted(str(tuple(x)[2:4]) for x in rows)
            assert sorted((str(x.doc_id), x.text) for x in got) == sorted((str(i), t) for i, t, *_ in brute_lines([(x.doc_id, x.text) for x in rows]))
        elif name == "near_dedup":
            gone = {i for i, _, c in brute_components([(x.doc_id, x.text) for x in rows], 5, 80) if i is not None and i != c}
            assert sorted(map(str, got)) == sorted(str(x) for x in rows if x.doc_id not in gone)
        else:
            assert {str(x) for x in got} <= {str(x) for x in rows}, name
