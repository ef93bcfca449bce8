"""Jaccard join, HTML extraction, language ID and the pipeline against brute force and held-out rows."""

import html
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from discloscope.llm import queries as Q
from discloscope.llm.components import connected_components
from discloscope.llm.html_wrapper import CHILDREN, KEY, OPTIONAL, REPEATED, extract_main_text, main_text, merged, page_wrapper
from discloscope.llm.jaccard_join import ngram_jaccard_join
from discloscope.llm.language_id import identify, train
from discloscope.llm.markup import parse
from discloscope.llm.shingles import parity, shingle_sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


# ---------------------------------------------------------------- shingles and the join
def test_shingle_sets_are_whole_and_exact():
    texts = ["a b c d e f", "A  b\nc D e\tF", "é É x", "one", "", None, " \n ", "a b c d", "w " * 5000, "x" * 3000 + " y"]
    for chunk in (1, 20, 1 << 22):
        got = list(shingle_sets(5, chunk)(pa.array(texts)))
        assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
        assert (got[0] == got[1]).all() and got[7][0] not in got[0] and (np.sort(got[0]) == got[0]).all()


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 300, 1500):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        x, y = parity(a), parity(b)
        if len(x) == len(y):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        half = len(x) // 2
        if half >= 8:
            bits = np.bincount((a & np.uint64(half * 64 - 1)).astype(int), minlength=half * 64) & 1
            assert (x[:half] ^ x[half:] == np.packbits(bits.astype(np.uint8)).view(np.uint64)).all()


def near_texts(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary, 30))
    texts = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(20, 150)))
        for _ in range(rng.integers(1, 9)):
            copy = list(base)
            for _ in range(rng.integers(0, 6)):
                copy[rng.integers(len(copy))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    texts += [f"{shared} {' '.join(rng.choice(vocabulary, rng.integers(5, 60)))}" for _ in range(60)]
    return texts


@pytest.mark.parametrize("small", [48, 3])
def test_join_against_all_pairs(spark, small):
    texts = near_texts() + ["", None, "one two", "ONE  two", "one two three", "a b c d e", "a b c d e"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, cls string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, small=small).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("few", [0, 10**9])
def test_join_by_blocks_and_recursion(spark, monkeypatch, few):
    """Regions beyond a block recur, and what is left is joined block by block; ids too many to broadcast meet by shuffle."""
    from discloscope.llm import jaccard_join
    for name, value in (("BLOCK", 6), ("FEW_COMPARISONS", few), ("BROADCAST_IDS", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = list(enumerate(near_texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()}
    assert got == brute(rows)


def test_join_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(5, long), (5, long), (None, long), (None, None), (7, long + " end"), (7, "other words are here now"), (2, "other words are here now")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 26, 5): 2, (None, 26, 5): 1, (None, 0, None): 1, (7, 27, 5): 1, (7, 1, 2): 1, (2, 1, 2): 1})
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


# ---------------------------------------------------------------- HTML
def test_article_without_the_rest():
    page = """<html><head><title>x</title><script>var t="</p><article>";</script></head><body><header class="site"><a>Home</a></header>
    <div id="cookie-notice">We use</div><main><article class="post"><header><h1>Title &amp; more</h1></header><p>One<b>bold</b> two&nbsp;three<br>four</p>
    <!-- no --><aside>rel</aside><div class="ad">buy</div><form>q<input></form><section id="comments"><article class="comment"><p>hi</article></section>
    <table><tr><td>c1<td>c2</table><p><b>End</article></main><div class="sidebar">s</div><footer>f</footer></body></html>"""
    assert main_text(page, set()) == "Title & more Onebold two three four c1 c2 End"
    assert main_text("", set()) == "" and main_text("plain &lt;text <a hre", set()) == "plain <text"
    assert main_text("<div>" * 5000 + "deep", set()) == "deep" and main_text("<script>x", set()) == ""


def test_wrapper_folds_and_aligns():
    one = page_wrapper(parse("<body><h2>a</h2><p>b</p><h2>c</h2><p>d</p><i></i></body>"))
    two = page_wrapper(parse("<body><h2>a</h2><p>b</p></body>"))
    body = merged(one, two)[CHILDREN][0]
    assert [(c[KEY], c[REPEATED], c[OPTIONAL]) for c in body[CHILDREN]] == [("(h2|p)", True, False), ("i", False, True)]


def test_pages_without_article_use_the_wrapper(spark):
    page = """<body><div><ul><li><a href=x>Home</a><li><a>About</a></ul></div><div class=content><p>Body text %s</p></div><p>All rights ours</p></body>"""
    rows = [(i, f"https://u@Host.example:80/{i}", page % i, "old") for i in range(4)] + [(9, None, None, "old"), (10, "", "", "old"), (9, None, None, "old")]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, Text string"))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted((r.page_id, r.text, r.n_chars) for r in out.collect())
    assert got == [(i, f"Body text {i}", 11) for i in range(4)] + [(9, "", 0), (9, "", 0), (10, "", 0)]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    rows = [(i, f"https://host.example/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_wrapper_decides_inside_articles(spark):
    page = """<body><nav><a>Home</a></nav><article><h1>Title %d</h1><p>Text %d</p><p>More <b>bold</b> %d</p><p>Thanks to <b>all</b></p>
    <div class="zz">Printed with care<p>by %d</p></div><ul class="qq"><li><a>See this</a></li><li><a>Look there</a></li></ul>
    <p>By <a>%d</a></p></article></body>"""
    got = texts_of(spark, [page % ((i,) * 5) for i in range(4)])
    assert got == [f"Title {i} Text {i} More bold {i} Thanks to all Printed with care by {i} By {i}" for i in range(4)]
    assert texts_of(spark, [f"<body><i>{i}</i><article><p>Same</article>" for i in range(4)]) == ["Same"] * 4


@pytest.mark.parametrize("pages", [2, 3, 50])
def test_articles_keep_what_they_share(spark, pages):
    """Headings, sentences and lead paragraphs of an article stay however many pages share them."""
    cake = """<article><h1>Cake %d</h1><p>We bake every week.</p><h2>Ingredients</h2><p>Flour %d</p><h2>Method</h2><p>Mix %d well</p>
    <ul><li><a>Book %d</a></li><li><a>Page %d</a></li><li><a>Note %d</a></li></ul><p>Serve cold.</p></article>"""
    got = texts_of(spark, [f"<body><div><p>All cakes</p></div>{cake % ((i,) * 6)}<footer>f</footer></body>" for i in range(pages)])
    assert got == [f"Cake {i} We bake every week. Ingredients Flour {i} Method Mix {i} well Book {i} Page {i} Note {i} Serve cold." for i in range(pages)]


def test_hidden_elements_go_first(spark):
    page = "<body><article><p>Body %d</p><p style='display:none'>x %d</p><p hidden>y</p></article></body>"
    assert texts_of(spark, [page % (i, i) for i in range(3)]) == [f"Body {i}" for i in range(3)]


def test_wrappers_by_shuffle(spark, monkeypatch):
    from discloscope.llm import html_wrapper
    pages = [f"<body><ul><li><a>Home</a><li><a>About</a></ul><div><p>Body text {i}</p></div></body>" for i in range(4)]
    want = texts_of(spark, pages)
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", 0)
    assert texts_of(spark, pages) == want == [f"Body text {i}" for i in range(4)]


def test_labels_stay_with_their_place(spark):
    menu = "<body><div><a>One</a> <a>Two</a></div><h1>Title %d</h1><div>The whole article %d</div></body>"
    assert texts_of(spark, [menu % (i, i) for i in range(2)]) == [f"Title {i} The whole article {i}" for i in range(2)]
    line = "<body><p>All the news</p><h1>Title %d</h1><p>First %d</p><p>Second %d</p></body>"
    assert texts_of(spark, [line % (i, i, i) for i in range(5)]) == [f"Title {i} First {i} Second {i}" for i in range(5)]


@pytest.mark.parametrize("page, text", [
    ("<div class='layout has-sidebar'><article><p>Body</article></div>", "Body"),
    ("<div id=page class='no-comments'><article><p>Body</article></div>", "Body"),
    ("<article class='post comments-open'><p>Body</article>", "Body"),
    ("<div class=sidebar><article><p>A whole body</article><aside>x</aside></div>", "A whole body"),
    ("<form><div><p>A whole body</p></div><div class=ad>x</div></form>", "A whole body"),
    ("<article><p>A body of text<section id=discussion>Two</section><div class='related-work'>Three</div><div class='search-results'>Four</div></article>",
     "A body of text Two Three Four"),
    ("<main><div>Long text that goes on for a while</div><article class=card>teaser</article></main>", "Long text that goes on for a while teaser"),
    ("<article><p>A whole body of text</article><div class='cookie-notice'>We use</div><div id='sidebar-2'>s</div>", "A whole body of text")])
def test_names_only_weigh_in(page, text):
    assert main_text(f"<body>{page}</body>", set()) == text


def test_given_pages(spark, sf):
    rows = Q.QUERIES["op8_html_extraction"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"<(?:/?(?:p|h1)|br)>", "\n", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


# ---------------------------------------------------------------- language ID
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = Q.QUERIES["op9_language_id"](spark, sf).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df.union(spark.createDataFrame([(90, None, "en"), (91, "x y", None), (92, "123", "fr")], df.schema)))
    asked = [(1, "The dog", "q"), (1, "The dog", "q"), (2, "die katze und", "q"), (3, None, "q"), (4, "12 !?", "q"), (5, "", "q"), (6, "der hund " * 200_000, "q")]
    out = identify(spark.createDataFrame(asked, "doc_id long, text string, Score string"), model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = sorted((r.doc_id, r.lang_pred) for r in out.collect())
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de")]
    nothing = train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in identify(df, nothing).collect()} == {("und", 0.0)}


def test_every_language_is_known(spark):
    rng = np.random.default_rng(1)
    letters = [chr(0x4e00 + i) for i in range(400)]
    own = [letters[5 * k:5 * k + 5] for k in range(70)]
    rows = [(100 * k + i, "".join(rng.choice(own[k], 30)), f"l{k:02}") for k in range(70) for i in range(2 if k == 69 else 6)]
    rows += [(6902, rows[-1][1], "l69")] * 50  # a repeated row takes no more than the places of its language
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=8)
    assert len(model.langs) == 70 and len(model.weights) == 1 << 16
    asked = spark.createDataFrame([(k, "".join(rng.choice(own[k], 30))) for k in range(70)], "doc_id long, text string")
    assert all(r.lang_pred == f"l{r.doc_id:02}" for r in identify(asked, model).collect())


def test_document_frequencies_of_all_rows(spark):
    from discloscope.llm.language_id import FEATURES, _coder, _document_frequencies, _grams
    df = spark.createDataFrame([("ab",)] * 30 + [("b!",)] * 7 + [("12",)], "text string").repartition(5)
    got = {r[0]: r[1] for r in df.mapInArrow(_document_frequencies(FEATURES), "feature int, df long").groupBy("feature").sum("df").collect()}
    a, b = _grams(_coder()("ab"))[0].tolist()
    assert (got[-1], got[a], got[b]) == (37, 30, 37)


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(list(texts.items())).items() if i == c}
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {"shard", "slot", *docs.columns} <= set(out[0].asDict())
    assert all(r.text == texts[r.doc_id] for r in out)


def test_near_copies_go_by_row(spark):
    words = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(3, words), (7, words + " end"), (7, other), (None, words), (None, "alone here"), (None, "alone here"), (8, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, words), (7, other), (None, "alone here"), (8, None), (9, None)], key=repr)


def test_pipeline_takes_odd_rows(spark, sf):
    words = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(40))
    rows = [(1, words, "en", None, 5, "x"), (1, words, "en", None, 5, "x"), (2, None, None, "s", None, "x"), (None, "le chat noir", "fr", "s", 1, "x"),
            (3, words + " more", "en", "t", 1, "x"), (4, "", "en", "s", 0, "x"), (5, "42", "de", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            # mixing may use the rows of a small source twice
            assert out.count() <= len(rows) * (2 if name == "source_mixing" else 1), name
            assert name == "sharding" or out.columns == docs.columns, name


# ---------------------------------------------------------------- SQL
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_match_sql(spark, sf, name):
    from check import compare, duck
    note = compare(Q.QUERIES[name](spark, sf), duck(sf), Q.SQL[name])
    assert note.startswith("ok"), note
