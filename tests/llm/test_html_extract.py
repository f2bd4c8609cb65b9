import html
import re

from tidemark.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li>{0} more</li></ul></nav><!-- <p>no</p> --><div class="ad">Buy {0}</div>
<div class="cookie-x notice">We use cookies</div>
<article><h1>Title&nbsp;{0} &amp; co</h1><p><b>One  {0}<br>
two</b> thr<i>ee</i><p>Second &lt;{0}&gt;.</p>{1}<section class="comments"><p>Nice post {0}</p></section></article>
<aside><p>Side</p></aside><form><p>Sign up</p></form><footer>&copy; {0}</footer></body></html>"""


def plain(text):
    """What the synthetic pages hold between article tags, block by block, by a plain reading."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", text, re.S)
    out = []
    for block in re.split(r"</?(?:p|h1|h2|ul|li|article|footer)\b[^>]*>", body[1]):
        words = " ".join(html.unescape(re.sub(r"</?b>", "", block.replace("<br>", " "))).split())
        if words:
            out.append(words)
    return out


def test_article_alone_is_kept():
    pages = [PAGE.format(k, "<p>Extra</p>" * (k % 3)) for k in range(6)]
    wrapper = he.infer(pages)
    for k, p in enumerate(pages):
        assert he.read(wrapper, p) == [f"Title {k} & co", f"One {k} two three", f"Second <{k}>."] + ["Extra"] * (k % 3)


def test_wrapper_finds_slots_options_and_repeats():
    wrapper = he.infer(["<div><h2>A</h2><p>x</p><p>y</p><hr></div>", "<div><h2>A</h2><p>z</p></div>", "<div><h2>A</h2><p>x</p><ul><li>1<li>2</ul></div>"])
    div = wrapper["in"][0]
    parts = {he._key(p)[0]: p for p in div["in"]}
    assert parts["h2"]["in"][0]["text"] == "A" and not parts["h2"]["opt"]
    assert parts["p"]["many"] and parts["p"]["in"][0]["text"] is None
    assert parts["hr"]["opt"] and parts["ul"]["opt"] and parts["ul"]["in"][0]["many"]


def test_pages_without_semantic_tags_use_the_variable_part():
    page = '<html><body><div id="top">Site</div><div class="x"><div class="y"><p>{0} long enough text that varies</p><p>more {0}</p></div></div><div>All rights</div></body></html>'
    pages = [page.format(f"page {k}") for k in range(5)]
    wrapper = he.infer(pages)
    assert he.read(wrapper, pages[2]) == ["page 2 long enough text that varies", "more page 2"]
    assert he.read(wrapper, page.format("unseen")) == ["unseen long enough text that varies", "more unseen"]


def test_broken_markup():
    for text in ("", "plain words", "<", "<p", "<article><p>a<b>b", "<div class='", "</p></div>", "<script>never closed", "<article><table><tr><td>1<td>2<tr><td>3", "<p \"'>x</p>" * 50):
        he.read(he.infer([text]), text)
    assert he.read(he.infer(["<article><p>a<b>b"]), "<article><p>a<b>b") == ["ab"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "<article>y</article>"
    assert "y" in he.read(he.infer([deep]), deep)


def test_whole_table_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = spark.createDataFrame([(-1, None, None), (-2, "http://a.example/x", ""), (-3, "nonsense", "<article>hi</article>")], pages.schema)
    rows = {r.page_id: r for r in pages.union(more).collect()}
    got = he.extract(pages.union(more).withColumn("host", pages.url)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "\n\n".join(plain(rows[r.page_id].html)) if r.page_id >= 0 else {-1: "", -2: "", -3: "hi"}[r.page_id]
        assert r.text == want and r.n_chars == len(want) and r.url == rows[r.page_id].url
    assert he.extract(pages.limit(0)).count() == 0


def test_a_text_is_template_only_where_nearly_all_distinct_pages_have_it():
    page = '<html><body><div>Top</div><div class="x"><p>{0} text that varies from page to page</p>{1}</div></body></html>'
    more = {2: "<h2>Background</h2>", 4: "<h2>Background</h2>", 5: "<ul><li>same</li><li>same</li></ul>"}
    pages = [page.format(f"page {k}", more.get(k, "")) for k in range(6)]
    wrapper = he.infer([*pages, pages[2], pages[5], pages[5]])
    for k, extra in ((2, ["Background"]), (4, ["Background"]), (5, ["same", "same"]), (0, [])):
        assert he.read(wrapper, pages[k]) == [f"page {k} text that varies from page to page", *extra]
    always = [page.format(f"page {k}", "<h2>Contents</h2>") for k in range(6)]
    assert he.read(he.infer(always), always[1]) == ["page 1 text that varies from page to page"]


def test_copies_of_a_page_are_no_template(spark):
    copy = '<html><body><div class="x"><p>one text and another</p><h2>Only here</h2></div></body></html>'
    other = '<html><body><div class="x"><p>quite different words {0}</p></div></body></html>'
    rows = [(k, "http://h.example/a", copy) for k in range(30)] + [(100 + k, "http://h.example/b", other.format(k)) for k in range(5)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "one text and another\n\nOnly here" for k in range(30))
    assert all(got[100 + k] == f"quite different words {k}" for k in range(5))


def test_a_page_of_another_template_is_not_empty():
    wrapper = he.infer([PAGE.format(k, "") for k in range(6)])
    bare = '<html><body><nav>Home</nav><div class="story"><p>Text in a plain element</p></div><footer>f</footer></body></html>'
    assert he.read(wrapper, bare) == ["Text in a plain element"]
    page = '<html><body><div>Top</div><div class="x"><div><p>{0} long enough text</p></div></div></body></html>'
    assert he.read(he.infer([page.format(k) for k in range(6)]), bare.replace("div", "section")) == ["Text in a plain element"]


def test_the_wrapper_decides_where_a_page_alone_cannot():
    page = '<html><body><div class="a"><p>{0}</p></div><div class="b"><p>{1}</p><p>{2}</p></div><div class="c">{3}</div></body></html>'
    long = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    pages = [page.format(f"Buy {k}", long(k), long(k + 50), f"Links {k}") for k in range(8)]
    odd = '<html><body><div class="a"><p>Buy all of this now</p><p>an offer that goes on</p></div><div class="b"><p>Short text.</p></div><div class="c">Links</div></body></html>'
    wrapper = he.infer([*pages, odd])
    assert he.read(wrapper, odd) == ["Short text."]
    nothing = {"tag": "", "marks": [], "in": [], "opt": False, "many": False}
    assert he.read(nothing, odd) == ["Buy all of this now", "an offer that goes on"]


def test_names_only_tip_the_scales():
    page = '<html><body><div class="share"><p>{0}</p><p>more {0}</p><div class="related"><p>see {1}</p></div></div><div class="main-ish">{1}</div></body></html>'
    pages = [page.format(f"a long text number {k} that varies from page to page", k) for k in range(6)]
    assert he.read(he.infer(pages), pages[1]) == ["a long text number 1 that varies from page to page", "more a long text number 1 that varies from page to page"]
    teaser = '<html><body><aside><p>x</p></aside><section><article><p>see {1}</p></article></section><div><p>{0}</p><p>and {0}</p></div></body></html>'
    pages = [teaser.format(f"a long text number {k} that varies from page to page", k) for k in range(6)]
    assert he.read(he.infer(pages), pages[2])[0].startswith("a long text number 2")


def test_formulas_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> be</p><p><svg><text>Fig {0}</text></svg></p><select><option>no</option></select></article>"
    assert he.read(he.infer([page.format(k) for k in range(3)]), page.format(1)) == ["Let x=1 be", "Fig 1"]


def test_pages_without_names_against_truth(spark):
    """The synthetic pages with every telling name taken away, against what stood between the article tags."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.col("html")
    for k, name in enumerate(("article", "nav", "footer")):
        bare = F.regexp_replace(F.regexp_replace(bare, f"<{name}>", f'<div class="x{k}">'), f"</{name}>", "</div>")
    bare = F.regexp_replace(bare, 'class="ad"', 'class="x9"')
    truth = {r.page_id: "\n\n".join(plain(r.html)) for r in pages.collect()}
    got = {r.page_id: r.text for r in he.extract(pages.withColumn("html", bare)).collect()}
    alone = {r.page_id: "\n\n".join(he._read(None, he.parse(r.html))) for r in pages.withColumn("html", bare).collect()}
    right = lambda texts: sum(texts[i] == truth[i] for i in truth) / len(truth)
    print("by wrapper", right(got), "by the page alone", right(alone))
    assert right(got) > 0.95 and right(got) > right(alone)


def test_templates_and_repeated_rows(spark):
    one = '<html><body><div class="x"><p>{0} first template text</p><p>tail {0}</p></div></body></html>'
    two = '<html><body><section><h2>{0}</h2><p>{0} second template text</p></section><hr></body></html>'
    rows = [(k % 7, "http://h.example/a", (one if k % 2 else two).format(k)) for k in range(20)] + [(None, None, None), (None, "http://h.example/b", one.format(3))] * 2
    got = he.extract(spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string").repartition(5)).collect()
    want = [(i, "" if h is None else f"{k} first template text\n\ntail {k}" if "first" in h else f"{k}\n\n{k} second template text") for k, (i, _, h) in [*enumerate(rows[:20]), *((3, r) for r in rows[20:])]]
    assert sorted((r.page_id or -1, r.text) for r in got) == sorted((i or -1, t) for i, t in want)


def _texts(kind, n, k=0):
    return "".join(f"<p>{kind} {k} says number {i} of many things here</p>" for i in range(n))


def _kept(pages, k=0, kind="reader"):
    out = he.read(he.infer(pages), pages[k])
    return [b for b in out if kind not in b], [b for b in out if kind in b]


def test_comments_go_whatever_their_size():
    page = lambda k: f'<article><h1>Title {k}</h1>{_texts("writer", 4, k)}<section class="comments">{_texts("reader", 60, k)}</section></article>'
    for pages in ([page(0)], [page(k) for k in range(5)]):
        article, comments = _kept(pages)
        assert len(article) == 5 and not comments


def test_comments_go_where_nothing_names_itself_the_article():
    page = lambda k: f'<html><body><div class="x"><h1>Title {k}</h1>{_texts("writer", 4, k)}</div><section id="comments-{k}">{_texts("reader", 60, k)}</section></body></html>'
    for pages in ([page(0)], [page(k) for k in range(5)]):
        article, comments = _kept(pages)
        assert len(article) == 5 and not comments


def test_an_advert_as_long_as_the_text_goes():
    page = lambda k: f'<article>{_texts("writer", 4, k)}<div class="advert">{_texts("seller", 4, k)}</div></article>'
    for pages in ([page(0)], [page(k) for k in range(5)]):
        article, adverts = _kept(pages, kind="seller")
        assert len(article) == 4 and not adverts


def test_a_subheading_that_all_pages_share_stays_in_the_article():
    pages = [f"<article><h1>Title {k}</h1><h2>Summary</h2><p>Paragraph {k} of the text</p></article>" for k in range(6)]
    for n in range(1, 7):
        assert he.read(he.infer(pages[:n]), pages[0]) == ["Title 0", "Summary", "Paragraph 0 of the text"]


def test_long_unlike_pages_are_aligned_in_time():
    import time

    page = lambda seed: "<body>" + "".join(f'<div class="a{k * seed % 997}">x</div><p>text {k}</p><div class="rep">y</div>' for k in range(5_000)) + "</body>"
    began = time.perf_counter()
    he.infer([page(3), page(7)])
    assert time.perf_counter() - began < 10  # a second or two, where all pairs took an hour


def test_common_is_a_common_subsequence():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = he.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert he.common(list("xabcy"), list("abzc")) == [(1, 0), (2, 1), (3, 3)] and he.common(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def test_partial_wrappers_meet_in_a_tree(spark, monkeypatch):
    page = "<html><body><div class='m'><p>Text number {0} of this page</p><span>{1}</span></div><div class='f'>about us</div></body></html>"
    rows = [(k, f"http://h/{k}", page.format(k, "x" if k % 3 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    run = lambda: {r.page_id: r.text for r in he.extract(docs).collect()}
    whole = run()
    monkeypatch.setattr(he, "MERGE_GROUPS", 2)
    assert run() == whole and all(f"Text number {k} of this page" in t for k, t in whole.items())
