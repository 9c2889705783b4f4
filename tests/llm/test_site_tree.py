from sparkvec.llm import site_tree as S


def text(page):
    return [(t, p) for _, t, p in S.judged(page)[0]]


def test_malformed_markup():
    assert text("<article><h1>A&amp;amp;B</h1><p>one <b>two<br><p>three\n  four&nbsp;five<p>cut <b") == [
        ("A&amp;B", 1.0), ("one two", 1.0), ("three four five", 1.0), ("cut", 1.0)]
    assert text("<article>a < b and c<!-- hidden <p>x --><script>if (a</b) '</p>'</script> d</article><script>open") == [("a < b and c d", 1.0)]
    assert text("<article><p>see <a href='x>y'>this</a>.</p></ARTICLE ></div>") == [("see this.", 1.0)]
    assert text("") == text("<b") == [] and text("a <") == [("a <", 0.5)]


def test_furniture_stays_furniture():
    page = ("<header>h</header><nav><ul><li>m<li>n</ul></nav><article><header><h1>T</h1></header><p>P<div class='share-box'>S</div><form>F</form>"
            "<section id=comments><p>C</section></article><aside>a</aside><div class=cookie-notice>n</div><p>stray<footer>f</footer>")
    assert [t for t, p in text(page) if p == 1.0] == ["T", "P"]
    assert ("stray", 0.25) in text(page)


def test_the_surest_mark_decides():
    wrapped = "<div id=content><div class=x>Wrapper text</div><main><p>Around it<article><p>The text of the article itself</article></main></div>"
    assert [t for t, p in text(wrapped) if p == 1.0] == ["The text of the article itself"]
    cards = "<main><p>" + "A long text in the main part. " * 9 + "<article class=teaser><p>Card</article></main><div class=ad2>x</div>"
    assert [t[:6] for t, p in text(cards) if p == 1.0] == ["A long", "Card"]
    assert [t for t, p in text("<div class=entry><p>Yes<ol class=commentlist><li>No</ol></div>") if p == 1.0] == ["Yes"]


def test_words_for_the_layout_of_a_page_are_no_furniture():
    page = "<body class='single sidebar-right'><div class='wrap has-sidebar'><p>Kept</p><div class=sidebar>x</div></div>"
    assert [t for t, p in text(page) if p > 0] == ["Kept"]


def test_slugs_of_titles_inside_the_main_text_are_no_furniture():
    page = ("<article><h2 id=cookie-baking>A</h2><section id=discussion><p>B</section><h2 id=related-work>C</h2><h2 id=search-results>D</h2>"
            "<section id=legal-history><p>E</section><p id=commentary>F</p><div class=menu-recipe>G</div><p class=commentary>H</p>"
            "<div class='share-box'>x</div><div class=cookie-banner>x</div><div class=sidebar>x</div><div class='ad-unit'>x</div>"
            "<div id=comments>x</div><ol class=commentlist><li>x</ol><div role=navigation>x</div></article><div id=legal-history>y</div>")
    assert [t for t, p in text(page) if p == 1.0] == list("ABCDEFGH")
    assert [p for t, p in text(page) if t in "xy"] == [0.0] * 8


def test_statistics_decide_where_markup_is_silent(spark):
    rows = [(i, f"http://host.example/{i}", f"<body><div class=k1>Same line on every page</div><div class=k2><p>Own text number {i}</p></div></body>") for i in range(20)]
    rows += [(100, "http://other.example/", "<body><div class=k1>Alone here</div></body>"), (101, None, None), (102, "no url", "")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, at int, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in S.extract(pages).collect()}
    assert all(got[i][0] == f"Own text number {i}" for i in range(20))
    assert got[100] == ("Alone here", 10) and got[101] == got[102] == ("", 0)


def hosted(spark, bodies, host="host.example"):
    rows = [(i, f"http://{host}/{i}", f"<body>{body}</body>") for i, body in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


LINE = "Read this and more in print."


def test_repeated_branches_leave_the_article(spark):
    article = "<article><h1>Title {0}</h1><p>Some text of page {0} alone.</p><p>More words of {0}.</p>{1}</article>"
    in_paragraph = hosted(spark, [article.format(i, f"<p>{LINE}</p>") for i in range(30)])
    assert all(in_paragraph[i] == f"Title {i}\nSome text of page {i} alone.\nMore words of {i}." for i in range(30))
    in_branch = hosted(spark, [article.format(i, f"<div class=x><p>{LINE}</p></div>") for i in range(30)])
    assert in_branch == in_paragraph
    few = hosted(spark, [article.format(i, f"<p>{LINE}</p>") for i in range(4)])
    assert all(few[i].endswith(LINE) for i in range(4))
    shared = hosted(spark, [article.format(i, f"<p>{LINE}</p>" if i % 3 == 0 else "") for i in range(30)])
    assert all(shared[i].endswith(LINE) == (i % 3 == 0) for i in range(30))


def test_varied_text_outside_the_mark_comes_back(spark):
    body = "<div class=post><p>Short lead of the story {0} that stands here.</p></div><div class=rest><p>The long body of the story {0} that has no mark of its own.</p></div><div class=z>{1}</div>"
    got = hosted(spark, [body.format(i, LINE) for i in range(30)])
    assert all(got[i] == f"Short lead of the story {i} that stands here.\nThe long body of the story {i} that has no mark of its own." for i in range(30))
    assert hosted(spark, [body.format(0, LINE)])[0] == "Short lead of the story 0 that stands here."


def test_copies_and_near_copies_of_a_page_keep_their_text(spark):
    article = "<article><h1>One title</h1><p>{0}</p><p>The same words at length on all of these pages.</p></article>"
    assert set(hosted(spark, [article.format("Same")] * 40).values()) == {"One title\nSame\nThe same words at length on all of these pages."}
    near = hosted(spark, [article.format(f"Edit {i}") for i in range(40)])
    assert all(near[i] == f"One title\nEdit {i}\nThe same words at length on all of these pages." for i in range(40))


def test_importance_against_counts(spark):
    import math
    import random
    from collections import Counter, defaultdict
    draw = random.Random(5)
    pages = [(i, draw.choice("ab"), "<body>" + "".join(f"<div class=k{draw.randrange(3)}><p>t{draw.randrange(5)}</p></div>" for _ in range(draw.randrange(1, 5))) + "</body>")
             for i in range(60)]
    blocks = S.block_table(spark.createDataFrame(pages, "key bigint, host string, html string")).cache()
    told, shows, looks = {}, defaultdict(set), defaultdict(set)
    for r in blocks.collect():
        shows[r.host, r.path, r.content].add(r.digest)
        looks[r.host, r.path, r.layout].add(r.digest)
    contents, paths = S.importance(blocks)
    assert {(r.host, r.path, r.content): r.pages for r in contents.collect()} == {k: len(v) for k, v in shows.items()}

    def entropy(counts):
        return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
    for r in paths.collect():
        told[r.host, r.path] = r
        of_content = [len(v) for k, v in shows.items() if k[:2] == (r.host, r.path)]
        of_layout = [len(v) for k, v in looks.items() if k[:2] == (r.host, r.path)]
        assert r.m == sum(of_layout) == len(set().union(*[v for k, v in shows.items() if k[:2] == (r.host, r.path)]))
        if r.m > 1:
            assert abs(r.content_importance - entropy(of_content) / math.log(r.m)) < 1e-9
            assert abs(r.layout_importance - entropy(of_layout) / math.log(r.m)) < 1e-9
    assert len(told) == len(Counter(k[:2] for k in shows))


def test_repeated_rows_null_ids_and_empty_table(spark):
    page = "<article><p>Text of it</p></article><footer>x</footer>"
    pages = spark.createDataFrame([(None, "u", page), (1, "u", page), (1, "u", page)], "page_id bigint, url string, html string")
    assert [r["text"] for r in S.extract(pages).collect()] == ["Text of it"] * 3
    assert S.extract(pages.limit(0)).count() == 0


def test_every_article_of_the_pages(spark, sf_dir):
    import html
    import re

    from sparkvec.llm.queries import QUERIES
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op8_main_text"](spark, sf_dir).collect():
        inner = sources[r["page_id"]].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1|div)[^>]*>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])
