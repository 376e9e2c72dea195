"""Operators on pages and conversations."""

import base64
import hashlib
from collections import Counter

from receptorium.llm import html_text, quotes, url_tree, warc

ODD = [(None, None, None), (None, "x", ""), (99, "http://A.net", None), (99, "http://A.net", None), (7, "u\r\nX: y%", "same"), (8, None, "same"), (8, None, "same"), (9, "z", "same\r\n\r\n")]


def _odd(spark):
    return spark.createDataFrame([(*r, "c", 1) for r in ODD], "page_id long, url string, html string, _shard string, n int")


def test_archives_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(_odd(spark), allowMissingColumns=True)
    rows, best, seen, want = pages.collect(), {}, Counter(), Counter()
    key = lambda r: -1 if r.page_id is None else r.page_id
    for r in rows:
        best[r.html or ""] = max(best.get(r.html or "", -1), key(r))
    for r in rows:
        body, top = (r.html or "").encode(), best[r.html or ""]
        first = key(r) == top and not seen[r.page_id, body]
        seen[r.page_id, body] += first
        want[r.page_id, r.url, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first or top < 0 else top] += 1
    folder = warc.write_archives(pages, range_bytes=40_000, file_bytes=20_000)
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
    drop_url = lambda c: Counter({k[:1] + k[2:]: 0 for k in c}) + sum((Counter({k[:1] + k[2:]: n}) for k, n in c.items()), Counter())
    assert drop_url(got) == drop_url(want)
    again = warc.write_archives(pages.repartition(5), range_bytes=40_000, file_bytes=20_000)
    fs, path = warc._file_system(folder)
    other = warc._file_system(again)[1]
    names = sorted(f.base_name for f in fs.get_file_info(warc.pyarrow.fs.FileSelector(path)) if not f.base_name.startswith("."))
    assert len(names) > 3 and "manifest.tsv" in names
    assert all(fs.open_input_file(f"{path}/{n}").read() == fs.open_input_file(f"{other}/{n}").read() for n in names)
    small = Counter(r.record_type for r in warc.round_trip(_odd(spark), least_bytes=5).collect())
    assert small == {"response": 8}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.B.net/x?y", "https://b.example.net/en/5", "http://x.example.com/de/1#t", "https://org/fr/", "ftp://y.org/fr", "no scheme", None, "http://example.net", "http://n.com/a/1", "http://q?x"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge(table).collect()}
    assert got[0] == ("a.b.net", "/x", "net/", "block") and got[1] == ("b.example.net", "/en/5", "example.net/en/", "allow")
    assert got[2] == ("x.example.com", "/de/1", "example.com/de/", "block") and got[3] == ("org", "/fr/", "org/fr/", "allow")
    assert got[4][:3] == ("y.org", "/fr", None) and got[5][:3] == ("", "", None) == got[6][:3] and got[7][:3] == ("example.net", "", None) and got[9][:2] == ("q", "")
    assert url_tree.judge(table.limit(0)).count() == 0 and url_tree.judge(_odd(spark)).count() == 8


def test_templates_by_purity(spark):
    rows = [(n, f"http://h.io/spam/{n}.html", 1) for n in range(40)] + [(100 + n, f"http://h.io/news/{n}", 0) for n in range(40)] + [(200 + n, f"http://h.io/x{n}/a", 0) for n in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    got = {r.page_id: r for r in url_tree.judge(table.drop("blocked"), labels=table.select("page_id", "blocked")).collect()}
    assert got[0].template == "/spam/*" and got[100].template == "/news/*" and got[200].template == "/x{n}/*"
    assert [got[i].verdict for i in (0, 100, 200)] == ["block", "allow", "allow"]
    assert all(r.verdict == "allow" for r in url_tree.judge(table.drop("blocked")).collect())


def test_few_labels_reject_a_template(spark):
    rows = [(n, f"http://h.io/spam/{n}.html", 1) for n in range(400)] + [(1000 + n, f"http://h.io/news/{n}", 0) for n in range(400)] + [(2000, "http://o.io/a", 0)]
    table = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    labels = table.filter("page_id % 1000 < 40").select("page_id", "blocked")
    labels = labels.union(spark.createDataFrame([(50, None)], "page_id long, blocked int"))
    got = {r.page_id: r for r in url_tree.judge(table.drop("blocked"), labels=labels).collect()}
    few = {r.page_id: r for r in url_tree.judge(table.drop("blocked").filter("page_id % 1000 < 40"), labels=labels).collect()}
    assert [got[i].verdict for i in (0, 399, 1399)] == ["block", "block", "allow"] and got[0].template == "/spam/*"
    assert len(got) == 801 and all(abs(got[i].purity - few[i].purity) < 1e-9 for i in few)
    none = url_tree.judge(table.drop("blocked"), labels=labels.limit(0)).collect()
    assert {(r.verdict, r.purity) for r in none} == {("allow", 0.5)}
    rules = spark.createDataFrame([(1, "http://a.net/x/1"), (2, "http://a.net/x/2")], "page_id long, url string")
    plain = {unfitted: url_tree.judge(rules, rules=(("block", "a.net/x/1"),), unfitted=unfitted).filter("page_id = 2").first().purity for unfitted in (0, None)}
    assert plain[0] < plain[None]


def test_main_text(spark):
    tree = html_text.trained()
    page = ("<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=1>Home</a></nav><div class='ad'>Buy this now please</div><article><h1>A title</h1>"
            "<p>One &amp; two&nbsp;three\n four<br>five</p><p>x</p><ul class=share><li><a>f</a></li></ul></article><section id='comments'><p>Great post, I like it very much indeed</p></section>"
            "<footer>&copy; site</footer></body></html>")
    assert html_text.main_text(page, tree) == "A title One & two three four five x"
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<p", tree) == ""
    assert html_text.main_text("<article><p>cut off in the mid", tree) == "cut off in the mid"
    rows = html_text.extract(_odd(spark)).collect()
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows) and html_text.extract(_odd(spark).limit(0)).count() == 0
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in given:
        body = r.html.partition("<article>")[2].partition("</article>")[0]
        assert html_text.main_text(r.html, tree) == " ".join(html_text.entities.unescape(html_text.re.sub(r"<[^>]*>", " ", body)).split())


def test_names_and_hidden_attributes_lose_no_article():
    tree = html_text.trained()
    long = "word " * 30
    for page in (f'<body class="overflow-hidden"><article class="rounded overflow-hidden"><p>{long}</p></article></body>', f'<article title="A hidden valley" data-hidden><p>{long}</p></article>',
                 f'<div class="post hentry tag-python"><article><p>{long}</p></article></div>', f'<div class="has-sidebar content"><article><p>{long}</p></article></div>',
                 f'<div class="related"><article><p>{long}</p></article></div>', f'<article><h2 id="related-work"></h2><section id="search"><p>{long}</p></section></article>',
                 f'<body style="display:none"><noscript><article><p>{long}</p></article>', f'<style>p{{}}<article><p>{long}</p></article>'):
        assert html_text.main_text(page, tree) == long.strip(), page
    page = '<article><h1>Title</h1><h2 id="search">Search</h2><p id="tag-x">{}</p></article>{}'
    for part in ('<div class="main-menu">x</div>', '<ul id="share-buttons">x</ul>', "<div hidden>x</div>", '<div aria-hidden="true">x</div>', '<div style="display: none">x</div>',
                 '<div aria-label="Related posts"><article>x</article></div>', '<section id="comments"><article>x</article></section>'):
        assert html_text.main_text(page.format(long, part), tree) == f"Title Search {long.strip()}", part
    main = f'<main><article><p>{long}</p></article><section id="comments"><p>x</p></section></main>'
    assert html_text.main_text(main, tree) == long.strip()


def test_pages_without_article_keep_short_text():
    tree, long = html_text.trained(), "lorem ipsum dolor sit amet " * 6
    text = (f"<h1>A title</h1><p>By someone</p><p>{long}</p><h2>Part</h2><p>Short one.</p><ul><li>one</li><li>two words</li><li>three</li></ul><p>{long}<a href=x>link</a></p>"
            f"<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><h2>End</h2><p>{long}<a href=y>and more</a></p><p>Bye now.</p>")
    whole = " ".join(html_text.re.sub(r"<[^>]*>", " ", text).split())
    for before in ("", "<nav><a href=1>Home</a></nav>", "<div><a href=1>Home</a></div><div><a href=2>About us</a></div>"):
        for frame in ('<div class="content">{}</div>', "<div><div>{}</div></div>", "{}"):
            for after in ("", "<footer>foot</footer>", '<div class="sidebar">x y z</div>'):
                assert html_text.main_text(before + frame.format(text) + after, tree) == whole
    assert html_text.main_text(f'<div class="content"><p>{long}</p></div><div class="related"><article>teaser</article></div>', tree) == long.strip()


def test_quotation_linking(spark):
    rows = [(1, 0, "user", "Hello there, how are you?\nSecond line here.\n\nAnother paragraph of text."), (1, 1, "a", "> Hello there, how are you?\n\nFine thanks."),
            (1, 2, "u", "Bob wrote:\n> > hello there how ARE you\n> Fine thanks.\nGood."), (1, 3, "x", "> another paragraph of text\nYes."), (1, 4, "x", "no quotes"),
            (1, 5, "y", "> unknown stuff\nhm"), (2, 0, "u", None), (None, 1, "u", "> Fine thanks."), (1, 2, "u", "Bob wrote:\n> Fine thanks.\nGood.")]
    got = quotes.link(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")).collect()
    own = sorted((r.position, r.turn, r.parent_turn, r.body, r.reply_path) for r in got if r.conv_id == 1)
    assert [(t, p) for _, t, p, *_ in own] == [(0, None), (1, 0), (2, 1), (2, 1), (3, 0), (4, None), (5, None)]
    assert [b for *_, b, _ in own][1:] == ["Fine thanks.", "Good.", "Good.", "Yes.", "no quotes", "hm"] and own[2][4] == [0, 1, 2]
    assert len(got) == len(rows) and quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_threads(spark):
    rows = [(1, n, "u", (f"> message number {n - 1}\n" if n else "") + f"message number {n}") for n in range(40)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.reply_path == list(range(r.turn + 1)) and r.position == r.turn for r in got)


def test_deep_branches_are_told_apart(spark):
    rows = [(i, f"http://h.org/a/b/c/d/e/f/{'spam' if i < 40 else 'news'}/x") for i in range(70)]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows] + [(100, "http://h.org/" + "z/" * 5000, None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, i < 40) for i in range(70)], "page_id long, blocked boolean")
    found = {r.page_id: r.verdict for r in url_tree.judge(pages, labels=labels).collect()}
    assert {found[i] for i in range(40)} == {"block"} and {found[i] for i in range(40, 70)} == {"allow"} and 100 in found


def test_extreme_ids_round_trip(spark):
    ids = [-(2**63), 2**63 - 1, 0, -1, None, 7]
    for take in (ids, [-(2**63), -(2**63) + 1, None], [3, 4, None]):
        pages = spark.createDataFrame([(i, "http://h/", f"body {i}") for i in take], "page_id long, url string, html string")
        found = {r.page_id: r.record_type for r in warc.round_trip(pages).collect()}
        assert found == dict.fromkeys(take, "response")


def test_comments_and_adverts_by_name():
    tree = html_text.trained()
    text = "<p>" + "own words of the text " * 8 + "</p>"
    for name in ("reader-comments", "user-comments", "comment-body", "sponsored-content", "advertisement-top"):
        page = f"<body><article><h1>Title here</h1>{text}<div class='{name}'><p>{'not of the text ' * 8}</p></div></article><div class='{name}'><p>{'nor this one ' * 8}</p></div></body>"
        found = html_text.main_text(page, tree)
        assert found.startswith("Title here own words") and "not of" not in found and "nor this" not in found, name
    for page in (f"<body><div class='post tag'><h1>Title</h1>{text}</div></body>", f"<body class='has-comments'><div class='content no-ads'>{text}</div></body>"):
        assert "own words of the text" in html_text.main_text(page, tree)
    assert html_text.main_text("just plain words of a page without any tag", tree) == "just plain words of a page without any tag"
    assert html_text.main_text("<body>some words <b>and more</b></body>", tree) == "some words and more"
    assert html_text.main_text("<nav>Home About</nav><footer>end</footer>", tree) == "" and html_text.main_text("", tree) == ""


def test_deep_nesting_takes_linear_time():
    import time

    tree = html_text.trained()
    for page in ("<div class=ad>x" * 50_000, "<div>x</span>" * 50_000, "<svg>x" * 50_000, "<style>x" * 20_000, "<div class=ad>x" * 30_000 + "</p></div>" * 30_000):
        start = time.time()
        html_text.main_text(page, tree)
        assert time.time() - start < 15
