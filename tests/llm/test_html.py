from grovespark.llm import html_extract as h


def text(html, templates=()):
    return h.Page(html).main_text(set(templates))


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad > <p>no</p> --><div class="ad">buy</div><header>Site</header>
    <article><header><h1>A &amp; B</h1></header><p><b>One
      two<br>three.<br><p>Four&nbsp;&lt;five&gt; 1 < 2</p><form>mail <input></form><div id="comments"><p>I agree</p></div>
    <section class="userComments"><p>nice</p></section></article><aside>side</aside><div class=cookieNotice>ok?</div><footer>&copy; x</footer>"""
    assert text(page) == "A & B\nOne two three.\nFour <five> 1 < 2"


def test_without_article():
    page = '<body><div class="menu"><a>x</a></div><ul><li><a href=a>one</a><li><a href=b>two</a></ul><div id=content><p>Real text.<table><tr><td>a<td>b</table></div></body>'
    assert text(page) == "Real text.\na\nb"
    assert text(None) == text("") == text("<nav>x</nav>") == ""
    assert text("plain") == "plain"
    assert text('<main><p title="a > b">x</p></main><p>y</p>') == "x"


def test_odd_markup_ends():
    for page in ("<", "<a", "<!--", "<p" * 5000, "<div>" * 20_000 + "x", "</p>" * 100, "<script>", '<a "' * 3000, "<a href='>x", "&#xD800; &#0; &bogus;"):
        text(page)
    assert text("<div>" * 20_000 + "x") == "x"


def test_templates_by_host(spark):
    rows = [(i, f"http://a.example.com/{i}", f"<body><div><p>Welcome to the site</p><p>Body {i}</p></div></body>") for i in range(20)]
    rows += [(100 + i, f"http://b.example.com/{i}", f"<body><div><p>Welcome to the site</p><p>Body {i}</p></div></body>") for i in range(5)]
    rows += [(200 + i, "http://c.example.com/", "<article><p>Copied article</p></article>") for i in range(12)]
    rows += [(300, None, None), (301, "", "<p>x</p>"), (301, "", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = [r.asDict() for r in h.op9(pages).collect()]
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[3]["text"] == "Body 3" and by[103]["text"] == "Welcome to the site\nBody 3"
    assert by[205]["text"] == "Copied article" and by[300]["text"] == "" and by[301]["text"] == "x" and by[301]["n_chars"] == 1
    assert h.op9(pages.where("page_id > 999")).count() == 0


def test_names_never_take_the_article():
    assert text('<div class="has-sidebar content"><p>Article text of the page</p></div>') == "Article text of the page"
    assert text('<article class="post related-articles-enabled"><p>A</p></article>') == "A"
    assert text('<article><div class="no-ads"><p>A long text</p></div><div class="ads">buy</div></article>') == "A long text"
    assert text("<p>See <a>this long linked reference title</a> ok.</p>") == "See this long linked reference title ok."
    assert text('<div><p>One text</p><p class="notice-period">Two</p><p class="notice">gone</p></div>') == "One text\nTwo"
    assert text(f'<p title="{"x" * 21_000} > z">Body</p>') == "Body"


def sites(n=40):
    rows = []
    for i in range(n):
        menu = "".join(f"<li><a href=/{i}{k}>entry {i} {k}</a></li>" for k in range(4))
        body = "".join(f"<p>Paragraph {k} of page {i} with some more words in it</p>" for k in range(6))
        html = (
            f"<body><div class='top'><ul>{menu}</ul></div><div class='x{i}'><b>slogan {i}</b></div><div id='c{i}'><h2>Head {i}</h2>{body}</div>"
            f"<div class='end'>Words {i} at the end</div><p>Printed by Press</p></body>"
        )
        rows.append((i, f"http://s{i % 2}.example.com/{i}", html))
    return rows


def test_frames_are_found_by_counts_alone(spark):
    """Nothing but counts tells the frame: no text of it recurs, and priors are off."""
    rows = sites()
    out = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), priors=False).collect()}
    for i, _, _ in rows:
        assert out[i].split("\n") == [f"Head {i}", *(f"Paragraph {k} of page {i} with some more words in it" for k in range(6))]


def test_templates_equal_brute_force(spark):
    from collections import Counter

    rows = sites() + [(99, "http://s0.example.com/", "<div>odd page</div>"), (100, None, None)]
    got = {r["host"]: (set(r["digests"] or ()), set(r["frame"] or ())) for r in h.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("s0.example.com", "s1.example.com"):
        own = [h.Page(t) for _, u, t in rows if u and host in u]
        count = Counter(d for p in own for d in p.subtrees())
        assert got[host][0] == {d for d, n in count.items() if n >= 10 and 2 * n >= len(own)} and len(got[host][0]) == 1
        layout = [p.layout() for p in own]
        n, size = Counter(x for one in layout for x in one), Counter()
        box, above = {}, {}
        for one in layout:
            for x, (s, b, up) in one.items():
                size[x] += s
                box[x], above[x] = b, up
        often = {x for x in n if n[x] >= 10 and 2 * n[x] >= len(own)}
        total = sum(p.sizes[0] for p in own)
        main = min((x for x in often if box[x] and 2 * size[x] >= total), key=lambda x: (size[x], -len(above[x])))
        want = {x for x in often if x != main and x not in above[main] and main not in above[x]}
        assert got[host][1] == {x - (1 << 63) for x in want} and want
