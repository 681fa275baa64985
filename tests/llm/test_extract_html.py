from tidemark.llm import extract_html as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class="ad">buy</div>%s
<article><h1>Head &amp; more</h1><p>One<br>two   <b>three</b><p>four &lt;x&gt; &eacute;&#233;&nbsp;z<ul><li>i<li>j</ul><aside>no</aside><form>f<input></form><pre>a
 b</pre><section id="comments"><p>reader</p></section></article><footer>&copy; f</footer></body></html>"""
WANT = "Head & more\n\nOne two three\n\nfour <x> éé z\n\ni\n\nj\n\na b"


def text(page, template=None):
    return X.main_text(X.parse(page), template)


def test_article():
    assert text(PAGE % "") == WANT
    assert text(PAGE[:-40] % "") == WANT  # cut off in the footer


def test_odd_markup():
    assert text("") == "" and text("plain &amp; text") == "plain & text"
    assert text("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\n\nd"
    assert text('<p title="a>b">x</p><!-- <p>no</p> --><p hidden>h</p><a href="unclosed>y') == "x\n\ny"  # no text is lost to an open quote
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<article>a</b></i></article>b") == "a"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert text("<article>cut &am") == "cut &am"
    assert text("<html class='has-sidebar'><div class='with-sidebar'><article>a</article><div id=comments><article>c</article></div></div>") == "a\n\nc"
    assert text("<p>a</p><div id='comments'><article>c</article></div><article>b</article>") == "b"
    assert text("<div class='sidebar-layout'><p>x</p><nav>n</nav></div>") == "x"


def test_templates_go_but_articles_stay(spark):
    line = "<div id='x'><p>Welcome to this site</p></div>"
    rows = [(k, f"https://a.example/{k}", f"<body>{line}<p>own {k}</p></body>") for k in range(30)]
    rows += [(100 + k, f"http://b.example/{k}", f"<body>{line}<article><p>the same article</p><p>{k % 2}</p></article></body>") for k in range(30)]
    rows += [(200, "https://c.example/", f"<body>{line}</body>"), (201, None, None), (202, "", ""), (203, "HTTPS://u@A.example:80/", line)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    for most in (X.BROADCAST, -1):
        X.BROADCAST, before = most, X.BROADCAST
        got = X.extract(df)
        X.BROADCAST = before
        told = {r.page_id: r.text for r in got.collect()}
        assert got.columns == ["page_id", "url", "text"]
        assert all(told[k] == f"own {k}" and told[100 + k] == f"the same article\n\n{k % 2}" for k in range(30))
        assert told[200] == "Welcome to this site" and told[201] == told[202] == told[203] == ""


def test_empty_table(spark):
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def told(spark, pages):
    df = spark.createDataFrame([(k, f"https://{h}/{k}", p) for k, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in X.extract(df).collect()}


def test_containers_that_recur_in_articles_go(spark):
    body = "<p>This is the text of the one article which has the number {0}, and it goes on for quite some words {0}.</p>"
    want = "This is the text of the one article which has the number {0}, and it goes on for quite some words {0}."
    box, copy = "<div class='x7'><p>Join us now</p></div>", "<div class='c'><p>One article that stands at many addresses.</p></div>"
    pages = [("a", f"<article>{body.format(k)}{box}<p>Same end.</p></article>") for k in range(20)]
    pages += [("b", f"<nav>{k}</nav><article>{copy}</article>") for k in range(20)]  # the same article again and again
    pages += [("c", f"<article>{copy}<p>{k}</p></article>") for k in range(20)]  # its near copies
    got = told(spark, pages)
    assert all(got[k] == want.format(k) + "\n\nSame end." for k in range(20))
    assert all(got[20 + k] == "One article that stands at many addresses." for k in range(20))
    assert all(got[40 + k] == f"One article that stands at many addresses.\n\n{k}" for k in range(20))


def test_sidebars_of_a_section_of_a_host_go(spark):
    side = "<div id='q1'>The sidebar of this section of the site</div>"
    got = told(spark, [("a", f"<body>{side if k < 19 else ''}<p>own {k}</p><p>{'yes' if k < 19 else k}</p></body>") for k in range(100)])
    assert all(got[k] == f"own {k}\n\n{'yes' if k < 19 else k}" for k in range(100))


def test_names_inside_articles(spark):
    kept = "<h2 id='cookies'>a</h2><section id='related-work'>b</section><p class='ad-hominem'>c</p><div id='social-history'>d</div><div id='navier'>e</div>"
    read = "<p><math><mi>x</mi></math></p><object><p>o</p></object><noscript><p>n</p></noscript><svg><title>t</title><text>s</text></svg>"
    assert text(f"<article>{kept}{read}<div class='share-box'>z</div></article>") == "a\n\nb\n\nc\n\nd\n\ne\n\nx\n\no\n\nn\n\ns\n\nz"
    got = told(spark, [("a", f"<article><p>own {k}</p><div class='share-box'>share {k}</div><div id='comments'>hi</div></article>") for k in range(20)])
    assert all(got[k] == f"own {k}" for k in range(20))


def test_attributes_are_read_by_name(spark):
    kept = '<p style="overflow:hidden">a</p><p data-hidden="false">b</p><div title="hidden">c</div><header><h1>d</h1></header>'
    assert text(f"<article>{kept}<p hidden>x</p><p aria-hidden='true'>y</p><p aria-hidden=false>e</p></article>") == "a\n\nb\n\nc\n\nd\n\ne"
    got = told(spark, [("a", f"<article><header><h1>own {k}</h1></header><div class='share-price'>price {k}</div><section class='related-work'>work {k}</section></article>") for k in range(20)])
    assert all(got[k] == f"own {k}\n\nprice {k}\n\nwork {k}" for k in range(20))


def test_templates_against_counting_by_hand(spark):
    """The subtrees that are taken for template are those that stand in enough different articles or pages."""
    boxes = ["<div class='q'>Read more of our <b>long</b> stories every day</div>", "<div>two words</div>", "<div>rare words that stand in few pages</div>"]
    pages = [("h", k, f"<article><p>text {k} of the page with the number {k}, in so many words</p>{boxes[0]}{boxes[1] if k % 3 == 0 else ''}{boxes[2] if k < 9 else ''}</article>") for k in range(40)]
    pages += [("i", 100 + k, f"<body><p>own {k} words</p>{boxes[k % 3]}</body>") for k in range(12)]
    df = spark.createDataFrame([(k, f"https://{h}/{k}", p) for h, k, p in pages], "page_id long, url string, html string")
    counts, totals, long = {}, {}, {}
    for h in ("h", "i"):
        own = [p for x, _, p in pages if x == h]
        totals[h] = len({X._texts(X.parse(p)) for p in own})
        for p in own:
            for code, _, where, n in X.subtrees(X.parse(p))[0]:
                counts.setdefault((h, code), set()).add(X._texts(where))
                long[h, code] = n >= X.LONG
    want = {k for k, v in counts.items() if len(v) >= X.PAGES and (long[k] or len(v) >= X.SHARE * totals[k[0]])}
    got = {(r.host, x) for r in X.templates(df).collect() for x in r.hashes}
    assert got == want and want
    told = {r.page_id: r.text for r in X.extract(df).collect()}
    for _, k, p in pages:
        with_all = X.main_text(X.parse(p))
        assert told[k] == X.main_text(X.parse(p), {x for h, x in want if (k < 100) == (h == "h")})
        assert ("Read more" in with_all) and "Read more" not in told[k] if k < 100 else True


def test_long_pages_and_repeated_rows(spark):
    page = "<article>" + "".join(f"<p>paragraph {k} é</p>" for k in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "https://a/1", page), (1, "https://a/1", page), (2, "https://a/2", "<p>x</p>")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in X.extract(df).collect())
    assert got == [(1, "\n\n".join(f"paragraph {k} é" for k in range(20_000)))] * 2 + [(2, "x")]
