import re

from conftest import SF001

from quarry.llm import html_wrappers as H


def page(i, body, extra=""):
    return (f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>'
            f'<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A{i}</a></li><li><a href="/b">B</a></li></ul></nav>'
            f'<div class="cookie-notice">Accept?</div><main>{body}<form>mail <input></form><div id="comments"><p>first!</p></div></main>{extra}'
            f'<aside>more</aside><footer>&copy; {i}</footer></body></html>')


def run(spark, rows, schema="page_id int, url string, html string"):
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, schema)).collect()}


def test_main_text(spark):
    bodies = {1: ("<h1>A &amp; B</h1><p>one\n  two<br>three<p>f<b>ou</b>r &lt;x&gt;</p>", "A & B\none two three\nfour <x>"),
              2: ("<h1>T</h1>" + "".join(f"<p>p{i}</p>" for i in range(9)), "T\n" + "\n".join(f"p{i}" for i in range(9))),
              3: ("<div>a<div>b</div>c</div><!-- no --><p hidden>h</p><script>x</script>", "a\nb\nc"), 4: ("", "")}
    rows = [(k, f"http://h.example/{k}", page(k, b)) for k, (b, _) in bodies.items()]
    assert run(spark, rows) == {k: t for k, (_, t) in bodies.items()}


def test_no_article_region(spark):
    def old(i):
        return (f'<html><body><div class="menu"><a>x{i}</a></div><table><tr><td><ul><li><a>l{i}</a><li><a>m{i}</a></ul></td>'
                f'<td><p>Text {i} of the page.<p>More {i}.</td></tr></table><div>Always the same words</div></body></html>')
    got = run(spark, [(i, "http://old.example/x", old(i)) for i in range(4)])
    assert got == {i: f"Text {i} of the page.\nMore {i}." for i in range(4)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://x/", "plain &amp; simple\n text"), (4, "http://y/", "<article><p>cut off <b>he"),
            (5, "http://y/", "<article><p>cut</p></article><foote"), (6, "http://y/", "<article><p>a < b &zzz; &#65;"),
            (7, "http://z/", "<article>" + "<p>w</p>" * 20_000 + "</article>"), (8, "http://z/", '<article><p title="unclosed>q</p></article>')]
    got = run(spark, [(*r, 5) for r in rows], "page_id int, url string, html string, host int")
    assert [got[i] for i in range(1, 7)] == ["", "", "plain & simple text", "cut off he", "cut", "a < b &zzz; A"]
    assert got[7] == "\n".join(["w"] * 20_000) and got[8] == "q"
    assert H.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def wrap(html):
    return H.wrapper_of(H.blocks(html))


def plain(wrapper):
    """Items only, optional ones marked by "?"."""
    return [(x if isinstance(x, str) else [x[0], plain(x[1])]) if need else ["?", plain([[x, True]])] for x, need in wrapper]


def test_fold_and_align():
    assert plain(wrap("<h1>a</h1><p>b<p>c<p>d<hr><div>e</div>")) == [["h1", ["T"]], ["+", [["p", ["T"]]]], ["div", ["T"]]]
    assert plain(wrap("<dl><dt>a<dd>b<dt>c<dd><p>d</dl>")) == [["dl", [["+", [["dt", ["T"]], ["dd", [["?", ["T"]], ["?", [["p", ["T"]]]]]]]]]]]
    nested = plain(wrap("<h2>t</h2><p>r<p>r<h2>t</h2><p>r<p>r<p>r"))
    assert nested == [["+", [["h2", ["T"]], ["+", [["p", ["T"]]]]]]]
    one, many = wrap("<nav><a>x</a></nav><p>a</p><footer>f</footer>"), wrap("<nav><a>x</a></nav><p>a</p><p>b</p><footer>f</footer>")
    assert H.align(one, many) == H.align(many, one) == many
    wide = H.align(wrap("<h1>h</h1><nav>n</nav><footer>f</footer>"), wrap("<h1>h</h1><aside>a</aside><footer>f</footer>"))
    assert [x[0] for x in plain(wide)] == ["h1", "?", "?", "footer"]
    assert H.align(wide, wrap("<h1>h</h1><footer>f</footer>")) == wide


def test_deep_nesting(spark):
    deep = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>flat</p></article><p>out</p>"
    assert run(spark, [(1, "http://h/", deep)]) == {1: "deep\nflat"}


def test_given_pages_against_a_plain_reading(spark):
    """The given pages are of one kind; its article is what stands between two marks."""
    import html
    df = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    for r in df.collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"<(?:/?p|/?h1)>", body)
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " ")))).strip() for p in parts]
        assert got[r["page_id"]] == "\n".join(x for x in want if x)


def test_pages_with_and_without_a_region_on_one_host(spark):
    def front(i):
        return f"<body><nav><a>n</a></nav><article><h2>t{i}</h2><p>teaser {i}</p></article></body>"

    def story(i):
        return f"<body><nav><a>n</a></nav><div class=content><h1>h{i}</h1><p>body {i}</p></div></body>"
    for urls in ("http://mixed.example/{}", None):
        rows = [(i, urls and urls.format(i), front(i) if i < 2 else story(i)) for i in range(6)]
        assert run(spark, rows) == {i: f"t{i}\nteaser {i}" if i < 2 else f"h{i}\nbody {i}" for i in range(6)}


def test_copies_and_rare_paths_are_not_constant(spark):
    story = "<body><div class=content><h1>same</h1><p>one copied story</p></div></body>"
    for n in (2, 3, 5):                                # a host of copies
        assert run(spark, [(i, f"http://copies.example/{i}", story) for i in range(n)]) == dict.fromkeys(range(n), "same\none copied story")

    def page(body, i):
        return f"<body><div class=content><p>{i}</p></div>{body}<div class=line>on each page</div></body>"
    rare = [(i, f"http://rare.example/{i}", page("<div class=special><p>copied thrice</p></div>", "x")) for i in range(3)]
    rows = rare + [(i, f"http://rare.example/{i}", page("", i)) for i in range(3, 7)]
    rows.append((7, "http://rare.example/7", "<body><div class=line>on each page</div></body>"))
    want = dict.fromkeys(range(3), "x\ncopied thrice") | {i: str(i) for i in range(3, 7)} | {7: "on each page"}
    assert run(spark, rows) == want


def test_a_region_or_most_of_a_page_is_not_chrome(spark):
    side = "<nav><a>n</a></nav><div class=sidebar><p>aside</p></div>"
    body = "<h1>Title</h1><p>The story of the page, long enough to be most of it.</p>"
    rest = "<ul><li>one of the points</li></ul><div id=comments><p>first!</p></div>"
    pages = ["<body class='no-sidebar menu'>" + side + f"<article>{body}{rest}</article></body>",
             f"<body><div class=has-sidebar>{side}<article>{body}{rest}</article></div></body>",
             f"<body>{side}<article class='post comments-open category-newsletter'>{body}{rest}</article></body>",
             f"<body><form id=aspnet>{side}<main>{body}{rest}</main></form></body>",
             f"<body><form id=aspnet>{side}<article>{body}{rest}</article></form></body>",
             f"<body><form id=aspnet>{side}<div class=text>{body}{rest}</div></form><div>End</div></body>",
             f"<body><div class=widget-page>{side}<div class=text>{body}{rest}</div></div><div>End</div></body>"]
    want = "Title\nThe story of the page, long enough to be most of it.\none of the points"
    got = run(spark, [(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)])
    assert got == {i: want + ("\nEnd" if i > 4 else "") for i in range(len(pages))}


def test_chrome_with_articles_or_much_text_stays_chrome(spark):
    story = "<div class=content><h1>T</h1><p>the text of the page</p></div>"
    pages = [f"<body>{story}<div class=related><article>teaser</article></div></body>",
             f"<body>{story}<aside><article>a teaser that is much longer than the page's own text</article></aside></body>",
             f"<body>{story}<div id=comments><article><h4>who</h4><p>{'a long comment ' * 9}</p><ul><li>x</li></ul></article></div></body>",
             f"<body><article>{story}</article><div id=comments><article>{'a long comment ' * 9}</article></div></body>",
             f"<body>{story}<div class=cookie-notice><p>{'we use cookies ' * 9}</p></div></body>"]
    assert run(spark, [(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)]) == dict.fromkeys(range(5), "T\nthe text of the page")
