from seriesloom.llm import wrapper as W

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{x}</style><script>var a="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>News</ul></nav><!-- c -->'
    '<div class="ad">Buy &amp; pay</div><article><h1>Title %d</h1><p><b>One  two&nbsp;&eacute;.<br><p>Three\n<i>four</i>.</p>'
    '<form><input name=q>Search</form><ul><li>x<li>y</ul><div class="share">Share this</div><p>Follow us!</p></article>'
    '<section id="comments"><p>I disagree</p></section><aside>side</aside><footer>&copy; me</footer></body></html>'
)


def brute_tree_matching(a, b):
    """Size of the largest matching, by plain recursion."""

    def go(i, j):
        if a["labels"][i] != b["labels"][j]:
            return 0
        x, y = a["kids"][i], b["kids"][j]

        def best(p, q):
            if p == len(x) or q == len(y):
                return 0
            return max(best(p + 1, q), best(p, q + 1), best(p + 1, q + 1) + go(x[p], y[q]))

        return best(0, 0) + 1

    return go(0, 0)


def lone(page):
    return W.main_text(page)[0]


def test_article_only():
    assert lone(PAGE % 1) == "Title 1\nOne two é.\nThree four.\nx\ny\nFollow us!"
    for page in (None, "", "<", "<p", "</p></div>", "a < b", "<div class='ad'>x"):
        lone(page)
    assert lone(None) == ""
    assert lone("plain &lt;text&gt;") == "plain <text>"
    assert lone("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_without_article():
    page = "<body><div id=menu>Home</div><div class=wrap><div><p>first long paragraph here</p><p>second</p></div></div><div class=footer>f</div></body>"
    assert lone(page) == "first long paragraph here\nsecond"


def test_all_articles_of_a_page():
    assert lone("<article>one one one</article><article>two <article>in two</article></article><aside><article>no</article></aside>") == "one one one\ntwo\nin two"


def test_references_end_at_markup():
    assert lone("<p>a &<b>lt;</b> b &amp;lt; &#<i>65;</i> &copy;</p>") == "a &lt; b &lt; &#65; ©"


def test_long_pages_take_linear_time():
    import time

    pages = ["<div>" * 50_000 + "x", "<p>x" * 50_000, "<a" * 300_000, '<a title="x>' * 50_000, "<li>" * 50_000, "<b>" * 50_000 + "y", "<ul><li>x</ul>" * 20_000, "İ<script>" * 1000]
    began = time.process_time()
    for p in pages:
        lone(p)
    assert time.process_time() - began < 20
    tree = W.skeleton(W.fold(W.parse("<div class=a><p>" * 3000)))
    assert len(W.align(tree, tree)) == len(tree["labels"])
    wide = W.skeleton(W.fold(W.parse("<body>" + "".join(f"<div class=k{chr(97 + i % 26)}>x</div>" for i in range(3000)))))
    assert len(W.align(wide, wide)) == len(wide["labels"])


def test_matching_is_largest():
    pages = ["<div><p>a</p><ul><li>x</ul><p>b</p></div>", "<div><ul><li>x</ul><p>q</p><h2>z</h2><p>b</p></div>", "<section><p>a</p></section><div><h2>k</h2><p>b</p></div>"]
    trees = [W.skeleton(W.fold(W.parse(p))) for p in pages]
    for a in trees:
        for b in trees:
            pairs = W.align(a, b)
            assert len(pairs) == brute_tree_matching(a, b)
            assert all(a["labels"][i] == b["labels"][j] for i, j in pairs)


def run(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = W.apply(pages, W.induce(pages), ["page_id", "url"]).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r for r in out}


def test_induced_template(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", (PAGE % i).replace("Three", f"Three{i}" + " more" * i), 0) for i in range(20)]
    rows += [(50, None, "<p>lone</p>", 0), (51, "http://h0.example/z", None, 0), (52, "http://h0.example/z", "", 0), (None, "http://h1.example/q", PAGE % 9, 0), (-1, "http://h0.example/e", "", 0)]
    by = run(spark, rows)
    # what all pages share is template, in paragraphs too; title and the other paragraph vary
    assert by[3].text == "Title 3\nThree3 more more more four." and by[3].by_wrapper
    assert by[50].text == "lone" and by[51].text == "" and by[52].n_chars == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.apply(empty, W.induce(empty), ["page_id"]).count() == 0


def bare(i, body, notice="", shape=""):
    """A page without any element or name that tells what it is."""
    links = "".join(f"<div class=l><a href=/{k}>Section {k}</a></div>" for k in range(40))
    return f"<html><body>{shape}<div class=x1><div>Daily Site</div>{links}</div><div class=x2><div class=x3><h2>Head {i}</h2><div>{body}</div>{notice}</div></div><div class=x4>Imprint, all about us</div></body></html>"


def story(i, n=6):
    return "".join(f"<p>Line {k} of story {i} with {' '.join(f'w{i * 7 + k + j}' for j in range(12))}.</p>" for k in range(n))


def plain(i, n=6):
    return "\n".join([f"Head {i}"] + [f"Line {k} of story {i} with {' '.join(f'w{i * 7 + k + j}' for j in range(12))}." for k in range(n)])


def test_wrapper_alone_finds_the_text(spark):
    """No name tells anything here: votes do.  Notices of any length go, wherever they are; two layouts; odd and empty pages first."""
    short, long_ = "Subscribe!", "We use cookies to " + "improve your experience and " * 20 + "more."
    rows = [(0, "http://a.example/", "", 0), (1, "http://a.example/err", "<body><h1>Not found</h1></body>", 0)]
    rows += [(i, f"http://a.example/{i}", bare(i, story(i, i % 4 + 3) + f"<p>{long_}</p>", f"<div>{short}</div>"), 0) for i in range(10, 30)]
    rows += [(i, f"http://a.example/{i}", bare(i, story(i), shape="<div class=top><div>Other</div><div>layout</div></div>"), 0) for i in range(30, 45)]
    by = run(spark, rows)
    for i in range(10, 30):
        assert by[i].text == plain(i, i % 4 + 3) and by[i].by_wrapper
        assert W.main_text(rows[i - 8][2])[0] != by[i].text
    for i in range(30, 45):
        assert by[i].text == plain(i) and by[i].by_wrapper
    assert by[0].text == ""


def test_copies_are_not_template(spark):
    rows = [(i, f"http://a.example/{i}", bare(7, story(7)), 0) for i in range(60)] + [(100 + i, f"http://a.example/{i}", bare(i, story(i)), 0) for i in range(9)]
    by = run(spark, rows)
    assert by[5].text == plain(7) and by[105].text == plain(5)


def test_vocabulary_breaks_ties_only(spark):
    # comments vary like the article does: their name decides.  A whole story in an element with a misleading name is content.
    talk = lambda i: "<section id=comments>" + "".join(f"<p>Reader {i} {k} says {' '.join(f'c{i * 5 + k + j}' for j in range(30))}</p>" for k in range(9)) + "</section>"
    rows = [(i, f"http://a.example/{i}", f"<body><div>{story(i)}</div>{talk(i)}</body>", 0) for i in range(12)]
    rows += [(50 + i, f"http://b.example/{i}", f"<body><div>Menu of all</div><div class='widget ad'><h1>Head {i}</h1>{story(i)}</div></body>", 0) for i in range(12)]
    by = run(spark, rows)
    assert by[3].text == plain(3).split("\n", 1)[1]
    assert by[53].text == plain(3) and by[53].by_wrapper


def test_hot_host_repeated_rows_and_clashing_names(spark):
    rows = [(i % 40, f"http://a.example/{i % 40}", bare(i % 40, story(i % 40)), 0) for i in range(200)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text int, host string, key string")
    out = W.apply(pages, W.induce(pages), ["page_id", "url"]).collect()
    assert len(out) == 200 and all(r.text == plain(r.page_id) for r in out)
