"""Wrapper induction: planted articles come back, template and boilerplate don't."""

import html
import random
import re

from colloquy.llm import wrapper_extract as we


def test_test_data_articles(spark, small):
    rows = we.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)


def page(rng, k, layout):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    paras = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(3, 7))]
    body = "".join(f"<p>{p}</p>\n" for p in paras)
    comments = f"<div class='comments'><h3>Comments</h3><p>{word()} {word()}</p></div>"
    promo = "<p>Sign our open letter and tell all of your friends.</p>"
    side = f"<div class='sidebar'>{word()}</div><div id='cookie-notice'>We use cookies</div>"
    form = f"<form><label>Mail</label><input name=x><button>Go</button></form><script>var x='<p>{word()}</p>'</script>"
    if layout == "article":
        main = f"<article><header><h1>T{k} {word()}</h1></header>{body}{promo}{comments}</article>"
    else:
        main = f"<div class=content><h1>T{k} {word()}</h1>{body}{promo}</div>{comments}"
    title = re.search(r"<h1>(.*?)</h1>", main)[1]
    out = f"<html><head><title>x</title></head><body><header>Site name</header><nav><a href=/>{word()}</a></nav>{side}{main}{form}<footer>(c) {word()}</footer></body></html>"
    return out, " ".join([title, *paras])


def test_layouts_and_promotions(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for layout in ("article", "div"):
        for k in range(30):
            source, text = page(rng, k, layout)
            rows.append((len(rows), f"https://{layout}.example.org/{k}", source))
            want[len(rows) - 1] = text
    got = {r.page_id: r.text for r in we.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "plain &amp; text &#233;"), (4, "http://h/", "<p>a<p>b<b>c</b>d<br>e <!-- x --> f</p"), (4, "http://h/", "<p>a<p>b<b>c</b>d<br>e <!-- x --> f</p"), (5, "http://h/", "<div><script>no"), (6, "http://h/", "<p title='a>b'>x < y &lt;z</p>" + "<div>" * 500 + "deep"), (None, "http://h/", "<p>q</p>" * 2000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, TEXT string")
    got = [(r.page_id, r.text) for r in we.extract(df).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert found[1] == found[2] == "" and found[3] == "plain & text é" and found[4] == "a bcd e f" and found[5] == ""
    assert found[6] == "x < y <z deep" and found[None] == " ".join(["q"] * 2000)
    assert we.extract(df.limit(0)).count() == 0


def test_articles_keep_words_that_only_look_like_marks():
    kept = ["class='share-price'", "id='reply-to-critics'", "class='notice-board-history'", "data-id='related'", 'title="class=\'menu\'"']
    for attrs in kept:
        assert we.main_text(f"<article><p>one</p><p {attrs}>two</p></article>", None) == "one two", attrs
    for attrs in ("class='site-header sidebar-left'", "id=comment-list", "class='x cookie-notice'", "role='navigation'", "hidden", "style='display: none'"):
        assert we.main_text(f"<article><p>one</p><p {attrs}>two</p></article>", None) == "one", attrs
    assert we.main_text("<body><form action=/go/>a</form><nav class=top/>b</nav><p>c</p>", None) == "c"


def test_depth_and_long_lists_have_no_cap():
    deep = "<div>" * 5000 + "<p class=menu>m</p><p>text</p>" + "</div>" * 5000
    assert we.main_text(deep, we.induce([deep.replace("text", f"w{k}") for k in range(4)])) == "text"


def best(a, b):
    """Simple tree matching by its plain recurrence."""
    if a.key != b.key:
        return 0
    x, y = a.nodes, b.nodes
    w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x, 1):
        for j, q in enumerate(y, 1):
            w[i][j] = max(w[i - 1][j], w[i][j - 1], w[i - 1][j - 1] + best(p, q))
    return w[-1][-1] + 1


def test_tree_matching_equals_the_plain_recurrence(monkeypatch):
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "p", "span", "ul"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)) + rng.choice(["", "a", "b"]) + f"</{tag}>"

    for whole in (4_000_000, 3):
        monkeypatch.setattr(we, "WHOLE", whole)
        we._SIZES.clear()
        for _ in range(150):
            a, b = (we.parse("<section>" + tree(3) + tree(2) + "</section>") for _ in range(2))
            assert we.tree_match(a, b) == best(a, b)
            pairs = we.match(a.nodes[0].nodes, b.nodes[0].nodes)
            order = lambda side, k: [side.index(p[k]) for p in sorted(pairs, key=lambda p: a.nodes[0].nodes.index(p[0]))]
            assert order(b.nodes[0].nodes, 1) == sorted(order(b.nodes[0].nodes, 1))


def test_an_inserted_advert_does_not_shift_the_template():
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abcdef") for _ in range(12))
    shape = lambda advert: f"<body><p>Menu one</p>{'<p>' + text() + '</p>' if advert else ''}<p>Always here</p><div><p>{text()}</p><p>{text()}</p></div></body>"
    sample = [shape(k % 2) for k in range(8)]
    source = shape(True)
    got = we.main_text(source, we.induce(sample))
    assert "Menu one" not in got and "Always here" not in got and all(t in got for t in re.findall("[a-f]{12}", source))


def test_copies_of_one_article_are_no_template(spark):
    pages = [f"<body><nav>n</nav><article><h1>T</h1><p>Same words</p></article><footer>{k}</footer></body>" for k in range(12)]
    rows = [(k, "http://one.example/" + str(k), p) for k, p in enumerate(pages)]
    got = we.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T Same words"}


def test_hosts_of_three_pages_get_a_wrapper(spark):
    rows = [(3 * h + k, f"http://h{h}.example/{k}", f"<body><p>Read all our terms</p><div><p>story {h} {k} {'x' * k}</p></div></body>") for h in range(12) for k in range(3)]
    got = we.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("story") for r in got)
