from qamill.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Big &amp;  title</h1><p>by me</p></header>
<p>First   paragraph with <b>bold
words</b> and an &eacute;.<p>Short.<!-- no --><aside class="ad">Buy now</aside>
<ul><li>one item</li><li>two items</li></ul><section id="comments"><p>Nice post!</p></section></article>
<form><input value="x"><p>Subscribe</p></form><footer>&copy; us</footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE).split("\n") == [
        "Big & title", "First paragraph with bold words and an é.", "Short.", "one item", "two items"]


def test_page_without_article():
    html = ("<body><div id=menu><a href=a>A</a> <a href=b>B</a></div><div><p>" + "long text " * 30
            + "</p><p>tiny</p></div><div class='sidebar'>other</div></body>")
    assert H.main_text(html).split("\n") == [("long text " * 30).strip(), "tiny"]


def test_names_of_wrappers():
    inner = "<article><p>the text</p><div class='comments'><article>first!</article></div></article>"
    assert H.main_text(f"<body><div class='layout with-sidebar'>{inner}</div>") == "the text"
    assert H.main_text(f"<body><div class='ad'>Buy<p>now{inner}") == "the text"
    assert H.main_text("<body><div class='page no-header'><p>all there is</p></div>") == "all there is"
    assert H.main_text("<body><nav>only a menu</nav></body>") == ""


def test_defined_results():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("plain words only") == "plain words only"
    assert H.main_text("<p>" * 20_000 + "deep") == "deep"


def test_threshold_and_smoothing():
    assert H.threshold([1.0, 1.0]) == 1.0
    assert 1 < H.threshold([1.0, 1.2, 9.0, 10.0]) < 9
    assert max(abs(a - 3.0) for a in H.smooth([3.0] * 7, 1.0)) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract(df).collect()
    assert len(got) == 4 and sorted(len(r["text"]) for r in got)[:2] == [0, 0]
    assert H.extract(df.limit(0)).count() == 0


LONG = "some good long text here " * 10


def test_elements_left_open():
    for head in ("<head><title>x</title><meta name=a>", "<head><title>x</title><style>p{}</style>"):
        assert H.main_text(f"<html>{head}<body><p>hello world</p></body></html>") == "hello world"
        assert H.main_text(f"<html>{head}<p>hello world") == "hello world"
        assert H.main_text(f"<html>{head}hello world") == "hello world"
    for form in ("<form><select><option>a<option>b</form>", "<select><option>a<option>b"):
        assert H.main_text(f"<body>{form}<p>{LONG}</p></body>") == LONG.strip()


def test_names_that_are_topics():
    page = (f"<article><h1>T</h1><p>{LONG}</p><section id='related-work'><p>{LONG}</p></section>"
            f"<h2 id='search-algorithms'>How to search</h2><div class='share-price'>{LONG}</div>"
            f"<aside class='pullquote'>{LONG}</aside><div class='share-price'>x</div>"
            f"<div class='search-box'>{LONG}</div><div class='related-posts'>{LONG}</div>"
            f"<div class='ad-slot-9'>{LONG}</div><div class='comment-price'>{LONG}</div><aside>{LONG}</aside>"
            f"</article>")
    text = LONG.strip()
    assert H.main_text(page).split("\n") == ["T", text, text, "How to search", text, text]
    assert H.main_text(f"<div class='search-results'><article><p>{LONG}</p><p>x</p></article></div>") \
        == text + "\nx"


def test_sibling_articles():
    other = LONG.replace("good", "more")
    page = f"<body><article><p>{LONG}</p></article><article><p>{other}</p></article>" \
           "<article><p>a teaser</p></article></body>"
    assert H.main_text(page).split("\n") == [LONG.strip(), other.strip()]
    beside = f"<body><article><p>a teaser of something else</p></article><div><p>{LONG}</p><p>{other}</p></div>"
    assert H.main_text(beside).split("\n") == [LONG.strip(), other.strip()]
