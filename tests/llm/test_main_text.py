from lakesync.llm.main_text import extract, main_text

PROSE = "This is the story of a house that was built by the river, and of the people who lived in it for many years."
MORE = "They had a garden with apple trees, and in the summer the children would play there until it was dark."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_article_among_furniture():
    html = page(f"""
      <header class="site"><a href="/">Home</a> Site name</header>
      <nav><ul><li><a href="/a">A</a></li><li>plain entry</li></ul></nav>
      <div class="cookie-notice">We use cookies and this is a long notice that reads like a text of the page, and it is not.</div>
      <aside id="sidebar"><p>{MORE}</p></aside>
      <article class="post"><header><h1>A &amp; B&nbsp;title</h1></header>
        <p><b>{PROSE}<br><p>Short.</p><!-- not this --><script>var x = "</p><p>not this</p>";</script>
        <div class="ad">Buy   now and save a lot of money on all of the things that you like to have in the house.</div>
        <form><p>Your name in the form</p><input></form>
        <p>{MORE}   with  <a href="/x">a link</a>
           inside</p>
        <section id="comments"><h2>Comments</h2><p>{PROSE}</p></section></article>
      <section class="comments"><article class="comment"><p>{MORE}</p></article></section>
      <footer>&copy; site &middot; {MORE}</footer>""", "<style>p{color:red}</style><script>if (a<b) {}</script>")
    assert main_text(html) == "\n\n".join(["A & B title", PROSE, "Short.", f"{MORE} with a link inside"])


def test_page_without_article_goes_by_density():
    html = page(f"""<div id="top"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div>
      <div id="body"><h2>Heading</h2><div>{PROSE}</div><div>Short one</div><div>{MORE}</div></div>
      <div><a href="/q">Privacy</a> <a href="/r">Terms</a></div><div>© 2020 somebody</div>""")
    assert main_text(html) == "\n\n".join(["Heading", PROSE, "Short one", MORE])


def test_short_articles_and_foreign_blocks_stay():
    assert main_text("<nav>menu</nav><article><h1>Be.</h1><p>Erin.</p></article><footer>f</footer>") == "Be.\n\nErin."
    odd = "xq " * 60
    assert main_text(f"<main><p>{PROSE}</p><p>{odd}</p></main>") == f"{PROSE}\n\n{odd.strip()}"


def test_pages_without_article_keep_other_languages_and_short_text():
    foreign = "Tämä on kertomus talosta, joka rakennettiin joen rannalle, ja ihmisistä, jotka asuivat siellä monta vuotta."
    assert len(foreign) > 70 and main_text(page(f"<p>{foreign}</p>")) == foreign
    menu = '<div><a href="/1">One</a> <a href="/2">Two</a></div>'
    assert main_text(page(f"{menu}<h1>Runo</h1><p>{foreign}</p><ul><li>yksi</li><li>kaksi</li></ul>")) == f"Runo\n\n{foreign}\n\nyksi\n\nkaksi"
    assert main_text("plain words only") == "plain words only"


def test_wrappers_named_after_furniture_are_none():
    for name in ("no-sidebar", "with-nav", "content-social"):
        assert main_text(page(f'<div class="{name}"><p>{PROSE}</p></div>')) == PROSE
    assert main_text(page(f'<div class="cookie-notice"><p>{MORE}</p></div><div class="sidebar"><p>{MORE}</p></div><p>{PROSE}</p>')) == PROSE


def test_article_text_named_or_linked_like_furniture_stays():
    keeps = (f'<article><div class="no-sidebar"><p>{PROSE}</p></div></article>', f'<main><section class="related-work"><p>{PROSE}</p></section></main>',
             f'<article><section id="social-history"><p>{PROSE}</p></section></article>', f'<article><p class="share-price">{PROSE}</p></article>')
    assert [main_text(page(html)) for html in keeps] == [PROSE] * 4
    assert main_text(page(f'<article><h1><a href="/x">A headline</a></h1><p>{PROSE}</p></article>')) == f"A headline\n\n{PROSE}"
    assert main_text(page(f'<div><h1><a href="/x">A headline</a></h1><p>{PROSE}</p></div>')) == f"A headline\n\n{PROSE}"
    linked = f'<article><p>{PROSE}</p><p>See <a href="/s">the whole story of the house by the river</a>.</p><p>{MORE}</p></article>'
    assert main_text(page(linked)) == f"{PROSE}\n\nSee the whole story of the house by the river.\n\n{MORE}"
    sources = f'<p>{PROSE}</p><h2>Sources</h2><ul><li><a href="/1">First book</a></li><li><a href="/2">Second book</a></li></ul>'
    assert main_text(page(f"<article>{sources}</article>")) == f"{PROSE}\n\nSources\n\nFirst book\n\nSecond book"
    assert main_text(page(f"<article><p>© is the sign of a right.</p><p>{PROSE}</p><p>© 2020 somebody</p></article>")) == f"© is the sign of a right.\n\n{PROSE}"


def test_furniture_inside_articles_goes():
    menu = '<ul><li><a href="/1">Home</a></li><li><a href="/2">News</a></li></ul>'
    for name in ("share-bar", "related-posts", "ad-slot", "social-links", "newsletter box", "commentList"):
        assert main_text(page(f'<article><p>{PROSE}</p><div class="{name}"><p>{MORE}</p></div></article>')) == PROSE
    assert main_text(page(f"<main>{menu}<p>{PROSE}</p></main>")) == PROSE
    assert main_text(page(f"<div>{menu}</div><p>{PROSE}</p><div>{menu}</div>")) == PROSE


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("   ") == ""
    assert main_text(f"<article><p>{PROSE}</article><script>never closed <p>{MORE}") == PROSE
    assert main_text(f"<article><p>{PROSE} <!-- open comment {MORE}") == PROSE
    assert main_text(f"<article><div><p>{PROSE}</div></span></p></article></div>") == PROSE
    assert main_text(f'<article><p title="a > b">{PROSE} 1 < 2</p></article>') == f"{PROSE} 1 < 2"
    assert main_text(f"<article><p hidden>{MORE}</p><p style='display: none'>x</p><p>{PROSE}</p></article>") == PROSE
    assert main_text("<" * 5000 + "a " * 5000) is not None


def test_very_long_page_and_hard_rows(spark):
    long = page("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>")
    rows = [(1, "u", long), (2, None, None), (2, None, None), (None, "u", ""), (4, "u", "plain words only")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = extract(frame).collect()
    assert len(got) == 5 and all(len(r["text"]) == r["n_chars"] for r in got)
    assert next(r for r in got if r["page_id"] == 1)["text"] == "\n\n".join([PROSE] * 20_000)
    assert extract(frame.limit(0)).count() == 0
