import random

from galeframe.llm import site_template as m

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- c --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First   part<br> of {0}<p>Second &eacute;&#233;</p></article><footer>&copy; x</footer></body></html>"""


def text(source, template=()):
    root = m.parse(source)
    m.digest(root)
    return m.main_text(root, set(template))


def test_article_without_the_rest():
    assert text(PAGE.format("it")) == "Head & line\nFirst part of it\nSecond éé"
    assert text(PAGE.format("it").split("</article>")[0]) == "Head & line\nFirst part of it\nSecond éé"


def test_page_without_article():
    page = """<body><header><h1>Site</h1></header><div class="sideBar sidebar"><p>side</p></div><div id="content"><h2>Title</h2><p>one<p>two <i>x</i>y<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div>
    <div class=cookie-notice>cookies</div><section id=comments><article><p>reader</p></article></section><form><p>f</p></form><div role="navigation">n</div><p hidden>h</p><footer>f</footer>"""
    assert text(page) == "Title\none\ntwo xy\na\nb\nc\nd"


def test_broken_and_empty_pages():
    for page, want in (("", ""), ("<", "<"), ("plain  text", "plain text"), ("<p", "<p"), ("</p>x", "x"), ("<!-- open", ""), ("<script>open", ""), ("<b>" * 20_000 + "deep", "deep"), ("&lt;b&gt;&nbsp;", "<b>"),
                       ("<p>a</div>b<p>c", "ab\nc"), ('<a title="x>y">z</a>', "z")):
        assert text(page) == want


def site(rnd, host, n, article):
    """Pages of a host that differ in their content; menus and footers have no telling tag or class."""
    menu = f"<div class='x1'><span>All of {host}</span> <span>Contact</span></div>"
    tail = f"<div><div>Imprint of {host}</div></div>"
    rows = []
    for i in range(n):
        own = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(20)) + f" {i}"
        body = f"<p>{own}</p><p>Passage that every article quotes.</p><div>Read our other stories</div>"
        rows.append((f"http://{host}/{i}", f"{menu}<article>{body}</article>{tail}" if article else f"<body>{menu}<div><p>{own}</p></div>{tail}</body>", own))
    return rows


def test_template_of_each_host_goes(spark, empty):
    rnd = random.Random(1)
    rows = site(rnd, "a.example", 40, True) + site(rnd, "b.example", 40, False) + site(rnd, "rare.example", 5, False)
    mirror = [("http://b.example/copy", "<body><div><p>A mirrored page</p><div>with parts</div></div></body>", None)] * 30
    odd = [(None, None, None), ("no host", "", None), ("http://b.example/x", None, None)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(rows + mirror + odd)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in m.extract_text(pages).collect()}
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for i, (u, _, own) in enumerate(rows):
        if "a.example" in u:
            assert got[i]["text"] == f"{own}\nPassage that every article quotes."
        elif "b.example" in u:
            assert got[i]["text"] == own
        else:
            assert got[i]["text"] == f"All of rare.example Contact\n{own}\nImprint of rare.example"  # too few pages to tell
    assert all(got[i]["text"] == "A mirrored page\nwith parts" for i in range(len(rows), len(rows) + 30))
    assert all(got[i]["text"] == "" for i in range(len(rows) + 30, len(got)))
    assert m.extract_text(pages.filter("false")).count() == 0


def test_template_rows_of_pages_with_articles(spark):
    """Menus, adverts and footers around an article are hashed, counted and deleted by their recurrence."""
    around = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy</div><article>{0}</article><footer>Imprint</footer>"
    rows = [(i, f"http://a.example/{i}", around.format(f"<h1>Title {i}</h1><p>Body {i}</p>")) for i in range(20)]
    found = {r["hash"] for r in m.template_table(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    root = m.parse(rows[0][2])
    m.digest(root)
    nav, ad, article, footer = root.children
    assert found == {m.signed(e.digest) for e in (nav, nav.children[0], nav.children[0].children[0], ad, footer)}
    m.delete_template(root, {h % (1 << 64) for h in found})
    assert [e.tag for e in root.children] == ["hr", "hr", "article", "hr"]


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in m.extract_text(df).orderBy("page_id").collect()]


def test_prose_in_recurring_subtrees_stays(spark):
    """Near copies under a div, tables, lists and figures of an article, and passages shared on pages without one."""
    menu, tail = "<div><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></div>", "<div><p>Imprint</p></div>"
    own = [f"Paragraph of page {i} alone, which no other page of the host has." for i in range(15)]
    same = "<div><p>One body</p><ul><li>with an item</li></ul><table><tr><td>and a cell</table><figure><figcaption>and a caption</figcaption></figure></div>"
    want = "One body\nwith an item\nand a cell\nand a caption"
    assert texts(spark, [f"{menu}<article><h1>Title {i}</h1>{same}</article>{tail}" for i in range(15)]) == [f"Title {i}\n{want}" for i in range(15)]
    assert texts(spark, [f"{menu}<h1>Title {i}</h1>{same}{tail}" for i in range(15)]) == [f"Title {i}\n{want}\nImprint" for i in range(15)]
    bare = "A body without paragraphs that many pages share."
    assert texts(spark, [f"{menu}<article><h1>Title {i}</h1><div>{bare}</div></article>" for i in range(15)]) == [f"Title {i}\n{bare}" for i in range(15)]
    shared = [f"<body>{menu}<div><p>{p}</p><p>Passage that all quote.</p><blockquote><p>And another.</p></blockquote>{menu}</div>{tail}</body>" for p in own]
    assert texts(spark, shared) == [f"{p}\nPassage that all quote.\nAnd another." for p in own]
    related = "<div><h3>More stories</h3><ul><li><a href='/1'>One</a></li></ul></div>"
    assert texts(spark, [f"{menu}<article><p>{p}</p>{related}</article>" for p in own]) == own


def test_attributes_are_whole_names():
    """Values and longer names are no attributes, and anchors and prose classes exclude nothing."""
    for a in ("style='overflow:hidden'", 'title="hidden gems"', "data-id='search'", "data-role=form", "data-hidden=1", "title='a class=ad b'", 'alt="id=nav"', "class=notice", "class=navy", "class='navajo researcher'",
              "id=related-work", "id='search-algorithms'", "id=comments-on-x", "data-x='1' \"role=form\"", "aria-hidden=false", "class=a class=ad"):
        for page in ("<article><p>a</p><TAG A>b</TAG></article>", "<div><p>a</p><TAG A>b</TAG></div>"):
            for tag in ("p", "div", "section", "h2"):
                assert text(page.replace("TAG", tag).replace("A>", f"{a}>")) == "a\nb", (a, tag, page)
    for a in ("hidden", "HIDDEN=''", "class='x ad'", "data-x='1'class=\"navbar\"", "id=comments", "id=relatedPosts", "id='sidebar-left'", "id=comments2", "role=navigation", "aria-hidden='true'", "class=main-nav", "class=search-box"):
        assert text(f"<article><p>a</p><div {a}>b</div></article>") == "a", a
    assert text("<article><p>a</p><section id=comments><h3 id=search>b</h3></section><p id=share>c</p></article>") == "a\nb\nc"


def test_rare_template_of_a_large_host_goes(spark):
    """A section's menu on ten pages goes, however many pages the host has."""
    pages = [f"<body>{'<div><span>Section</span></div>' if i < 10 else ''}<div><p>Own words of page {i}</p><p>and more</p></div></body>" for i in range(900)]
    assert texts(spark, pages) == [f"Own words of page {i}\nand more" for i in range(900)]
