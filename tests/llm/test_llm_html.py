import pytest

from dayzero.llm import html_extract as hx


def text(page, template=()):
    return hx.main_text(hx.parse(page)[1], set(template))


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; bare", "plain & bare"),
        ("<p>a<p>b<br>c<b>d</b>e &lt;x&gt; &#8364; &nosuch;", "a\nb cde <x> € &nosuch;"),
        ("<p> a \n\t b&nbsp;c </p>\n<p></p><p> </p>", "a b c"),
        ("<article><h1>T</h1><p>x</article><div>other</div>", "T\nx"),
        ("<main><p>x</main><div>other</div>", "x"),
        ("<div role=main><p>x</div>", "x"),
        ("<nav>n</nav><header>h</header><aside>s</aside><form>f</form><footer>f</footer><p>x", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T\nx"),
        ("<script>if (a</p>b) '<p>no</p>'</script><style>p{}</style><p>x", "x"),
        ("<p>x<script>open", "x"),
        ("<!-- <p>no</p> --><p>x<!-- open <p>no", "x"),
        ("<!DOCTYPE html><?pi?><p>x</p >", "x"),
        ("<head><title>t</title><meta x><p>x", "x"),
        ("<div class='ad-box'>no</div><div class=download>yes</div><div id=cookieBanner>no</div>", "yes"),
        ("<p>a<span class=share-buttons>no</span>b", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "1\n2\n3"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
        ("<section id=comments><p>no</section><p>x", "x"),
        ("<p>a<b>b<p>c</b>d", "ab\ncd"),
        ("</p></div>x</b>y", "xy"),
        ("<p title='a>b'>x", "x"),
        ("a<1 b> c<", "a<1 b> c<"),
        ("<textarea>no</textarea><select><option>no</select><button>no</button>x", "x"),
    ],
)
def test_parts_of_a_page(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<p>ok</p>" + "<a " * 300_000, "ok"),
        ("<p>ok</p>" + '<a b=" x ' * 100_000, "ok"),
        ("<p>ok</p><a " + """'>' <b """ * 100_000, None),
        ("<div>" * 50_000 + "deep", "deep"),
        ("<p>x<a href='never closed>link</a><p>y", "xlink\ny"),
        ("<p>x<a href='never closed", "x"),
        ("<p>a<b title='>' class=\"c>d</b>e", "ade"),
    ],
)
def test_broken_tags_take_linear_time_and_leave_no_markup(page, expected):
    import time

    start = time.perf_counter()
    got = text(page)
    assert time.perf_counter() - start < 20
    assert "<" not in got and (expected is None or got == expected)


def test_very_deep_and_very_long_pages():
    assert text("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == "x\ny"
    hx.page_wrapper(*hx.parse("<div><p>" * 3000 + "x"))
    assert len(text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    assert text("<p>x" * 20_000).count("\n") == 19_999


def test_simple_tree_matching():
    a, b = (hx.parse(p)[0] for p in ("<div><ul></ul><p></p><h2></h2><h3></h3></div>", "<div><p></p><ul></ul><h2></h2><h3></h3></div>"))
    # Page, div, h2, h3, and one of ul and p: their order differs.
    assert hx.match_size(a, b, {}) == 5
    merged = hx.merge(a, b).children[0]
    kept = [c.label for c in merged.children if c.every]
    assert kept in (["ul", "h2", "h3"], ["p", "h2", "h3"]) and len(merged.children) == 5


def pages_of(host, n, start=0):
    return [
        (start + i, f"http://{host}/{i}", f"<div class=top>All stories</div><div class=body><p>Story {i}<p>of {host}</div><div class=end>Printed in {host}</div>")
        for i in range(n)
    ]


def test_constant_nodes_are_template(spark, rows):
    copies = [(100 + i, "http://copies.net/a", "<div><p>One and</p><h2>the same</h2></div>") for i in range(20)]
    odd = [(200, None, "<p>a"), (201, "", None), (202, "x://a.net/", ""), (203, None, "<p>a")]
    data = pages_of("many.net", 30) + pages_of("few.net", 3, 50) + copies + odd
    table = spark.createDataFrame([(*d, "h", "w") for d in data], "page_id long, url string, html string, host string, id string")
    got = {r[0]: r[2:] for r in rows(hx.extract_text(table.repartition(6)))}
    assert len(got) == len(data)
    for i in range(30):
        assert got[i][0] == f"Story {i}\nof many.net"
    assert got[50][0] == "All stories\nStory 0\nof few.net\nPrinted in few.net"  # too few pages to tell
    assert {got[100 + i][0] for i in range(20)} == {"One and\nthe same"}  # one page, however often
    assert [got[i][0] for i in (200, 201, 202, 203)] == ["a", "", "", "a"]
    assert all(len(t) == n for t, n in got.values())
    assert rows(hx.extract_text(table.where("false"))) == []


def test_wrapper_does_not_depend_on_the_partitions(spark, rows):
    table = spark.createDataFrame(pages_of("many.net", 60), "page_id long, url string, html string")
    one, many = (sorted(rows(hx.extract_text(table.repartition(n)))) for n in (1, 13))
    assert one == many


def test_headings_of_articles_stay():
    wrapper = None
    for i in range(8):
        root, blocks = hx.parse(f"<div>Menu</div><article><h1>Same title</h1><p>text {i}</article>")
        own = hx.page_wrapper(root, blocks)
        wrapper = hx.join_wrappers(wrapper, own) if wrapper else own
    found = hx.constants(wrapper)
    assert len(found) == 2
    assert text("<div>Menu</div><article><h1>Same title</h1><p>text 9</article>", found) == "Same title\ntext 9"


def test_odd_pages_do_not_switch_off_the_template(spark, rows):
    other = [(2000 + i, "http://many.net/o", f"<table><tr><td>Other {i}<td>Column</table><h3>Note</h3><ul><li>{i}</ul>") for i in range(2)]
    odd = [(1000, "http://many.net/n", None), (1001, "http://many.net/e", ""), *other]
    copies = [(3000 + i, "http://many.net/c", "<div class=top>All stories</div><div class=body><h4>Copy</h4></div>") for i in range(9000)]
    table = spark.createDataFrame(pages_of("many.net", 1000) + odd + copies, "page_id long, url string, html string")
    got = {r[0]: r[2] for r in rows(hx.extract_text(table.repartition(7)))}
    assert all(got[i] == f"Story {i}\nof many.net" for i in range(1000))
    assert [got[1000], got[1001], got[2000]] == ["", "", "Other 0\nColumn\nNote\n0"]
    assert {got[3000 + i] for i in range(9000)} == {"Copy"}


def test_layouts_of_a_host_have_templates_of_their_own():
    first = "<div class=top>Stories</div><div class=body><h2>{}</h2></div><div class=end>End</div>"
    second = "<table><tr><td>Shop</table><ul><li><h3>{}</h3></ul><section>Pay</section><dl><dt>Price</dl>"
    wrapper = None
    for i in range(30):
        own = hx.page_wrapper(*hx.parse((second if i % 3 else first).format(i)))
        wrapper = hx.join_wrappers(wrapper, own) if wrapper else own
    found = hx.constants(wrapper)
    assert text(first.format("x"), found) == text(second.format("x"), found) == "x"


@pytest.mark.parametrize(
    "page",
    [
        "<div id=top>Menu</div><div id=main>{0}</div><div id=bottom>End</div>",
        "<div>Menu</div><div>{0}</div><div>End</div>",
        "<div>Menu</div>{1}<div>{0}</div><div>End</div>",
        "<ul><li>Menu<li>{0}<li>End</ul>",
        "<section>Menu</section>" + "<h2>{0}</h2><blockquote>{0}</blockquote>" * 80 + "<section>End</section>",
        "<h2>Menu</h2>" + "<blockquote>{0}</blockquote><h2>{0}</h2>" * 80 + "<blockquote>End</blockquote>",
        "<div id=post-{0}><div>Menu</div>{0}<div>End</div></div>",
    ],
)
def test_constant_siblings_of_one_label_are_template(page):
    made = [page.format(f"{i} text", "".join(f"<div>{i} more {j}</div>" for j in range(i % 4))) for i in range(40)]
    wrapper = None
    for p in made:
        own = hx.page_wrapper(*hx.parse(p))
        wrapper = hx.join_wrappers(wrapper, own) if wrapper else own
    found = hx.constants(wrapper)
    for i, p in enumerate(made):
        got = text(p, found).split("\n")
        assert "Menu" not in got and "End" not in got and f"{i} text" in got


LONG = "one two three four five six seven eight"


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<main><p>{LONG}</main><article class=card>teaser</article>", LONG),
        (f"<main><p>{LONG}<article class=card>teaser</article></main><div>out</div>", f"{LONG}\nteaser"),
        (f"<div><p>{LONG}</div><article class=card>teaser</article>", f"{LONG}\nteaser"),
        (f"<article><p>{LONG}</article><article>two</article><div>out</div>", f"{LONG}\ntwo"),
        ("<article>文章文章文章文章文章文章</article><div>a b c</div>", "文章文章文章文章文章文章"),
        (f"<div class='content has-sidebar'><p>{LONG}</div>", LONG),
        (f"<div class=no-sidebar><div class=comments-open><p>{LONG}<div class=share-box>no</div></div></div>", LONG),
        (f"<div class=with-cookie-notice><h1>T</h1><p>x</div><div>{LONG}</div>", f"T\nx\n{LONG}"),
        (f"<div class=has-sidebar><article>x y</article></div><div>{LONG}</div>", f"x y\n{LONG}"),
        (f"<div><h1>T</h1><p>{LONG}</div><div class=related-posts><article>no</article></div>", f"T\n{LONG}"),
        (f"<p>x<div class=sidebar>{LONG}</div>", "x"),
    ],
)
def test_main_texts_are_not_dropped_by_a_teaser_or_a_class(page, expected):
    assert text(page) == expected
