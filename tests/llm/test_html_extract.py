"""Main texts of pages whose parts are known, and wrappers that fold alike however pages are dealt."""

import json

from lakewright.llm import dom
from lakewright.llm import html_extract as E

PAGES = "page_id long, url string, html string, host string, part int, wrapper string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 9, "w") for i, u, h in rows], PAGES)


def texts(spark, rows):
    return {r.page_id: r.text for r in E.extract(pages_of(spark, rows)).collect()}


def declared(k, body):
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>if (a < b) x='<p>no</p>';</script></head><body class='has-sidebar'><header><h2>Site</h2></header>"
        f"<nav><ul><li><a href='/{k}'>Menu {k}</a></ul></nav><div class='cookie-notice'>We use cookies {k}</div><div class='page with-sidebar'><main><article><header><h1>Title {k}</h1></header>{body}"
        f"<aside>Aside {k}</aside><form><label>Mail {k}</label><input></form><section class='comments'><p>Reader {k} says hi</p></section><div class='share-buttons'>Share {k}</div></article></main>"
        f"<div id='sidebar'>Side {k}</div></div><div class=ad>Buy {k}</div><!-- gone {k} --><footer>&copy; {k}</footer></body></html>"
    )


def test_declared_articles(spark):
    rows = [(k, f"https://a.example/{k}", declared(k, f"<p>One  &amp; {k}\n\n two<br>three <b>bold</b>!<p>Open <i>p {k}<ul><li>x{k}<li>y&nbsp;z</ul><table><tr><td>c{k}<td>d</table>")) for k in range(12)]
    got = texts(spark, rows)
    for k in range(12):
        assert got[k] == f"Title {k}\nOne & {k} two three bold!\nOpen p {k}\nx{k}\ny z\nc{k}\nd"


def test_near_copies_on_a_host_stay_whole(spark):
    rows = [(k, f"https://a.example/{k}", f"<body><article><h1>Same</h1><p>Same text.</p><p>Own {k // 20}</p></article></body>") for k in range(20)]
    assert set(texts(spark, rows).values()) == {"Same\nSame text.\nOwn 0"}


def test_wrapper_tells_template_from_content(spark):
    page = "<body><div class=top>Always here</div><div class=x1><p>Story {k} begins</p><p>and ends {k}</p></div><div class=tail>Made with love</div><div class=links><a href=1>go {k}</a> <a href=2>on {k}</a></div></body>"
    rows = [(k, f"http://b.example:80/{k}", page.format(k=k)) for k in range(300)]
    rows += [(1000, "http://alone.example/", page.format(k=1)), (1001, None, page.format(k=2)), (1002, "/relative", page.format(k=2)), (1003, "http://b.example/e", None), (1004, "http://b.example/e", "")]
    got = texts(spark, rows)
    assert all(got[k] == f"Story {k} begins\nand ends {k}" for k in range(300))
    assert got[1000] == "Always here\nStory 1 begins\nand ends 1\nMade with love" and got[1001] == got[1002] != "" and got[1003] == got[1004] == ""


def test_optional_parts_and_broken_markup(spark):
    rows = [(k, "https://c.example/x", f"<body><div class=h>Top</div>{'<div class=promo-box>Sale</div>' * (k % 2)}<div class=t>Text {k} a < b &lt;c&gt; &am{'</div>' * (k % 3)}") for k in range(30)]
    got = texts(spark, rows)
    assert all(got[k] == f"Text {k} a < b <c> &am" for k in range(30))


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>w{k} " + "x" * 200 + "</p><h2>h</h2>" for k in range(3000)) + "</article>"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "http://d.example/", long), (2, "http://d.example/", deep), (3, "http://d.example/", "no markup   at all"), (None, None, "<p>null id"), (5, "http://d.example/", "<p>cut off <b cla"), (6, "http://e.example/", "<p>same</p>"), (6, "http://e.example/", "<p>same</p>")]
    out = E.extract(pages_of(spark, rows)).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    assert got[1].count("\n") == 5999 and got[2] == "deep text" and got[3] == "no markup at all" and got[None] == "null id" and got[5] == "cut off" and got[6] == "same"
    assert E.extract(pages_of(spark, [])).count() == 0


def test_wrappers_fold_in_any_dealing(spark):
    rows = [(k, f"https://h{k % 3}.example/{k}", declared(k, f"<p>{k}</p>" * (k % 4))) for k in range(200)]
    for parts in (1, 7, 150):
        found = {r.host: json.loads(r.wrapper) for r in E.induce(pages_of(spark, rows).repartition(parts)).collect()}
        assert {h: w[2] for h, w in found.items()} == {"h0.example": 67, "h1.example": 67, "h2.example": 66}


def test_simple_tree_matching():
    a, b = (dom.wrapper(dom.parse(f"<body>{x}</body>")) for x in ("<h1>a</h1><div class=q><p>x</p></div><ul><li>1</ul>", "<div class=q><p>y</p></div><table><tr><td>z</table><ul><li>2</ul>"))
    assert dom.matched(a, b) == 8  # html, body, div, p and its text, ul, li and its text
    both = dom.merged(a, b)
    assert [k.key.split(".")[0] for k in both.kids[0].kids] == ["h1", "div", "table", "ul"]
    assert [k.pages for k in both.kids[0].kids] == [1, 2, 1, 2]
