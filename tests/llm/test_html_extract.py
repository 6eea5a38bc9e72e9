import html
import os
import re

import pytest
from cases import prose

from clipmill.llm import html_extract as h
from clipmill.llm.html_blocks import blocks

SF_DIR = "/root/testdata/sf0.01"


def page(body, rest="", seed=0):
    return (
        f"<!DOCTYPE html><html><head><title>{prose(3, seed)}</title><style>p{{a:b}}</style><script>var t='</p>';</script></head>"
        f"<body><nav><ul><li><a href='/'>{prose(1, seed + 1)}</a></li><li><a href='/a'>{prose(2, seed + 2)}</a></li></ul></nav>"
        f"{body}{rest}<footer>&copy; {prose(3, seed + 3)}</footer></body></html>"
    )


@pytest.fixture(scope="module")
def labeller(spark):
    pages = [page("<article><h1>%s.</h1>%s</article>" % (prose(5, i), "".join(f"<p>{prose(30, i * 50 + k)}.</p>" for k in range(4))), seed=i) for i in range(60)]
    return h.train(spark.createDataFrame([(p,) for p in pages], "html string"), h.Fit(pages=60))


def test_blocks_of_untidy_markup():
    found = blocks(
        "<div class='main-text'><p>One <b>bo</b>ld &amp; a&nbsp;gap<br>more<p>Two <!-- no > text --><a href='x>y'>link</a>"
        "<script>if (a<b) '</p>'</script> tail</div>text &lt;i&gt; 1 < 2<td>cell<style>x"
    )
    assert [b.text for b in found] == ["One bold & a gap more", "Two link tail", "text <i> 1 < 2", "cell"]
    assert found[0].path == ("div", ".main", ".text", "p") and found[1].linked == 4 and found[2].path == ()
    assert blocks(None) == blocks("") == blocks("<p>  </p><!-- x") == []
    assert [b.text for b in blocks("cut &am")] == ["cut &am"] and len(blocks("<p>x" * 5000)) == 5000


def test_only_code_is_dropped_unread():
    found = blocks(
        "<article><p>see <button type=button>More</button></p><p><math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>"
        "<noscript><p>Without</p></noscript><object>Fallback</object><div><button>Share</button> <select><option>A</select></div>"
        "<p><a href=http://x.com/>to x</a></p><p><br/>end</p><script>no</script><template><p>no</p></template></article>"
    )
    assert [b.text for b in found] == ["see More", "x=1 holds", "Without", "Fallback", "Share", "A", "to x", "end"]
    assert [h.is_main(b.path) for b in found] == [True] * 4 + [False, False, True, True]
    assert found[6].linked == 4 and found[7].path == ("article", "p")


def test_pages_teach_where_their_article_begins():
    found = blocks("<nav>%s</nav><article>%s</article>" % ("<p>a</p>" * 500, "<p>b</p>" * 400))
    some = h._window(found, 120)
    assert len(some) == 120 and sum(h.is_main(b.path) for b in some) == 60
    assert h._window(found[:50], 120) == found[:50] and len(h._window(found[:510], 120)) == 120


def test_short_paragraphs_stay(labeller):
    features = h.Features(labeller.fit)
    for i in range(20):
        parts = [prose(30, 900 + i) + ".", prose(1, i) + ".", prose(25, 950 + i) + ".", prose(2, i + 40) + "."]
        body = f"<article><h1>{prose(4, i)}</h1>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"
        assert h.texts_of([page(body, seed=i)], labeller, features) == ["\n\n".join([prose(4, i), *parts])]


def test_the_sample_is_bounded_by_different_pages(spark):
    pages = [(page(f"<article><p>{prose(30, i)}.</p></article>", seed=i),) for i in range(8)]
    df = spark.createDataFrame(pages[:1] * 300 + pages, "html string")
    one, two = (h.train(d, h.Fit(pages=5, rounds=1)) for d in (df, df.distinct().repartition(3)))
    assert one.trained and all((one.w[k] == two.w[k]).all() for k in one.w)


def test_main_text_in_other_layouts(spark, labeller):
    main = [prose(4, 7), prose(40, 8) + ".", prose(35, 9) + "."]
    body = f"<div class='content'><h1>{main[0]}</h1><p>{main[1]}</p><div class='ad'>{prose(3, 20)}</div><p>{main[2]}</p></div>"
    rest = (
        f"<aside class='sidebar'><h3>{prose(2, 10)}</h3><p>{prose(20, 11)}</p></aside>"
        f"<div class='cookie-notice'><p>{prose(12, 12)}</p></div><form><label>{prose(2, 13)}</label></form>"
        f"<section class='comments'><div class='comment'><p>{prose(25, 14)}.</p></div></section>"
    )
    df = spark.createDataFrame([(1, page(body, rest)), (2, page(f"<article><p>{main[1]}</p></article>"))], "page_id long, html string")
    got = {r.page_id: r for r in h.extract(df, labeller).collect()}
    assert got[1].text == "\n\n".join(main) and got[2].text == main[1] and got[2].n_chars == len(main[1])


def test_awkward_rows(spark, labeller):
    rows = [(None, None, "x"), (1, "", "x"), (2, "no tags at all", None), (2, "no tags at all", None), (3, "<p>" * 3000, ""), (4, "<article>" + "<p>a b</p>" * 3000, "")]
    df = spark.createDataFrame(rows, "page_id long, html string, Text string")
    got = h.extract(df, labeller).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got) and got[0].text == got[1].text == ""
    assert h.extract(df.where("false"), labeller).count() == 0
    bare = h.train(df.where("false"))
    kept = {r.page_id: r.text for r in h.extract(df, bare).collect()}
    assert kept[4] == "\n\n".join(["a b"] * 3000) and kept[2] == ""


def test_results_do_not_depend_on_the_batch(labeller):
    pages = [page(f"<main><p>{prose(20 + i, i)}</p></main>", seed=i) for i in range(20)]
    features = h.Features(labeller.fit)
    together = h.texts_of(pages, labeller, features)
    assert together == [h.texts_of([p], labeller, features)[0] for p in pages]


def expected(page):
    """The article of the given tables' pages by regular expressions."""
    inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)[1]
    parts = [re.sub("<br>", " ", p) for p in re.split(r"</?(?:p|h1)>", inside)]
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
def test_given_pages_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = h.extract(pages, h.train(pages)).collect()
    assert [r.page_id for r in got if r.text != expected(r.html)] == []
