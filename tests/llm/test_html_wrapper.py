"""Wrapper inference and main texts of small sites."""

import pytest

from termtrail.llm import html_wrapper as hw
from tests.conftest import SMALL

SCHEMA = "page_id long, url string, html string, main string, host int"


def page(title, paras, menu=("Home", "News"), extra="", tail="<div class='comments'><p>Nice one!</p></div>"):
    return ("<!DOCTYPE html><html><head><title>x</title><script>if (a < b) { '</p>' }</script></head><body>"
            "<header><h1>The Site</h1></header><nav><ul>" + "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu)
            + f"</ul></nav><div id=cookie-notice>We use cookies and so do all others, as you may well know.</div>{extra}"
            f"<div class=content><h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paras)
            + f"<form><p>Your mail</p></form>{tail}</div><div class='side-bar sidebar'>Most read: a, b and c, and much more of it."
            "</div><footer>&copy; all</footer></body></html>")


PAGES = [page("One", ["First <b>bold</b>\n  text.", "Second &amp; last&nbsp;&lt;p&gt;."]),
         page("Two", ["Only one, which is somewhat longer than others are."], menu=("Home",)),
         page("Three", ["a", "b", "c", "d"], extra="<aside>Something else that is rather long here</aside>"),
         page("Four", ["Open", "ended<br>line"], tail="")]
TEXTS = ["One\nFirst bold text.\nSecond & last <p>.", "Two\nOnly one, which is somewhat longer than others are.",
         "Three\na\nb\nc\nd", "Four\nOpen\nended line"]


def test_wrapper_has_repeated_optional_and_slot_parts():
    text, paths = hw.infer(PAGES)
    assert "(<li><a>#</a></li>)+" in text and "(<p>#</p>)+" in text and ")?" in text and "<h2>#</h2>" in text
    assert "The Site" in text and paths == [["html", "body", "div.content"]]
    assert [hw.extract(p, paths) for p in PAGES] == TEXTS


def test_folding_finds_nested_repeats():
    keys = ["<ul>", "<li>", "#", "<b>", "#", "<b>", "#", "</li>", "<li>", "#", "<b>", "#", "<b>", "#", "</li>", "</ul>"]
    folded = hw.fold([hw.Node(k, "t" if k == "#" else None) for k in keys])
    assert hw.expression(folded) == "<ul>(<li>#(<b>#)+</li>)+</ul>"


@pytest.mark.parametrize("broken, text", [
    (None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a\nb"), ("<article><p>cut of", "cut of"),
    ("<article><p>kept</p><p", "kept"), ("<article><p>kept</p></artic", "kept"), ("<article>x &am", "x &am"),
    ("<article>1 < 2 & 3</article>", "1 < 2 & 3"), ("<article><!-- no <p>never", ""), ("<article>a<script>b", "a"),
    ("<body><nav>only a menu</nav></body>", ""), ("<div hidden>h</div><div role=navigation>n</div><div>t</div>", "t"),
    ("</div></p><article>x</section></article>", "x"), ("<article title='a > b'>q\x00 w</article>", "q\x00 w")])
def test_broken_pages(broken, text):
    assert hw.extract(broken, hw.main_paths([broken], set())) == text


def test_long_page_is_whole():
    body = ["word " * 50 + str(i) for i in range(4000)]
    assert hw.extract(page("T", body), [["html", "body", "div.content"]]).count("\n") == 4000


def test_query_rows(spark):
    rows = [(i, f"http://a.net/{i}", p, "m", 0) for i, p in enumerate(PAGES)]
    rows += [(0, "http://a.net/0", PAGES[0], "m", 0), (9, None, None, None, None), (None, "http://b.net", "<p>lone</p>", "", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    known = hw.wrappers(pages)
    assert {r.host for r in known.collect()} == {"a.net", "", "b.net"}
    got = sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in hw.main_texts(pages, known).collect())
    want = [*enumerate(TEXTS), (0, TEXTS[0]), (9, ""), (-1, "lone")]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert hw.main_texts(pages.limit(0), hw.wrappers(pages.limit(0))).count() == 0


def test_articles_of_the_pages_table(spark):
    rows = hw.query(spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert "track(" not in r.text and "©" not in r.text and r.text and len(r.text) == r.n_chars
        assert r.text.split("\n")[0].split()[0] in pages[r.page_id].split("<h1>")[1]


@pytest.mark.parametrize("tag", [
    "<div style='overflow:hidden'>", "<div title='the hidden truth'>", "<div data-id=nav>", "<div data-hidden=no>",
    "<div aria-hidden='false' class=x>", "<article class='post social'>", "<body class='has-sidebar'>", "<main id=search>",
    "<div title=\"class='ad'\">", "<div data-x='a'data-role=navigation>"])
def test_other_attributes_and_roots_mark_nothing(tag):
    broken = f"{tag}<p>kept"
    assert hw.extract(broken, hw.main_paths([broken], set())) == "kept"


@pytest.mark.parametrize("tag", ["<div hidden>", "<div id=nav>", "<div title=x class='ad'>", "<div HIDDEN=''>", "<div x='y'class=ad>"])
def test_whole_attributes_still_mark(tag):
    broken = f"{tag}<p>menu</div><div><p>kept</div>"
    assert hw.extract(broken, hw.main_paths([broken], set())) == "kept"


@pytest.mark.parametrize("body, text", [
    ("<div class=content><p>one</p><ul><li>long list, long list</li></ul><p>two</p></div>", "one\nlong list, long list\ntwo"),
    ("<div><section class=a>short</section><section class=b>much longer one</section></div>", "short\nmuch longer one"),
    ("<div>before<table><tr><td>a cell of some length</td></tr></table>after</div>", "before\na cell of some length\nafter"),
    ("<article class=a>first</article><article class=b>the second</article>", "first\nthe second")])
def test_all_containers_of_the_text(body, text):
    assert hw.extract(body, hw.main_paths([body], set())) == text


def test_second_template_with_a_teaser_in_the_hosts_container():
    other = "<html><body><div class=content>Teaser</div><div class=story><p>A whole article of its own.</p></div></body></html>"
    assert hw.extract(other, [["html", "body", "div.content"]]) == "Teaser\nA whole article of its own."


def test_all_pages_of_a_host_count(spark):
    same = "<p>Read all our stories</p>"
    rows = [(i, f"http://a.net/{i}", f"<body><div class=content>{same}<p>{'text ' * 20}{i}</p></div></body>", "", 0) for i in range(40)]
    rows += [(i, f"http://a.net/{i}", f"<body><div class=story>{same}<h2>Story {i}</h2>" + f"<p><b>x</b>{i}</p><hr>" * 2000
              + "</div></body>", "", 0) for i in range(40, 43)]
    rows += [(i, "http://b.net", "<div>Copy</div>", "", 0) for i in range(43, 47)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in hw.main_texts(pages, hw.wrappers(pages)).collect()}
    assert got == {i: (f"{'text ' * 20}{i}" if i < 40 else "\n".join([f"Story {i}"] + [f"x{i}"] * 2000) if i < 43 else "Copy")
                   for i in range(47)}


def test_constants_within_articles_stay(spark):
    body = "<body><div class=box>Same on all</div><article><h2>Introduction</h2><p>Story %d of them.</p><p>The End.</p></article></body>"
    pages = spark.createDataFrame([(i, "http://c.net/", body % i, "", 0) for i in range(4)], SCHEMA)
    got = {r.page_id: r.text for r in hw.main_texts(pages, hw.wrappers(pages)).collect()}
    assert got == {i: f"Introduction\nStory {i} of them.\nThe End." for i in range(4)}


@pytest.mark.parametrize("body, text", [
    ("<article><title-card>Hello</title-card><p>Rest</p></article>", "Hello\nRest"),
    ("<article>a<select-x>b</select-x>c</article>", "abc"), ("<article><script-y>b</script-y><p>c</p></article>", "b\nc"),
    ("<p title=it's>one</p><p title=it's>two</p>", "one\ntwo"), ("<p title=\"it's > that\">one</p><p>two</p>", "one\ntwo"),
    ("<article><p a='b>one</p><p>two</p></article>", "one\ntwo"), ("<p" + " a='b'" * 5000, ""),
    ("<article><section id=\"social-policy\">x</section><div class='related-work'>y</div><div class=search-result-summary>z</div></article>",
     "x\ny\nz"),
    ("<article>x<div class='related-articles'>y</div><div id=commentList>z</div><p class='top share-buttons'>s</p></article>", "x\ns")])
def test_names_and_values_of_tags(body, text):
    assert hw.extract(body, hw.main_paths([body], set())) == text


def _texts(spark, bodies):
    pages = spark.createDataFrame([(i, "http://d.net/", b, "", 0) for i, b in enumerate(bodies)], SCHEMA)
    known = hw.wrappers(pages)
    return known.first().main, [r.text for r in hw.main_texts(pages, known).orderBy("page_id").collect()]


def test_slots_and_constants_are_told_by_place(spark):
    titles = ["One", "Two", "Contact", "Four", "Five"]
    bodies = [f"<body><div class=content><h2>{t}</h2><p>About {t}.</p>" + "<h4>Ask us</h4>" * (i % 2) + "<h3>Contact</h3></div></body>"
              for i, t in enumerate(titles * 2)]
    bodies = [b.replace("</p>", f"</p><p>{i}</p>" if i % 3 else f" {i}</p>") for i, b in enumerate(bodies)]
    _, got = _texts(spark, bodies)
    # "Contact" is constant as the last heading only, "Ask us" where a page has it; a paragraph is a repetition
    assert got == [f"{t}\nAbout {t}." + (f"\n{i}" if i % 3 else f" {i}") for i, t in enumerate(titles * 2)]


def test_every_page_takes_a_way_through_its_wrapper(spark):
    bodies = [f"<body><div class=a>{f'<b>{i}</b>' * (i % 3)}<ul>{f'<li>{i}</li>' * (1 + i % 4)}</ul>{'<hr>' * (i % 2)}<p>{i}</p></div></body>"
              for i in range(40)]
    main, got = _texts(spark, bodies)
    one = hw.Extractor(main)
    assert got == [hw.extract(b, [["body", "div.a"]]) for b in bodies]
    for b in bodies:
        line = [k for k, *_ in hw.folded(hw.read(b)[0])]
        way = hw.match(one.wrapper, line)
        assert all(i is not None for i, *_ in way) and [j for _, j, _ in way] + [len(line)] == [0] + [k for *_, k in way]
        left = set(range(len(one.wrapper.nodes))) - {i for i, *_ in way}
        assert all(one.wrapper.nodes[i].pages < one.wrapper.pages for i in left)


def test_single_units_and_optional_parts_align():
    many, one = (hw._single(f"<ul>{'<li>x</li>' * n}</ul><p>{n}</p>") for n in (3, 1))
    for a, b in ((many, one), (one, many)):
        assert hw.expression(hw.align(a, b).nodes) == "<ul>(<li>#</li>)+</ul><p>#</p>"
    nested = hw.align(hw._single("<ul><li><b>x</b></li><li><b>x</b><b>y</b></li><li><b>x</b><b>y</b></li></ul>"), hw._single("<ul></ul>"))
    assert hw.expression(nested.nodes) == "<ul>((<li>(<b>#</b>)+</li>)+)?</ul>"
    assert [k for k, *_ in hw.folded(["<a>"] * 3 + ["#x", "#x"])] == [("<a>",), "#x", "#x"]


def test_long_unfolded_streams_match():
    keys = [f"<{'abc'[i * i % 3]}{i % 7}>" for i in range(3000)]
    wrapper = hw.Wrapper(2, [hw.Node(k, None, 1 + i % 2) for i, k in enumerate(keys)])
    assert [i for i, *_ in hw.match(wrapper, keys)] == list(range(3000))
    assert len(hw.match(wrapper, keys[1::2])) == 1500
