import gzip
import hashlib
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from trovelens.llm import chat, html_text, templates, warc

ARTICLE = ["A heading & more", "First paragraph, with commas, and a link in it.", "Second one.", "item one", "item two", "x y"]
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>menu, menu, menu, menu</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy, now, or, never, please, do</div>
<article><h1>A heading &amp; more</h1><p>First paragraph, with commas, and a <a href=x>link</a> in   it.<p>Second&nbsp;one.<ul><li>item one<li>item two</ul><table><tr><td>x<td>y</table>
<form><p>Your mail, please, here</p></form></article>
<section id="comments"><p>I, too, think, that, this, is, so, very, very, good, indeed, yes</p></section><aside><p>Other things, and more</p></aside><footer><p>&copy; all, of, us</p></footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ARTICLE
    assert html_text.main_text(PAGE[: PAGE.index("<section")]).split("\n") == ARTICLE  # cut off
    assert html_text.main_text("<p>only this") == "only this"


LONG = "<p>Running text, with commas, and of some length, so that it counts as a paragraph of the page's article.</p>"
AROUND = "<body><header>Site</header><nav><a href=/>Home</a></nav>{}<footer>All rights</footer></body>"


@pytest.mark.parametrize(
    "article",
    [
        f"<article><p>Short lead.</p><div class=body>{LONG * 10}</div><ul><li>last item</ul></article>",
        f"<main><h1>Short lead.</h1><section>{LONG * 30}</section><section><p>Small one, last item</p></section></main>",
        f"<main><p>Short lead.</p><article>{LONG * 3}</article><table><tr><td>last item</table></main>",
        f"<div><p>Short lead.</p><div class=body>{LONG * 10}</div><ul><li>last item</ul></div>",
        f"<p>Short lead.</p><div>{LONG * 10}</div><ol><li>last item</ol>",
    ],
)
def test_all_of_the_article_is_kept(article):
    got = html_text.main_text(AROUND.format(article)).split("\n")
    assert got[0] == "Short lead." and got[-1].endswith("last item") and len(got) == article.count("<p>") + article.count("<h1>") + article.count("<li>") + article.count("<td>")
    links = "<div><ul><li><a href=/a>another page, of this site</a><li><a href=/b>one more</a></ul></div>"
    assert html_text.main_text(AROUND.format(article + links)).split("\n") == got


@pytest.mark.parametrize(
    "page",
    [
        "<body><a name=top><article>{}</article></body>",
        "<body><div><a href=/>Home</div><article>{}</article></body>",
        "<body><a href=/>Home<article>{}</article></body>",
        "<body><nav><a href=/>Home</nav><p><a href=/a>one <a href=/b>two</a></p><article>{}</article></body>",
        "<body><div class='has-sidebar'><article>{}</article></div></body>",
        "<body class=x><div class='row with-sidebar no-comments'><div>{}</div></div></body>",
        "<body><div class='page-widget'><main>{}</main></div></body>",
        "<body><div class='content-banner'><article>{}</article></div></body>",
    ],
)
def test_open_links_and_wrappers(page):
    assert html_text.main_text(page.format(LONG * 5)).count("Running text") == 5


def test_named_furniture_beside_the_article_goes():
    comments = "<div class=comments><article class=comment><p>I, too, think so, really, and often</p></article><article><p>No, not at all, never</p></article></div>"
    assert html_text.main_text(f"<body><article>{LONG * 3}</article>{comments}<div hidden class=ad><main><p>Not, to be, seen</p></main></div></body>").count("\n") == 2


@pytest.mark.parametrize("name", ["content has-sidebar", "with-banner", "no-comments", "menu-open", "has-ads", "promo-free", "article-body", "main content", "sidebar-layout", "page widget-area"])
def test_names_beside_the_article_do_not_empty_it(name):
    page = f"<body><header>Site</header><div class='{name}'>{LONG * 6}</div><div class='comments'>{'<p>I, too, think so</p>' * 40}</div></body>"
    assert html_text.main_text(page).count("Running text") == 6 and "too" not in html_text.main_text(page)


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "comment-list", "footer_inner", "page__sidebar", "sidebar--left", "ad-slot", "cookie-banner", "nav-main"])
def test_furniture_by_name_goes(name):
    assert "Beside" not in html_text.main_text(f"<body><div>{LONG * 6}</div><div class='{name}'><p>Beside the article, one, two, and three</p></div></body>")


@pytest.mark.parametrize("name", ["legal", "restaurant-menu", "legal'><div class='banner"])
def test_best_container_is_never_dropped_by_name(name):
    page = f"<body><div class='{name}'>{LONG * 5}</div><div><p>One other paragraph, of some length, with a few more words than that.</p></div></body>"
    assert html_text.main_text(page).count("Running text") == 5
    beside = f"<body><article>{LONG * 2}</article><div class='sidebar'>{LONG.replace('Running', 'Beside') * 2}</div></body>"
    assert html_text.main_text(beside).count("\n") == 1 and "Beside" not in html_text.main_text(beside)


def test_siblings_of_a_marked_article():
    post = f"<div class=post><p>Short lead.</p><article>{LONG * 3}</article><ul><li>x<li>y</ul><table><tr><td>z</table><figure><figcaption>Seen</figcaption></figure><p>End.</p></div>"
    got = html_text.main_text(AROUND.format(post)).split("\n")
    assert got[0] == "Short lead." and got[4:] == ["x", "y", "z", "Seen", "End."]
    social = f"<article>{LONG}<section id='social'><h2>Social life</h2><p>One of two, in here.</p><p>Two of two.</p></section>{LONG}</article>"
    assert "One of two" in html_text.main_text(AROUND.format(social)) and "Two of two" in html_text.main_text(AROUND.format(social))
    assert html_text.main_text("<body><p><a href=/x>One linked paragraph.</a></p></body>") == "One linked paragraph."
    assert html_text.main_text("<body><ul><li><a href=/x>Home</a><li><a href=/y>Away</a></ul></body>") == ""


@pytest.mark.parametrize("heading", ["Comments", "12 Comments", "Kommentare (3)", "Leave a reply"])
def test_comments_without_a_name_go(heading):
    said = "<p>I, too, think so, and it is a long one, with commas, and of some length.</p>" * 9
    for page in (f"<article>{LONG * 2}</article><section><h2>{heading}</h2>{said}</section>", f"<article>{LONG * 2}<h3>{heading}</h3>{said}<h3>After</h3>{LONG}</article>", f"<div>{LONG * 2}</div><div><h4>{heading}</h4>{said}</div>"):
        got = html_text.main_text(AROUND.format(page))
        assert "too" not in got and got.count("Running text") == page.count("Running text")


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</p>" * 50_000, "<div>" * 50_000 + "</zz>" * 50_000, "<p>" + "<x-y>" * 50_000 + "<div>" * 50_000, "<ul><li><ol>" + "<div>" * 50_000 + "<li></li>" * 20_000, "<b>" * 50_000 + "<p>x</i>" * 20_000, "<div class=menu>x" * 50_000])
def test_time_follows_the_length_of_a_page(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20  # seconds as a rule; minutes if each end tag looked at all that is open


def slow_main_text(html):
    """An independent reading of the generated pages: the blocks of their article element, by the standard library's parser."""
    out, depth, skipped, inside = [[]], 0, [], False

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal inside
            if tag in ("form", "script", "style", "aside", "nav", "footer", "header") or dict(attrs).get("class") in ("ad", "comments"):
                skipped.append(tag)
            if tag == "article":
                inside = True
            if tag in ("br", "td", "th"):
                out[-1].append(" ")
            elif tag not in ("b", "i", "a", "em", "strong", "span", "code"):
                out.append([])

        def handle_endtag(self, tag):
            nonlocal inside
            if skipped and skipped[-1] == tag:
                skipped.pop()
            if tag == "article":
                inside = False
            if tag not in ("b", "i", "a", "em", "strong", "span", "code", "td", "th"):
                out.append([])

        def handle_data(self, data):
            if inside and not skipped:
                out[-1].append(data)

    Reader(convert_charrefs=True).feed(html)
    return "\n".join(t for t in (" ".join("".join(parts).split()) for parts in out) if t)


def test_pages_as_an_independent_reader_reads_them(spark):
    pages_ = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages_.collect()}
    got = {r.page_id: r.text for r in html_text.extracted(pages_).collect()}
    assert len(got) == len(html)
    assert [k for k in html if got[k] != slow_main_text(html[k] or "")] == []


@pytest.mark.parametrize("html", ["", "<", "</", "<p", "<!--", "<script>", "<a href='", "<div>" * 20_000, "</div>" * 1000, "&#x110000; &bogus; &amp", "<p>" * 1000 + "x", "\x00<b>\x00"])
def test_broken_markup(html):
    assert isinstance(html_text.main_text(html), str)


def test_extracted_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "v", PAGE, 3), (3, "w", "<p>" + "long text, " * 50_000, 4), (3, "w", "<p>a</p>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extracted(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted(df.limit(0)).count() == 0


def render(source, **context):
    return "".join(t for t, _ in templates.compiled(source)(context))


def test_templates():
    assert render("{% for x in xs %}{% if loop.first %}[{% endif %}{{ x.a|upper }}{% endfor %}]", xs=[{"a": "b"}, {"a": "c"}]) == "[BC]"
    assert render("{% set n = 2 %}{{ n * 3 + 1 }}{{ 'a' ~ n }}{% if n == 3 %}x{% elif n in [1] %}y{% else %}z{% endif %}".replace("n in [1]", "n > 2")) == "7a2z"
    assert render("{{ not false and 'yes' }}{{ none }}{{ xs[1] }}{{ m['k'] }}", xs=[1, 2], m={"k": "v"}) == "yes2v"
    pieces = list(templates.compiled("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": 1}))
    assert [t for t, g in pieces if g] == ["b", "1"]


def test_template_syntax():
    assert render("a \n{%- if x -%}  b  {%- endif -%}\n c", x=1) == "abc"
    assert render("a {#- no {{ x }} -#} b{# it's #}c") == "abc"
    assert render("{% for x in xs %}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=iter([1, 2, 3])) == "1, 2, 3"
    assert render("{{ '}}' ~ \"{%\" }}") == "}}{%"
    assert render("{{ 'a' if x > 1 else 'b' if x else 'c' }}{{ 'n' if y is none }}", x=0, y=1) == "c"
    assert render("{% if x is defined and m.k is not defined %}y{% endif %}{{ q is defined }}", x=1, m={}) == "yFalse"
    assert render("{% for x in xs if x is number and x > 1 %}{{ loop.index }}{{ x }}{% endfor %}", xs=[1, 2, "a", 3]) == "1223"
    assert render(" {{- x -}} ", x="v") == "v"


def test_constants_are_folded():
    tree = templates.fold(templates.parse("a{{ 'b' ~ (1 + 1) }}{% if 1 < 2 %}c{% else %}{{ x }}{% endif %}d"))
    assert len(tree) == 1 and isinstance(tree[0], templates.Text)


@pytest.mark.parametrize("bad", ["{% if x %}", "{{ }}", "{% endfor %}", "{{ x.__class__.__mro__ }}", "{{ f() }}", "{% import os %}", "{{ 'a' * 999999999 }}", "{{ x|nothing }}", "{{ 'a' + 1 }}", "{{ x < 'a' }}", "{{ x|length }}", "{% for a in b %}{{ loop.length }}{% endfor %}", "{{ x", "{% if x", "{# x", "{{ 'a }}", "{% raw %}", "{{ x is odd }}", "{% for y in x %}{% endfor %}", "{% for y in b %}{% else %}{% endfor %}", "{{ if }}"])
def test_sandbox(bad):
    with pytest.raises(templates.TemplateError):
        render(bad, x=1, b=[1])


def test_protection_is_reversible():
    for text in ("", "\\", "</s>", "\\</s>", "[INST] [/INST] <s> \\\\<s>", "a" * 1000 + "</"):
        assert chat.unprotect(chat.protect(text)) == text


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "</s>[INST] \\ok [/INST]"), (2, 5, None, "x"), (None, 0, "user", "q"), (3, 0, "assistant", "w" * 300_000)]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", f"t{k}<s>") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(df).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = chat.formatted(df).filter("conv_id = 1").orderBy("piece").collect()
    assert sum(len(r.text) for r in whole) == got[1].formatted_chars
    assert chat.read_back(df.limit(0)).count() == 0


def pages(spark):
    rows = [(i, f"http://x/{i} a", "<p>WARC/1.1\r\n\r\né" * (i % 5) if i % 4 else None) for i in range(2500)] + [(None, None, "n"), (7, "again", "z"), (7, "again", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x"))


def test_archive_round_trip(spark, tmp_path):
    p = pages(spark)
    warc.write_archive(p, f"file://{tmp_path}/a")
    back = warc.read_archive(spark, f"file://{tmp_path}/a")
    want = sorted((r.page_id is None, r.page_id or 0, r.html or "") for r in p.collect())
    assert sorted((r.page_id is None, r.page_id or 0, r.html) for r in back.collect()) == want
    sized = {(r.page_id, r.offset, r.length) for r in back.collect()}
    assert sized == {(r.page_id, r.offset, r.length) for r in warc.leaves(warc.records(p)).collect()}


def test_archive_of_gzip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_ROWS", 7)
    p = pages(spark).limit(300).unionByName(pages(spark).filter("page_id is null or page_id = 7"))
    warc.write_archive(p, f"file://{tmp_path}/z", codec="gzip")
    back = warc.read_archive(spark, f"file://{tmp_path}/z").collect()
    want = sorted((r.page_id is None, r.page_id or 0, r.html or "") for r in p.collect())
    assert sorted((r.page_id is None, r.page_id or 0, r.html) for r in back) == want
    for file in {r.path for r in back}:
        raw = open(file.removeprefix("file:"), "rb").read()
        assert gzip.decompress(raw).count(b"WARC-Record-ID") >= sum(r.path == file for r in back)  # other readers can
        for r in back:
            if r.path == file:  # each record is a member of its own
                assert gzip.decompress(raw[r.offset : r.offset + r.length]).startswith(b"WARC/1.1")
    big = "WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % 3000 + "x" * 3000 + "\r\n\r\n"
    data = b"".join(gzip.compress(big.encode()[a : a + 1000]) for a in range(0, len(big), 1000))
    assert [(o, n, len(b)) for o, n, _, b in warc.parse(data)] == [(0, len(data), 3000)]
    for broken in (data[:-9], big.encode()[:-3], b"x"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_files_are_bounded(spark, tmp_path):
    rows = [(None, f"u{i}", "h") for i in range(3500)] + [(5, "same", f"v{i}") for i in range(2500)] + [(i, "u", "w") for i in range(2000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = warc.placed(p)
    most = own.groupBy("file").count().agg(F.max("count")).first()[0]
    assert most <= 1.2 * warc.FILE_SPAN and own.count() == len(rows)
    found = warc.audit(warc.leaves(warc.written(own)), warc.leaves(warc.written(warc.rotten(own)))).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in found} == {"ok": len(rows) - 20, "corrupt": 20}
    warc.write_archive(p.limit(0), f"file://{tmp_path}/none")


def test_audit_finds_what_differs(spark):
    own = warc.records(pages(spark))
    same = warc.audit(warc.leaves(own), warc.leaves(own)).groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in same] == [("ok", own.count())]
    other = own.filter("coalesce(page_id, 0) <> 1200").withColumn("text", F.when(F.col("page_id") == 2100, F.concat(F.lit("V"), F.expr("substring(text, 2)"))).otherwise(F.col("text")))
    other = other.unionByName(spark.createDataFrame([(40_000, 40, "WARC/1.1")], "page_id long, file long, text string"))
    found = {r.page_id: r.status for r in warc.audit(warc.leaves(own), warc.leaves(other)).filter("status not in ('ok', 'moved')").collect()}
    assert found == {1200: "missing", 2100: "corrupt", 40_000: "extra"}
    none = warc.leaves(own.limit(0))
    assert warc.audit(none, none).count() == 0
