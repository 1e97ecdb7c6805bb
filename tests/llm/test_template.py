"""Page text: generated pages against a plain reading, templates by count, broken markup."""

import html
import re
from collections import Counter

import pytest

from dosewise.llm import template
from dosewise.llm.common import table
from dosewise.llm.queries import op8_site_template_removal

SF = "/root/testdata/sf0.01"


def plain(source):
    """The article of the given pages by cutting at their few tags."""
    article = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    source = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = op8_site_template_removal(spark, SF).collect()
    assert len(got) == len(source) and all(r.text == plain(source[r.page_id]) and r.n_chars == len(r.text) for r in got)


def page(spark, *rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, at int, template string")


def texts(df):
    return [r.text for r in sorted(template.extract(df).collect(), key=lambda r: r.page_id)]


def test_recurring_subtrees_are_deleted_per_host(spark):
    body = "<body><div><p>Welcome to <b>our</b> shop</p></div><div><p>Story {0} told</p></div><ul><li>one</li><li>two</li></ul></body>"
    rows = [("http://a.example/x", body.format(i)) for i in range(6)] + [("http://b.example/x", body.format(9))] + [("http://A.example:80/y", "<p>Story 1 told")]
    got = texts(page(spark, *rows))
    assert got[:6] == [f"Story {i} told" for i in range(6)] and got[6] == "Welcome to our shop\n\nStory 9 told\n\none\n\ntwo" and got[7] == "Story 1 told"


def test_articles_lose_what_recurs_and_keep_their_own(spark):
    article = "<article><h1>Title {0}</h1><div class=x>Follow us</div><p>Read more of <b>our</b> stories</p><p>Story {0} is long enough to be most of the page</p></article>"
    got = texts(page(spark, *[("http://a.example/", article.format(i)) for i in range(6)]))
    assert got == [f"Title {i}\n\nStory {i} is long enough to be most of the page" for i in range(6)]


def test_few_pages_or_a_small_share_delete_nothing(spark):
    article = "<article><p>Same text {0}</p><table><tr><td>Yes</td><td>{1}</td></tr></table><ul><li>Introduction</li><li>{1}</li></ul><p>Own text of number {1}, longer than the rest of it all</p></article>"
    few = [("http://a.example/", article.format("", i)) for i in range(4)]
    many = [("http://b.example/", article.format(i % 3, i)) for i in range(15)]  # each first paragraph on a third, cells and items on all
    got = texts(page(spark, *few, *many))
    assert all("Same text" in t and "Yes" in t and "Introduction" in t for t in got) and len(got) == 19


def test_an_article_at_several_addresses_keeps_its_text(spark):
    repost = "<header>h {0}</header><nav>n {0}</nav><div class=content><article><div class=body><p>Published</p><p>everywhere</p><p>again</p></div></article></div>"
    other = "<header>h {0}</header><article><p>Other {0}</p></article>"
    got = texts(page(spark, *[("http://a.example/", repost.format(i)) for i in range(9)], *[("http://a.example/", other.format(i)) for i in range(5)]))
    assert got == ["Published\n\neverywhere\n\nagain"] * 9 + [f"Other {i}" for i in range(5)]


def test_counting_alone_removes_the_given_templates(spark, monkeypatch):
    """Without tags and names that drop, hosts with enough pages lose their menus and footers by count."""
    monkeypatch.setattr(template, "DROPPED", frozenset({"head", "script", "style"}))
    monkeypatch.setattr(template, "DROPPED_NAMES", frozenset())
    monkeypatch.setattr(template, "LANDMARKS", ())
    rows = table(spark, "/root/testdata/sf0.1", "pages").where("url like '%//blog.tionsh.example.com/%'").collect()
    tree = [template.Page(r.html) for r in rows]
    contents = {p.main(): p for p in tree}
    counts = Counter(t for p in contents.values() for t in p.subtrees()[0])
    common = {t for t, n in counts.items() if n >= max(template.MIN_PAGES, len(contents) * (template.MIN_SHARE if t & 1 else template.BOX_SHARE))}
    articles, whole, counted = [plain(r.html) for r in rows], [p.text(set()) for p in tree], [p.text(common) for p in tree]
    assert len(rows) > 300 and not any(w == a for w, a in zip(whole, articles))
    # some menus and adverts are on fewer than MIN_PAGES pages
    assert sum(c == a for c, a in zip(counted, articles)) > 0.4 * len(rows)
    assert all(a in c for c, a in zip(counted, articles))


@pytest.mark.parametrize("source", [
    '<div id="page" class="has-sidebar"><p>{}</p></div>', '<div class="search-results"><p>{}</p></div>', '<div class="no-sidebar"><article><p>{}</p></article></div>',
    '<article><section id="social-history"><p>{}</p></section></article>', '<div class="content header-offset"><p>{}</p></div>', '<div class="sidebar"><p>{}</p></div><p>x</p>'])
def test_names_that_only_mention_a_part_keep_the_text(source):
    assert template.Page(source.format("Some prose")).text(set()).startswith("Some prose")


@pytest.mark.parametrize("name", ["class=sidebar", "id=site-footer", "class='x cookie-notice'", "class=main-menu", "id=comments-area", "role=navigation", "class=ad"])
def test_names_tell_parts_with_little_text(name):
    assert template.Page(f"<div><p>A text that is longer than what is beside it</p></div><div {name}>beside</div>").text(set()) == "A text that is longer than what is beside it"


def test_comments_go_even_if_they_are_long():
    assert template.Page("<p>short</p><section class=comments>" + "<p>chatter</p>" * 50 + "</section>").text(set()) == "short"


def test_equal_pages_count_once(spark):
    assert texts(page(spark, *[("http://a.example/", "<body><div><p>All of it</p></div></body>")] * 8)) == ["All of it"] * 8


def test_more_hits_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(template, "checked", lambda df, rows: df)
    test_recurring_subtrees_are_deleted_per_host(spark)


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("just text &amp; more &lt;", "just text & more <"), ("<p>a\n\t b<p>c<br>d<div>e", "a b\n\nc d\n\ne"),
    ("<article><p><b>x<br></article><footer>no</footer>", "x"), ("<script>var t='</p>';</script><p>y</p><style>p{}</style>", "y"),
    ("<main><header>Head</header><nav>n</nav><p>z &#233;&nbsp;&eacute;</p><div id=comments><article>c</article></div></main>", "Head\n\nz é é"),
    ("<header>h</header><div class='cookie-notice'>c</div><form>f</form><aside>s</aside><p>t</p><div hidden>i</div>", "t"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1\n\n2\n\n3"), ("<p title='a > b'>q</p><!-- <p>no</p> --><p>r <!-- open", "q\n\nr"),
    ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<textarea>x</textarea></p></b>k<", "k<"),
])
def test_markup(source, want):
    assert template.Page(source or "").text(set()) == want


def test_odd_tables(spark):
    assert template.extract(page(spark).limit(0)).count() == 0
    assert texts(page(spark, (None, "<p>a"), (None, "<p>a"), ("no url", None))) == ["a", "a", ""]
