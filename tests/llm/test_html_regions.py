"""Operator 7: statistics of slots before names, and whole results against a plain deduction of templates."""

from collections import defaultdict

import pytest

from loomspark.llm import html, queries

DATA = "/root/testdata/sf0.001"


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def article(i):
    return f"<h1>Head {i}</h1><p>{words(i, 40)}</p><p>{words(i + 50, 40)}</p>"


def text(i):
    return f"Head {i}\n{words(i, 40)}\n{words(i + 50, 40)}"


#: What wraps the article, and what of its text stays besides.
KEPT = {
    "content_sidebar_left": lambda i: (f'<div class="content sidebar-left">{article(i)}</div>', ""),
    "menu_page": lambda i: (f'<div id="menu-page">{article(i)}</div>', ""),
    "comments_open": lambda i: (f'<div class="hentry comments-open">{article(i)}</div>', ""),
    "ad_hoc": lambda i: (f'<article>{article(i)}<section class="ad-hoc-networks"><p>{words(i + 90, 30)}</p></section></article>', "\n" + words(i + 90, 30)),
    "notice_of": lambda i: (f'<article>{article(i)}<section id="notice-of-meeting"><p>{words(i + 90, 30)}</p></section></article>', "\n" + words(i + 90, 30)),
    "form_around_all": lambda i: (f"<form><div>{article(i)}</div></form>", ""),
    "sidebar_with_all": lambda i: (f'<div class="sidebar">{article(i)}</div>', ""),
    "more_comments_than_text": lambda i: (f'<article>{article(i)}</article><section class="comment-list"><p>{words(i + 70, 100)}</p></section>', ""),
    "comments_within": lambda i: (f'<article>{article(i)}<div class="user-comments"><p>{words(i + 70, 20)}</p></div></article>', ""),
    "ad_within": lambda i: (f'<article>{article(i)}<div class="ad"><p>{words(i + 70, 20)}</p></div></article>', ""),
}


@pytest.mark.parametrize("pages", [5, 1])
def test_text_is_kept_whatever_its_names(spark, pages):
    rows = [(100 * k + i, f"http://h{k}.example/{i}", f'<body><div>Site name</div><nav><a href="/">home</a></nav>{wrap(i)[0]}<div class="ad">buy {i}</div><footer>(c) {i}</footer></body>') for k, wrap in enumerate(KEPT.values()) for i in range(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (name, wrap) in enumerate(KEPT.items()):
        assert [got[100 * k + i] for i in range(pages)] == [text(i) + wrap(i)[1] for i in range(pages)], name


def plain_texts(pages):
    """Texts of (id, host, html): tokens of each host by their whole occurrence vectors, valid classes, the slots they leave."""
    hosts = defaultdict(list)
    for i, host, page in pages:
        hosts[host].append((i, html.Page(page)))
    out = []
    for own in hosts.values():
        vectors, facts, n = defaultdict(dict), {}, len(own)
        for place, (_, page) in enumerate(own):
            for t, (count, kind, parent, chars, links, flags) in html.page_tokens(page).items():
                vectors[t, kind][place] = count
                f = facts.setdefault((t, kind), [parent, 0, 0, -1])
                f[0], f[1], f[2], f[3] = min(f[0], parent), f[1] + chars, f[2] + links, max(f[3], flags)
        classes = defaultdict(list)
        for token, vector in vectors.items():
            if n >= 3 and len(vector) >= max(3, n / 2):
                classes[tuple(sorted(vector.items()))].append(token)
        valid = [x for c in classes.values() if len(c) >= 2 and sum(kind for _, kind in c) == 0 for x in c]
        found = html.Template([(t, kind, facts[t, kind][0], len(vectors[t, kind]), *facts[t, kind][1:]) for t, kind in valid if kind >= 0])
        out += [(i, "\n".join(b for b, _ in html.decided(page, found))) for i, page in own]
    return sorted(out)


def test_texts_equal_a_plain_deduction(spark):
    read = queries._table(spark, DATA, "pages").collect()
    host = lambda u: (u or "").partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower()
    assert sorted((r.page_id, r.text) for r in queries.op7_html_extraction(spark, DATA).collect()) == plain_texts([(r.page_id, host(r.url), r.html or "") for r in read])
