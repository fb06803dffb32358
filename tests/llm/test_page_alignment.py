"""Pages that mark nothing: what alignment alone finds, with recall and precision, and the whole operator against a plain one."""

import random

import pytest

from treeline.llm import op8_html


def site(seed: int, pages: int):
    """(url, html, article lines, furniture lines): menus and footers that pages share, with sections that have their own."""
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(n))
    menu, foot = [say(2) for _ in range(6)], [say(7) for _ in range(3)]
    side = {k: [say(4) for _ in range(4)] for k in range(3)}
    out, last = [], None
    for k in range(pages):
        section = k * 3 // pages
        own = [say(r.randint(8, 30)) for _ in range(r.randint(2, 7))]
        if last and r.random() < 0.1:
            own[0] = r.choice(last)  # a quotation of the page before
        extra = [say(5)] if r.random() < 0.3 else []  # a notice that no other page has
        box = lambda lines, tag="div": "".join(f"<{tag}>{x}</{tag}>" for x in lines)
        html = f"<html><body><div>{box(menu)}</div><div>{box(side[section])}</div><div>{box(extra)}</div><div>{box(own, 'p')}</div><div>{box(foot)}</div></body></html>"
        out.append((f"http://site{seed}.org/{section}/page-{k}", html, own, [*menu, *side[section], *extra, *foot]))
        last = own
    return out


def plain(rows):
    """The texts by page: the lines that two of the two pages before and after on the host have, in a common subsequence, go."""
    made = {i: op8_html.lines(html) for i, _, html in rows}
    key = lambda row: op8_html_key(row[1], row[0])
    order = sorted(rows, key=key)
    out = {}
    for k, (i, url, _) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1, k - 2, k + 2) if 0 <= j < len(order) and host(order[j][1]) == host(url)]
        own, votes, told = made[i], [0] * len(made[i]), 0
        for j, _, _ in near:
            gone = longest([x[:2] for x in own], [x[:2] for x in made[j]])
            if sum(len(own[g][0]) for g in gone) > 0.9 * sum(len(x[0]) for x in own):
                continue
            told += 1
            for g in gone:
                votes[g] += 1
        out[i] = "\n".join(x[0] for x, v in zip(own, votes, strict=True) if v < min(2, max(1, told)))
    return out


def host(url):
    return url.split("/")[2].lower()


def op8_html_key(url, page_id):
    import re

    return host(url), re.sub(r"\d+", lambda m: m[0].zfill(12), "/" + url.split("/", 3)[3]), page_id


def longest(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.fixture(scope="module")
def pages():
    return [(100 * s + k, *x) for s in range(6) for k, x in enumerate(site(s, 25))]


def test_whole_operator_against_a_plain_one(spark, pages):
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in op8_html.extract(df).collect()} == plain([p[:3] for p in pages])


def test_recall_and_precision_without_marks(spark, pages):
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: set(r.text.split("\n")) for r in op8_html.extract(df).collect()}
    own = sum(len(p[3]) for p in pages)
    kept = sum(x in got[p[0]] for p in pages for x in p[3])
    left = sum(x in got[p[0]] for p in pages for x in p[4])
    assert kept / own > 0.99 and kept / (kept + left) > 0.9
    assert left < 0.05 * sum(len(p[4]) for p in pages)


def test_names_count_as_whole_words():
    inside = '<p class="share-price">1</p><section id="social-contract">2</section><p class="ad-hoc">3</p><div class="comments-on-the-text">4</div>'
    gone = '<div class="share-buttons">a</div><div class="comments">b</div><section id="user-comments">c</section><div class="ad-slot-2">d</div>'
    text = lambda html: op8_html.main_text(op8_html.lines(html), [])
    assert text(f"<article>{inside}{gone}</article>") == "1\n2\n3\n4"
    assert text('<div class="alert-fatigue"><h1>Tired</h1><p>of alerts</p></div><div class="site-header">x</div>') == "Tired\nof alerts"


def test_odd_pages(spark):
    rows = [(None, "http://a.org/1", "<p>x</p>", 1), (2, None, "<p>y</p>", 2), (3, "", None, 3), (4, "http://a.org/2", "", 4), (5, "http://a.org/3", "<p>z</p>", 5), (5, "http://a.org/3", "<p>z</p>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").selectExpr("*", "1 AS host", "2 AS path", "3 AS part", "4 AS text", "5 AS place", "6 AS page")
    got = sorted(map(tuple, op8_html.extract(df).collect()), key=str)
    assert got == sorted([(None, "http://a.org/1", "x", 1), (2, None, "y", 1), (3, "", "", 0), (4, "http://a.org/2", "", 0), (5, "http://a.org/3", "z", 1), (5, "http://a.org/3", "z", 1)], key=str)
