"""Page differencing: what the alignment decides, what the markup decides, and large pages."""

import random
import time

from treeline.llm import op8_html


def text_of(html, others=()):
    return op8_html.main_text(op8_html.lines(html), [op8_html.lines(x) for x in others])


def test_unmarked_pages_lose_what_their_neighbours_share(spark):
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("aeinrst") for _ in range(r.randint(2, 8))) for _ in range(n))
    top, side, foot = say(6), [say(3) for _ in range(5)], say(8)
    own = {k: [say(12) for _ in range(4)] for k in range(40)}
    quoted = own[7][1]
    own[8][2] = quoted  # one neighbour quotes the other
    page = lambda k: f"<html><body><div><p>{top}</p></div><div>{''.join(f'<div>{x}</div>' for x in side)}</div><div>{''.join(f'<p>{x}</p>' for x in own[k])}</div><div>{foot}</div></body></html>"
    rows = [(k, f"http://h{k // 20}.org/a/{k}", page(k)) for k in range(40)] + [(99, "http://alone.org/", page(0))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 3, 30):
        got = {x.page_id: x.text for x in op8_html.extract(docs.repartition(parts)).collect()}
        assert {k: got[k] for k in own} == {k: "\n".join(own[k]) for k in own}
        assert got[99] == "\n".join([top, *side, *own[0], foot])  # without a neighbour, nothing says so


def test_edges_of_partitions_have_the_same_neighbours(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", f"<p>page {k}</p><p>s{k // 6}</p><p>all</p>") for k in range(90)], "page_id long, url string, html string")
    got = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got[n] = {(x.page_id, x.text) for x in op8_html.extract(pages).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got["1"]) == 90 and got["1"] == got["7"] == got["64"]


def test_a_copy_says_nothing():
    page = "<p>one line</p><p>two lines</p>"
    assert text_of(page, [page]) == "one line\ntwo lines"
    assert text_of(page + "<p>foot</p>", [page, "<p>x y z</p><p>foot</p>", "<p>z</p><p>foot</p>"]) == "one line\ntwo lines"


def test_heads_wrappers_and_articles():
    assert text_of("<html><head><title>T</title><body><article><p>Hello there</p>") == "Hello there"
    assert text_of("<head><title>T</title>Hello <b>there</b>") == "Hello there"
    assert text_of('<div class="login-page"><div id="content-with-sidebar"><form><article>in</article></form></div></div>') == "in"
    assert text_of('<div class="comments"><article><p>first!</p></article></div>') == ""
    assert text_of('<article><p>a</p><math><mi>x</mi></math><aside>note</aside><div class="alert">mind</div><ul class="related"><li>see</ul><nav>menu</nav><div class="ad">buy</div></article>') == "a\nx\nnote\nmind\nsee"
    assert text_of('<div><aside>side</aside><p>a</p><div class="cookie-notice">ok?</div></div>') == "a"


def test_pages_of_many_lines():
    r = random.Random(1)
    a = [f"line {r.randrange(6000)}" for _ in range(10_000)]
    b = a[5000:] + a[:5000]
    began = time.perf_counter()
    kept = op8_html.shared(a, b)
    assert len(kept) >= 5000 and time.perf_counter() - began < 20
    at = iter(b)
    assert all(a[i] in at for i in sorted(kept))
