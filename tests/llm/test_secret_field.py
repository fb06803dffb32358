"""The field on forms of secrets and of harmless strings that its training never uses, and whole scans against brute force."""

import hashlib
import random
import re
import string

import pytest

from treeline.llm import op2_secrets

WORD, HEX = string.ascii_letters + string.digits, "0123456789abcdef"


def some(r, chars, n):
    return "".join(r.choice(chars) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(41)
    return [" ".join(some(r, "abcdeghinorst", r.randint(2, 9)) for _ in range(90)) for _ in range(150)]


@pytest.fixture(scope="module")
def model(texts):
    r = random.Random(5)
    return op2_secrets.fit(*op2_secrets.windows(op2_secrets.examples([t if k % 3 else f'{t[:200]} token = "{some(r, HEX, 40)}" {t[200:]}' for k, t in enumerate(texts[:100])])))


SECRET = {"glpat": lambda r: "glpat-" + some(r, WORD + "_-", 20), "hf": lambda r: "hf_" + some(r, WORD, 34), "mail": lambda r: f"SG.{some(r, WORD, 22)}.{some(r, WORD, 43)}", "pwd": lambda r: "pwd: " + some(r, WORD, 11) + "7", "bearer": lambda r: "Bearer " + some(r, WORD, 32)}
HARMLESS = {"uuid": lambda r: "-".join(some(r, HEX, n) for n in (8, 4, 4, 4, 12)), "slug": lambda r: f"https://site.io/posts/{'-'.join(some(r, 'aeiortn', 5) for _ in range(6))}", "commit": lambda r: some(r, HEX, 7), "name": lambda r: f"get{some(r, 'aeiou', 5).title()}Id2", "image": lambda r: f"registry.io/{some(r, 'abcde', 6)}/app:1.{some(r, '0123456789', 2)}", "isbn": lambda r: f"978-{some(r, '0123456789', 9)}-1"}


@pytest.mark.parametrize("kind", [*SECRET, *HARMLESS])
def test_unseen_forms(model, texts, kind):
    r = random.Random(kind)
    make = SECRET.get(kind) or HARMLESS[kind]
    rows = [f"{t[:150]} {make(r)} {t[150:]}" for t in texts]
    found = sum(any(k == 3 for _, k, _ in s) for s in op2_secrets.spans_of(rows, model))
    assert found >= 0.85 * len(rows) if kind in SECRET else found <= 0.05 * len(rows)


def test_parts_outside_of_base_spans_are_kept():
    own = [(5, 0, 10), (12, 2, 20), (14, 1, 16)]
    for a in range(25):
        for z in range(a + 1, 25):
            want = sorted(set(range(a, z)) - {p for s, _, e in own for p in range(s, e)})
            assert [p for s, e in op2_secrets.outside(a, z, own) for p in range(s, e)] == want


def brute(text):
    found = []
    for k, (pattern, flags, least, group) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2), (r"AKIA[A-Z0-9]+", 0, 20, 0), (r"[0-9a-f]+", 0, 24, 0)]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found)


def test_whole_scans_against_brute_force(spark, model, texts):
    r = random.Random(17)
    bits = ["Password=", "api_key: '", "TOKEN", "=", " : ", '"', "AKIA", "abcdef", "deadbeef" * 3, "0123456789ABCDEF", "é", "\U0001f600", "\n", "secret=", "..", "=="]
    rows = [(k, "".join(r.choice(bits) if r.random() < 0.6 else t[i : i + 12] for i in range(0, 240, 12))) for k, t in enumerate(texts)] + [(900, None), (901, "")]
    got = {x.doc_id: x for x in op2_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    names = ("assign", "access", "hex")
    for d, text in rows:
        want = brute(text or "")
        shown = [f"{names[k]}:{a}:{z}" for a, k, z in want]
        x = got[d]
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert x.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [s for s in x.spans.split(",") if s and not s.startswith("crf")] == shown
        covered = {p for a, _, z in want for p in range(a, z)}
        assert not any(covered & set(range(*map(int, s.split(":")[1:]))) for s in x.spans.split(",") if s.startswith("crf"))


def test_long_texts_take_time_in_proportion():
    """8 MB of hashes, tokens and words, and their spans against those of the text cut in pieces."""
    import random
    import time

    rng = random.Random(4)
    draw = lambda n, of="0123456789abcdef": "".join(rng.choices(of, k=n))
    kinds = [lambda: draw(32), lambda: "token=" + draw(12), lambda: "é glpat-" + draw(20, "abcXYZ0189"), lambda: "some plain words here", lambda: "AKIA" + draw(16, "ABC012")]
    lines = [rng.choice(kinds)() for _ in range(20_000)]
    model = op2_secrets.fit(*op2_secrets.windows(op2_secrets.examples([])[:200]), epochs=10)
    spread = [0]
    while spread[-1] < 8_000_000:
        spread.append(spread[-1] + sum(len(x) + 1 for x in lines))
    text = "\n".join(lines * (len(spread) - 1))
    began = time.process_time()
    got = op2_secrets.spans_of([text], model)[0]
    assert time.process_time() - began < 20
    assert len(got) > 100_000 and got == sorted(got)
    first = op2_secrets.spans_of(["\n".join(lines)], model)[0]
    assert [x for x in got if x[2] < spread[1] - 200] == [x for x in first if x[2] < spread[1] - 200]
