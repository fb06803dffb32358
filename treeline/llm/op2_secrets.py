"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of letters, digits and ``_ + / . -``. The field tags each as Begin, Inside or Outside of a secret from its
shape (length, character classes, changes of class), the words before and after it, what stands between, and features
of the whole file (shares of digits and of symbols). It is fitted by maximum likelihood on windows of a bounded sample:
pattern matches in at most FIT_HITS + FIT_ROWS documents are the labels, and windows with invented secrets of other
forms, and others with invented harmless strings that look like them (UUIDs, ids in URLs, hashes, file names), widen what
is learnt. The sample is drawn from a stretch of a hash's range that holds some 2 * POOL documents.

Every text is decoded whole. A token whose lead of Outside exceeds all that transitions can win back is Outside in every
best tagging, so Viterbi runs on the stretches between such tokens and finds the best tagging of the whole text.

Spans are kind:start:end in code points, end exclusive. Pattern spans always stay; of a tagged span, the parts outside
of them are added with kind ``crf``, as far as they have a letter or digit.

Defined results for odd input: null text counts as empty, which has no spans; texts of any length are decoded whole; of
equally good taggings, the one with the lower tag last; repeated rows are scanned each; an empty table gives no rows and
fits nothing but invented windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import words
from treeline.llm.sampling import thinned

NAME = "op2_secrets"
FIT_ROWS = 1200
FIT_HITS = 600
FIT_CHARS = 20_000
POOL = 20_000
INVENTED = 2400
WINDOW = 25
EPOCHS = 60

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
HINT = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Code point ranges whose tokens are labelled as secrets: the values, without the names they are assigned to."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [m.span() for m in HEX.finditer(text)]


# Tokens and features

APART = np.array([i < 128 and not (chr(i).isalnum() or chr(i) in "_+/.-") for i in range(256)])
CLASS = np.full(256, 4, np.uint8)  # 0 digit, 1 upper case, 2 lower case, 3 symbol, 4 beyond ASCII
for _i in range(128):
    CLASS[_i] = 0 if chr(_i).isdigit() else 1 if chr(_i).isupper() else 2 if chr(_i).islower() else 3
IS_HEX = np.array([chr(i) in "0123456789abcdefABCDEF" for i in range(256)])
IS_DASH = np.array([chr(i) == "-" for i in range(256)])
DASHES = 6
BETWEEN = ["=", ":", "\"'`", "\n", "<>()[]{};,", "@&?%#$*"]
WORD_BITS = 14
SHARES = 6


def buckets(x: np.ndarray, edges: list) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


LENGTHS = [4, 6, 9, 12, 16, 20, 24, 32, 40, 64]
PARTS = [0.001, 0.15, 0.35, 0.7, 0.999]
CHANGES = [1, 2, 3, 5, 8, 12]
SIZES = (len(LENGTHS) + 1, len(PARTS) + 1, len(PARTS) + 1, len(PARTS) + 1, 3, len(CHANGES) + 1, 2)
#: Slots: single shape features, joint ones, dashes (with: nothing but hex besides), words before (two) and after, between, file.
BASES = np.cumsum([0, *SIZES, SIZES[0] * SIZES[5] * 2, SIZES[0] * SIZES[1] * SIZES[2], 2 * DASHES, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 1 << len(BETWEEN), 1 << len(BETWEEN), SIZES[0] * (1 << len(BETWEEN)), SHARES, SHARES, 1])
N_SLOTS = int(BASES[-1])


def tokens_of(texts: list[str | None]) -> Iterator[tuple[words.Block, np.ndarray]]:
    """Blocks of tokens, and token x feature: the slots of its features."""
    for b in words.blocks(texts, APART, words.LOWER):
        n = len(b.start)
        if not n:
            yield b, np.zeros((0, len(BASES) - 1), np.int32)
            continue
        kind = CLASS[b.raw]

        def count(flag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
            return total[stop] - total[start]

        size = (b.stop - b.start).astype(np.int32)
        part = [count(kind == k, b.start, b.stop) for k in range(5)]
        change = count(np.concatenate([kind[1:] != kind[:-1], [False]]), b.start, b.stop - 1)
        shape = [
            buckets(size, LENGTHS), buckets(part[0] / size, PARTS), buckets(part[1] / size, PARTS), buckets(part[2] / size, PARTS),
            np.where(part[4] > 0, 2, (part[3] > 0).astype(int)), buckets(change, CHANGES), (count(IS_HEX[b.raw], b.start, b.stop) == size).astype(int),
        ]
        shape += [(shape[0] * SIZES[5] + shape[5]) * 2 + shape[6], (shape[0] * SIZES[1] + shape[1]) * SIZES[2] + shape[2]]
        dashes = count(IS_DASH[b.raw], b.start, b.stop)
        shape.append(np.minimum(dashes, DASHES - 1) * 2 + (count(IS_HEX[b.raw], b.start, b.stop) + dashes == size))
        owner = b.owner()
        word = (b.value >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        alone = np.concatenate([[True], owner[1:] != owner[:-1]])  # the first token of its text
        before = np.where(alone, 0, np.concatenate([[0], word[:-1]]))
        second = np.where(alone | np.concatenate([[True], alone[:-1]]), 0, np.concatenate([[0, 0], word[:-2]])[:n])
        last = np.concatenate([alone[1:], [True]])
        after = np.where(last, 0, np.concatenate([word[1:], [0]]))
        gap_start = np.where(alone, b.text_at[owner], np.concatenate([[0], b.stop[:-1]]))
        gap_stop = np.where(last, b.text_at[owner + 1], np.concatenate([b.start[1:], [len(b.raw)]]))
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, chars in enumerate(BETWEEN):
            flag = np.isin(b.raw, np.frombuffer(chars.encode(), np.uint8))
            left |= (count(flag, gap_start, b.start) > 0).astype(np.int64) << k
            right |= (count(flag, b.stop, gap_stop) > 0).astype(np.int64) << k
        a, z = b.text_at[:-1], b.text_at[1:]
        length = np.maximum(z - a, 1)
        digits, symbols = count(kind == 0, a, z) / length, count((kind == 3) & (b.raw > 32), a, z) / length
        share = [0.002, 0.01, 0.03, 0.08, 0.2]
        values = [*shape, before, second, after, left, right, shape[0] * (1 << len(BETWEEN)) + left, buckets(digits, share)[owner], buckets(symbols, share)[owner], np.zeros(n, np.int64)]
        yield b, np.stack([v + base for v, base in zip(values, BASES, strict=False)], 1).astype(np.int32)


# The field

O, B, I = 0, 1, 2


@dataclass
class Model:
    weight: np.ndarray  # slot x tag
    move: np.ndarray  # tag x tag
    start: np.ndarray  # tag


def fit(slots: np.ndarray, tags: np.ndarray, sizes: np.ndarray, epochs: int = EPOCHS, ridge: float = 2e-3) -> Model:
    """Maximum likelihood with Adam. slots: window x place x feature, tags: window x place, sizes: places used of each window."""
    n, width, k = slots.shape
    used = np.arange(width)[None] < sizes[:, None]
    flat = [np.ascontiguousarray(slots[..., f][used]) for f in range(k)]
    theta = [np.zeros((N_SLOTS, 3)), np.zeros((3, 3)), np.zeros(3)]
    seen = np.zeros((n, width, 3))
    seen[np.arange(n)[:, None], np.arange(width)[None], tags] = 1
    seen *= used[..., None]
    pair = np.zeros((3, 3))
    both = used[:, 1:]
    np.add.at(pair, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, epochs + 1):
        weight, move, start = theta
        score = np.zeros((n, width, 3))
        for f in range(k):
            score += weight[slots[..., f]]
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = start + score[:, 0]
        for t in range(1, width):
            x = alpha[:, t - 1, :, None] + move[None]
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:, t]
            alpha[:, t] = np.where(used[:, t, None], new, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            x = move[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = x.max(2)
            beta[:, t] = np.where(used[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0)
        top = alpha[:, -1].max(1)
        norm = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        place = np.exp(alpha + beta - norm[:, None, None]) * used[..., None]
        gap = (place - seen) / n
        g = [np.zeros((N_SLOTS, 3)), -pair / n, (place[:, 0] - seen[:, 0]).mean(0)]
        for t in range(width - 1):
            x = alpha[:, t, :, None] + move[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :] - norm[:, None, None]
            g[1] += (np.exp(x) * used[:, t + 1, None, None]).sum(0) / n
        for y in range(3):
            own = gap[..., y][used]
            g[0][:, y] = sum(np.bincount(x, own, N_SLOTS) for x in flat)
        for i in range(3):
            g[i] += ridge / 100 * theta[i]
            first[i] = 0.9 * first[i] + 0.1 * g[i]
            second[i] = 0.99 * second[i] + 0.01 * g[i] ** 2
            theta[i] = theta[i] - 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Model(*theta)


def viterbi(score: np.ndarray, move: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
    """The best tags, ties to the lower tag. before: what each first tag gets, after: what each last tag gets."""
    best, back = before + score[0], []
    for s in score[1:]:
        x = best[:, None] + move
        back.append(x.argmax(0))
        best = x.max(0) + s
    tags = [int((best + after).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def tagged(model: Model, b: words.Block, slots: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By text of the block: (first byte, byte after the last) of each tagged span, counted from the text's start."""
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(slots):
        return out
    score = np.zeros((len(slots), 3), np.float64)
    for f in range(slots.shape[1]):
        score += model.weight[slots[:, f]]
    move, start = model.move, model.start
    entry = np.concatenate([move, start[None]])  # from each tag, or from the start of the text
    gain = [max(0.0, (entry[:, y] - entry[:, O]).max() + max(0.0, (move[y] - move[O]).max())) for y in (B, I)]
    live = np.flatnonzero((score[:, B] + gain[0] >= score[:, O]) | (score[:, I] + gain[1] >= score[:, O]))
    if not len(live):
        return out
    owner = np.searchsorted(b.word_at, live, side="right") - 1
    cut = np.flatnonzero((np.diff(live) != 1) | (np.diff(owner) != 0)) + 1
    for run in np.split(np.arange(len(live)), cut):
        i, j, text = live[run[0]], live[run[-1]] + 1, owner[run[0]]
        whole = j == b.word_at[text + 1]
        tags = viterbi(score[i:j], move, start if i == b.word_at[text] else move[O], np.zeros(3) if whole else move[:, O])
        base, open_at = b.text_at[text], None
        for k, tag in enumerate([*tags, O]):
            if open_at is not None and tag != I:
                out.setdefault(int(text), []).append((int(b.start[i + open_at] - base), int(b.stop[i + k - 1] - base)))
                open_at = None
            if tag == B or tag == I and open_at is None:
                open_at = k
    return out


# What is learnt from

NAMES = ["auth_key", "access_key", "client_secret", "private_key", "pwd", "credential", "authorization", "bearer", "AUTH_TOKEN", "db_pass", "signing_key", "webhook_key", "session_key", "key", "passphrase", "pass", "pw", "login_pw"]
IDS = ["id", "user_id", "request_id", "trace", "session", "order", "commit", "rev", "ref", "build", "etag", "uuid", "sku", "path", "file"]
GLUE = ["=", ": ", " = \"", ":\"", " => '", " ", "=\"", ":"]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FULL = UPPER + LOWER + DIGITS


def picked(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choice(chars) for _ in range(n))


def invented(r: random.Random) -> str:
    """A secret of a form that the patterns need not know."""
    pick = lambda chars, n: picked(r, chars, n)
    return r.choice([
        lambda: pick("0123456789ABCDEF", r.choice([24, 32, 40, 64])), lambda: pick(FULL, r.randint(20, 44)), lambda: pick(FULL + "+/", r.randint(28, 60)), lambda: pick(FULL + "_-", r.randint(22, 43)),
        lambda: f"ghp_{pick(FULL, 36)}", lambda: f"sk_live_{pick(FULL, 24)}", lambda: f"xoxb-{pick(DIGITS, 11)}-{pick(FULL, 24)}", lambda: f"eyJ{pick(FULL, 20)}.eyJ{pick(FULL, 40)}.{pick(FULL + '_-', 43)}",
        lambda: f"AIza{pick(FULL + '_-', 35)}", lambda: pick("0123456789abcdef", r.choice([32, 40, 64])), lambda: f"{pick(LOWER, r.randint(2, 6))}{r.choice('_-')}{pick(FULL, r.randint(18, 40))}",
    ])()


def short_one(r: random.Random) -> str:
    """A password, which only what stands before it gives away."""
    while True:
        x = picked(r, r.choice([FULL, LOWER + DIGITS, FULL + "_-."]), r.randint(8, 16))
        if any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
            return x


def uuid_of(r: random.Random) -> str:
    return "-".join(picked(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12))


def lookalike(r: random.Random) -> str:
    """No secret, though it may look like one: an id, a hash, a name."""
    pick = lambda chars, n: picked(r, chars, n)
    tld = r.choice(["com", "org", "net"])
    return r.choice([
        lambda: uuid_of(r), lambda: uuid_of(r).upper(), lambda: f"https://{pick(LOWER, 8)}.{tld}/{pick(LOWER, 5)}/{uuid_of(r)}", lambda: f"https://{pick(LOWER, 6)}.{tld}/watch?v={pick(FULL + '_-', 11)}", lambda: f"https://{pick(LOWER, r.randint(3, 7))}.{pick(LOWER, 2)}/{pick(FULL + '_-', r.randint(6, 12))}",
        lambda: f"https://{pick(LOWER, 7)}.{tld}/{pick(LOWER, 6)}/commit/{pick('0123456789abcdef', r.choice([7, 10, 12, 20]))}", lambda: pick("0123456789abcdef", r.randint(7, 12)), lambda: f"IMG_20{pick(DIGITS, 6)}_{pick(DIGITS, 6)}.jpg",
        lambda: f"#{pick('0123456789abcdef', 6)}", lambda: f"{':'.join(pick(LOWER, r.randint(2, 6)) for _ in range(r.randint(2, 4)))}:{r.choice(['', '::'])}{pick(LOWER, 5)}-{pick(LOWER, 4)}-{pick(DIGITS, 4)}", lambda: ":".join(pick("0123456789abcdef", 2) for _ in range(6)), lambda: f"{pick(UPPER, 4)}-{pick(DIGITS, 4)}", lambda: f"10.{pick(DIGITS, 4)}/{pick(LOWER, 5)}.{pick(DIGITS, 6)}",
        lambda: f"{pick(LOWER, 6)}-{pick(DIGITS, 2)}.{pick(DIGITS, 1)}.{pick(DIGITS, 1)}-{pick(LOWER, 4)}", lambda: f"https://{pick(LOWER, 9)}.{tld}/{'-'.join(pick(LOWER, r.randint(3, 8)) for _ in range(5))}-{pick(DIGITS, 6)}", lambda: f"urn:uuid:{uuid_of(r)}",
        lambda: f"{pick(UPPER, 2)}{pick(DIGITS, 2)} {pick(DIGITS, 4)} {pick(DIGITS, 4)} {pick(DIGITS, 4)}", lambda: f"/{pick(LOWER, 4)}/{pick(LOWER, 6)}_{pick(DIGITS, 4)}/{pick('0123456789abcdef', 16)}.{pick(LOWER, 3)}",
    ])()


def harmless(r: random.Random) -> str:
    digits, name = lambda n: picked(r, DIGITS, n), lambda n: picked(r, LOWER, n)
    return r.choice([
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: digits(r.randint(5, 18)), lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{name(5)}.{digits(2)}@{name(7)}.{name(3)}", lambda: ".".join(digits(r.randint(1, 3)) for _ in range(4)), lambda: f"https://{name(8)}.com/{name(6)}/{digits(5)}", lambda: name(r.randint(14, 34)), lambda: name(12).upper(),
        lambda: "-".join(name(6) for _ in range(4)), lambda: name(4).title() + name(6).title() + name(5).title(), lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: "_".join(name(5) for _ in range(4)), lambda: f"ISBN {digits(3)}-{digits(10)}", lambda: name(6).upper() + "!!",
        lambda: f"{r.choice(NAMES)}{r.choice(GLUE)}{name(r.randint(3, 9))}", lambda: f"/{name(4)}/{name(6)}/{name(8)}.{name(3)}",
    ])()


def examples(texts: list[str]) -> list[tuple[str, list[tuple[int, int]], list[int]]]:
    """(text, secret ranges, places to look at) to learn from, in code points."""
    r, out = random.Random(11), []
    for text in texts:
        parts = secret_parts(text)
        places = [a for a, _ in parts] + [r.randrange(len(text) + 1) for _ in range(2)] + [m.start() for m in re.finditer(r"[^\s]*[0-9@][^\s]*", text)][:4]
        out.append((text, parts, places))
    stems = [t for t in texts if t.count(" ") > 40] or ["the words of a line that says nothing at all " * 4]
    for k in range(INVENTED):
        t = r.choice(stems)
        at = t.find(" ", r.randrange(len(t)))
        at = at if at >= 0 else t.index(" ")
        left, right = t[max(0, at - 160) : at + 1], t[at : at + 160]
        if k % 2:
            lead = f"{r.choice(NAMES)}{r.choice(GLUE)}" if r.random() < 0.75 else ""
            value = short_one(r) if lead and r.random() < 0.35 else invented(r)
            quote = '"' if '"' in lead else "'" if "'" in lead else ""
            out.append((left + lead + value + quote + right, [(len(left + lead), len(left + lead + value))], [len(left)]))
        else:
            value = harmless(r) if r.random() < 0.4 else lookalike(r)
            lead = f"{r.choice([r.choice(IDS), picked(r, LOWER, r.randint(2, 7))])}{r.choice(GLUE)}" if r.random() < 0.5 else ""
            quote = '"' if '"' in lead else "'" if "'" in lead else ""
            out.append((left + lead + value + quote + right, [], [len(left)]))
    return out


def windows(rows: list[tuple[str, list[tuple[int, int]], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slots, tags and sizes for ``fit``."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for b, slots in tokens_of([x[0] for x in rows]):
        for k in range(b.count):
            text, parts, places = rows[b.first + k]
            i, j = b.word_at[k], b.word_at[k + 1]
            to_byte = lambda p: len(text[:p].encode("utf-8"))  # noqa: B023, E731
            start, stop = b.start[i:j] - b.text_at[k], b.stop[i:j] - b.text_at[k]
            tags = np.zeros(j - i, np.int64)
            for a, z in parts:
                inside = np.flatnonzero((start < to_byte(z)) & (stop > to_byte(a)))
                tags[inside] = I
                tags[inside[:1]] = B
            for p in sorted({int(np.searchsorted(start, to_byte(p))) for p in places}):
                a = max(0, min(p - WINDOW // 2, j - i - WINDOW))
                if j > i:
                    out.append((slots[i + a : min(i + a + WINDOW, j)], tags[a : a + WINDOW]))
    x, y = np.zeros((len(out), WINDOW, len(BASES) - 1), np.int32), np.zeros((len(out), WINDOW), np.int64)
    for k, (s, t) in enumerate(out):
        x[k, : len(s)], y[k, : len(t)] = s, t
    return x, y, np.array([len(t) for _, t in out])


def train(docs: DataFrame) -> Model:
    """docs(doc_id, text): fits on a sample that is bounded in rows and in bytes, chosen by hashes of the id and the text."""
    rows = docs.select("doc_id", "text")
    pool = rows.where(thinned(POOL, rows.count(), "doc_id") & (F.length("text") <= FIT_CHARS))  # before the pattern, so that few texts are searched
    hit = F.col("text").rlike(HINT)
    n, n_hits = pool.agg(F.count("*"), F.count_if(hit)).first()
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.md5("text")
    texts = []
    for most, of, which in ((FIT_HITS, n_hits, hit), (FIT_ROWS, n - n_hits, ~hit)):
        texts += [r[0] for r in pool.where(thinned(most, of, "text", F.lit(7)) & which).orderBy(*order).limit(most).select("text").collect()]
    return fit(*windows(examples(texts)))


# The scan


def spans_of(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans of each text, by start, then kind. Work is in proportion to the text."""
    out = [base_spans(t or "") for t in texts]
    for b, slots in tokens_of(texts):
        for k, found in tagged(model, b, slots).items():
            text, own = texts[b.first + k] or "", out[b.first + k]
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points that begin before each byte
            more = uncovered([(int(point[a]), int(point[z])) for a, z in found], [(a, z) for a, _, z in own])
            out[b.first + k] = sorted(own + [(a, 3, z) for a, z in more if any(c.isalnum() for c in text[a:z])])
    return out


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a range that no span covers. spans: (start, kind, end), by start."""
    return uncovered([(start, end)], [(a, z) for a, _, z in spans])


def uncovered(ranges: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ranges that no span covers, in one pass over both. Both by start; ranges don't overlap."""
    parts, k, covered = [], 0, 0  # covered: how far the spans that were passed reach
    for start, end in ranges:
        start = max(start, min(covered, end))
        while k < len(spans) and spans[k][0] < end:
            a, z = spans[k]
            if a > start:
                parts.append((start, a))
            start, covered, k = max(start, min(z, end)), max(covered, z), k + 1
        if start < end:
            parts.append((start, end))
    return parts


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each span, or run of spans that overlap, replaced by the mark."""
    out, at = [], 0
    for a, _, z in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])


AT_ONCE = 1 << 20  # bytes of text


def pieces(parts: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of parts, in their order, in batches of about ``most`` bytes of text, or of one longer text.

    Python objects of texts and spans take many times the bytes of a batch, so they exist for one such piece at a time.
    """
    for part in parts:
        size = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).to_numpy()
        number = (np.cumsum(size, dtype=np.int64) + np.arange(len(size)) * 64) // most
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(size)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield part.slice(a, z - a)


def scanner(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in pieces(parts):
            found = spans_of(part.column("text").to_pylist(), model)
            counts = [np.array([sum(k == kind for _, k, _ in s) for s in found], np.int64) for kind in range(4)]
            digest = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts[:3]), pa.array(digest, pa.string()), pa.array([joined(s) for s in found], pa.string()), pa.array(counts[3])], schema=FIELDS)

    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scanner(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every found secret in ``text`` replaced by a mark; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            texts = part.column("text").to_pylist()
            clean = [t and redact(t, s) for t, s in zip(texts, spans_of(texts, shared.value), strict=True)]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in word)


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``query`` that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_NAME = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + f"|{either_case('api')}_?{either_case('key')}"
COUNTS_SQL = rf"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(t, '({_NAME})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
