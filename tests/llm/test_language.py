"""Language identification over scripts that the given tables don't have."""

import random

import numpy as np
import pytest

import corpus_pipeline
from treeline.llm import op3_language

SCRIPTS = {"zh": "我们在学校里学习语文数学他她是的不了人有大这上国来到时候天气很好", "ja": "わたしはがっこうでべんきょうをしますとてもたのしいです学校日本語", "ko": "우리는학교에서공부를합니다매우즐겁고오늘날씨가좋습니다"}


def han(r, letters, n):
    """Text without spaces, made of pairs that the language has; a comma or full stop here and there."""
    pairs = [letters[k : k + 2] for k in range(0, len(letters) - 1)]
    return "".join(r.choice(pairs) + (r.choice("，。") if r.random() < 0.1 else "") for _ in range(n))


@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_scripts_past_the_general_ones_are_told_apart(monkeypatch, dense):
    monkeypatch.setattr(op3_language, "DENSE", dense, raising=False)
    r = random.Random(8)
    rows = [(k, lang, han(r, SCRIPTS[lang], r.randint(10, 60))) for k in range(200) for lang in SCRIPTS]
    model = op3_language.fit(rows)
    new = [(lang, han(r, SCRIPTS[lang], r.randint(10, 60))) for _ in range(40) for lang in SCRIPTS]
    langs, _ = op3_language.predicted(model, [t for _, t in new])
    assert langs == [lang for lang, _ in new]


def test_slots_and_search_give_the_same_columns(monkeypatch):
    r = random.Random(1)
    rows = [(k, lang, han(r, SCRIPTS[lang], 30)) for k in range(20) for lang in SCRIPTS]
    texts = ["我们 abc", "", "か", *[t for _, _, t in rows[:9]]]
    got = []
    for dense in (1 << 30, 0):
        monkeypatch.setattr(op3_language, "DENSE", dense, raising=False)
        got.append(op3_language.fit(rows).presence(texts))
    assert (got[0] == got[1]).all()


PARTS = {"aa": "ar en il os un tra mi", "bb": "che ost ung ber ver ich", "cc": "éa oui ment que eau ré", "dd": "ski prz owa czy dzi nie"}


def prose(r, lang, n):
    parts = PARTS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."


def test_foreign_texts_and_junk_are_rejected_and_clean_texts_are_not(spark):
    r = random.Random(6)
    learnt = ["aa", "bb", "cc"]
    rows = [(k, prose(r, learnt[k % 3], r.randint(10, 80)), learnt[k % 3]) for k in range(600)]
    clean = {1000 + k: f"{prose(r, learnt[k % 3], r.randint(3, 80))} 4711 %%% !!" for k in range(90)}
    foreign = {2000 + k: prose(r, "dd", r.randint(5, 80)) for k in range(30)}
    junk = {3000: "xqzvk jwpqx zzkqj vvxqw kqzjx", 3001: "for (int i = 0; i < n; i++) { buf[i] = malloc(sizeof(node)); }", 3002: "人人生而自由，在尊严和权利上一律平等。", 3003: "Все люди рождаются свободными", 3004: "!!! 123", 3005: None}
    docs = spark.createDataFrame(rows + [(k, t, None) for k, t in (clean | foreign | junk).items()], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert set(clean) <= kept and len(kept & {k for k, *_ in rows}) == len(rows)
    assert not kept & set(foreign) and not kept & set(junk)


def test_the_model_is_bounded_over_long_texts_of_many_letters():
    """Texts of 20,000 Han characters drawn by a Zipf law, which have millions of n-grams."""
    rng = np.random.default_rng(2)
    draw = lambda n: "".join(map(chr, 0x4E00 + np.minimum(rng.zipf(1.2, n), 15_000)))
    rows = [(k, "zh", draw(20_000)) for k in range(90)] + [(100 + k, "en", " ".join(f"word{x}" for x in rng.integers(0, 999, 3000))) for k in range(90)]
    model = op3_language.fit(rows)
    assert model.landmarks.shape == (op3_language.COLUMNS, op3_language.LANDMARKS) and op3_language.megabytes(model) < op3_language.MOST_MB
    assert op3_language.predicted(model, [draw(300), "some words in english", draw(20)])[0] == ["zh", "en", "zh"]


def test_a_model_over_the_limit_is_not_broadcast(spark, monkeypatch):
    model = op3_language.fit([(1, "en", "some words"), (2, "de", "ein paar worte")])
    monkeypatch.setattr(op3_language, "MOST_MB", 1)
    with pytest.raises(ValueError, match="may be broadcast"):
        op3_language.identify(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model)
