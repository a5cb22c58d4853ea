from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest

from gapline.llm import langid, toxicity
from gapline.llm.langid import Profiles, learn_profiles, ngrams, predict_language
from gapline.llm.toxicity import Lexicon, Scorer, fold, learn_lexicon, poisson_tail, score_toxicity

LANGS = {"aa": "la lo le li ma no", "bb": "sch ung ein und ich", "cc": "что это как дом кот"}


def texts(rng, lang, n):
    words = LANGS[lang].split()
    return ["".join(rng.choice(words) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(15, 60))) for _ in range(n)]


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in LANGS for t in texts(rng, lang, 60))]
    rows += [(900, None, "aa"), (901, "12 34", None), (902, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn_profiles(df.filter("doc_id % 3 <> 0"))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in predict_language(df, profiles).collect()}
    assert all(got[k][0] == lang for k, t, lang in rows if k < 900)
    assert all(got[k] == ("und", 0.0) for k in (900, 901, 902))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_out_of_place_distance():
    judge = Profiles({"x": ngrams("ab")[0].tolist(), "y": []}, top=5)
    assert judge.judge("zz") == ("x", 0.0)
    own = langid.ranked(*ngrams("aab"), 5)
    assert Profiles({"x": own.tolist()}, top=5).judge("aab") == ("x", 1.0)


def plain_ngrams(text):
    points = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    found = Counter()
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            gram = points[k : k + n]
            if (gram != " ", gram.strip() != "", gram[1:2] not in ("", " "))[n - 1]:
                found[sum(ord(c) << 21 * (n - 1 - j) for j, c in enumerate(gram))] += 1
    return found


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_ngrams_in_blocks(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    for text in ["", "a", "ab", " ", "1", "Straße 12 Ähm", "ΑΣ ς İ", *("".join(rng.choice("ab é1 漢") for _ in range(rng.randint(0, 40))) for _ in range(150))]:
        codes, counts = ngrams(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == dict(plain_ngrams(text))


def out_of_place(text, profiles, top):
    """The rank-order method by dictionaries."""
    own = [c for c, _ in sorted(plain_ngrams(text or "").items(), key=lambda x: (-x[1], x[0]))[:top]]
    if not own or not any(profiles.values()):
        return "und", 0.0
    costs = {}
    for lang, codes in profiles.items():
        place = {c: k for k, c in enumerate(codes)}
        if codes:
            costs[lang] = sum(abs(place[c] - k) if c in place else top for k, c in enumerate(own))
    best = min(costs, key=lambda x: (costs[x], x))
    return best, 1 - costs[best] / (top * len(own))


def test_languages_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in LANGS for t in texts(rng, lang, 12))]
    rows += [(100, None, None), (101, "", None), (102, "7 8", "aa"), (103, "xx yy", None), (104, rows[0][1], "aa"), (104, rows[0][1], "aa")]
    rows += [(105, "la lo ich und " * 50_000, None), (106, "zz", "dd"), (107, "zz", "ee")]  # a long text, and a tie
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS LANG_PRED", "2 AS x")
    profiles = learn_profiles(df, top=50)
    counts = {}
    for _, text, lang in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    assert profiles == {lang: [c for c, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:50]] for lang, n in counts.items() if n}
    found = predict_language(df, profiles, top=50)
    assert found.columns == ["doc_id", "text", "lang", "x", "lang_pred", "lang_score"]
    got = sorted((r.doc_id, r.lang_pred, round(r.lang_score, 9)) for r in found.collect())
    assert got == sorted((i, lang, round(score, 9)) for i, t, _ in rows for lang, score in [out_of_place(t, profiles, 50)])
    assert [lang for i, lang, _ in got if i in (106, 107)] == ["dd", "dd"]


def test_language_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert learn_profiles(empty) == {}
    df = spark.createDataFrame([(1, "word", "w", 2.0)], "doc_id long, text string, lang_pred string, x double")
    assert predict_language(df, {}).first().lang_pred == "und"
    assert predict_language(empty, {}).count() == 0


def test_folding():
    assert fold(None) == fold("") == "  "
    assert fold("1d10t, ІDЇОТ; ídi​ot straße") == " idiot idiot idiot strasse "
    assert fold("in 2013, 4 of 1o1 a$$ $0 10_4") == " in 9 9 of ioi ass so 9 9 "


def test_exceptions_cancel_and_length_matters():
    scorer = Scorer(Lexicon({"trash ": 5.0, "vol": 4.0}, ("trash can",), 1.0))
    assert scorer.evidence("the trash can") == 0.0
    assert scorer.evidence("TR4SH the trash can") > 0
    assert scorer.evidence("volume") > scorer.evidence("volume " + "x " * 500) > 0
    assert scorer.evidence("revol") == 0.0
    assert 0 <= scorer.score("vol " * 10_000) <= 1


def plain_score(text, lexicon):
    """The score by looking every word and every phrase up."""
    line = fold(text)
    words = line.split()
    starts = [1 + sum(len(w) + 1 for w in words[:k]) for k in range(len(words))]
    quiet = []
    for phrase in lexicon.exceptions:
        at = line.find(fold(phrase))
        while at >= 0:
            quiet.append((at, at + len(fold(phrase)) - 1))
            at = line.find(fold(phrase), at + 1)
    total = 0.0
    for term, weight in lexicon.weights.items():
        n = 0
        for w, s in zip(words, starts, strict=True):
            if (w + " ").startswith(term):
                a, b = s - 1, s - 1 + len(term)
                n += not any(x <= a and b <= y for x, y in quiet)
        total += weight * min(n, toxicity.REPEATS)
    return 1 - math.exp(-lexicon.rate * total / (1 + math.log1p(len(words) / toxicity.LENGTH)))


def test_scores_against_brute_force(spark):
    rng = random.Random(9)
    lexicon = Lexicon({"trash ": 3.5, "grob": 4.0, "grobian ": 5.0, "scum ": 3.0, "clow": 3.2}, ("trash can", "pond scum", "grob it", "can grobian"), 0.11)
    words = "trash TR4SH can pond scum grobian grobheit grob it clown сlown 2013 fine ünd a$$ 1t".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, "trash"), (502, "trash")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS Toxicity", "6 AS label", "7 AS least")
    found = score_toxicity(df, lexicon)
    assert found.columns == ["doc_id", "text", "label", "least", "toxicity"]
    got = sorted((r.doc_id, round(r.toxicity, 9)) for r in found.collect())
    assert got == sorted((i, round(plain_score(t, lexicon), 9)) for i, t in rows)


def test_a_long_text_of_exceptions_takes_linear_time():
    scorer = Scorer(Lexicon({"trash ": 5.0}, ("trash can",), 1.0))
    begin = time.perf_counter()
    assert scorer.evidence("trash can " * 200_000) == 0.0
    assert scorer.evidence("trash can " * 200_000 + "trash") > 0
    assert time.perf_counter() - begin < 10


def test_learned_lexicon(spark):
    rng = random.Random(2)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, marks = [], []
    for k in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = k % 6 == 0
        if bad:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randrange(len(words)), rng.choice(["Nasty", "n4sty", "grobian", "grobheit", "grobling"]))
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    rows += [(1000, None), (1001, "")] + [(2000 + k, rows[0][1] + " copied") for k in range(60)]
    marks += [(1000, 0), (2000, 1), (None, 1), (5, None)] + [(2000 + k, 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    lexicon = learn_lexicon(docs, labels.filter("doc_id % 3 <> 1"))
    assert {"nasty ", "grob"} <= set(lexicon.weights)
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs, lexicon).collect()}
    held = [(k, m) for k, m in marks[:900] if k % 3 == 1]
    assert sum((got[k] >= toxicity.THRESHOLD) == bool(m) for k, m in held) >= 0.99 * len(held)
    assert got[1000] == got[1001] == 0.0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = learn_lexicon(docs, labels)
    assert score_toxicity(docs, lexicon).first().toxicity == 0.0
    assert score_toxicity(docs.limit(0), lexicon).count() == 0


def test_poisson_tail():
    assert abs(poisson_tail(3, 1.0) - 0.0803013970713942) < 1e-12
    assert poisson_tail(0, 1.0) == 1.0
