import math
import random

import numpy as np

from inkmesh.llm import language


def plain_log(word, pieces, p, lang):
    """log of the sum over all segmentations, in logarithms, letter by letter."""
    number = {x: i for i, x in enumerate(pieces)}
    a = [0.0]
    for j in range(1, len(word) + 1):
        terms = []
        for i in range(j):
            w = word[i:j]
            if w in number:
                terms.append(a[i] + math.log(p[number[w], lang]))
            elif j - i == 1:
                terms.append(a[i] + math.log(p[len(pieces), lang]))
        top = max(terms)
        a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return a[-1]


def model(seed=2):
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "bbbbbbbbbb", "abababababab"]
    p = np.random.default_rng(seed).random((len(pieces) + 2, 2)) / 100
    p[-1] = 0
    return language.PieceModel(["x", "y"], pieces, p)


def test_words_of_any_length_are_summed_whole():
    m, rng = model(), random.Random(1)
    words = ["▁" + "".join(rng.choice("abc") for _ in range(n)) for n in (1, 5, 23, 24, 25, 60, 300)] + ["▁" + "b" * 500]
    want = [[plain_log(w, m.pieces, m.p, k) for k in (0, 1)] for w in words]
    assert np.allclose(m.word_scores(words), want)
    assert np.isfinite(m.long_score("▁" + "ab" * 60_000)).all()


def test_prediction_is_the_likeliest_language_of_the_whole_text():
    m, rng = model(), random.Random(2)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6)))
        z = [sum(plain_log("▁" + w, m.pieces, m.p, k) for w in text.split()) for k in (0, 1)]
        (lang,), (score,) = m.predict([text])
        assert lang == "xy"[int(z[1] > z[0])] and math.isclose(score, 1 / (1 + math.exp(-abs(z[1] - z[0]))), rel_tol=1e-9)


def test_marks_belong_to_words_and_numbers_do_not():
    assert language.words_of("สวัสดี नमस्ते Ä²½ ab1c") == ["▁สวัสดี", "▁नमस्ते", "▁ä", "▁ab", "▁c"]
    assert language.words_of("² ½ 12 ́ _") == [] and model().predict(["² ½ 3"]) == (["und"], [0.0])


def test_all_pieces_and_all_languages_are_learned(spark):
    pieces = language.letter_pieces(language.tokenizer_path(language.VOCABULARY))
    assert "▁information" in pieces and max(map(len, pieces)) > 12
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 4} x{i % 250}", f"l{i % 250}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(docs, rounds=1).langs) == 250
