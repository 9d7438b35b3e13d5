"""Kneser-Ney against plain code on dictionaries; models of many languages; the bound of the sample."""

from collections import Counter, defaultdict

import numpy as np

from ledgerloom.llm import langid
from tests.llm.test_langid import DOCS, counts, rows


def plain(text, letters):
    """Interpolated Kneser-Ney of order 4: absolute discounting, lower orders from the number of contexts."""
    symbols = langid.symbols(text).tolist()
    tables = [Counter(tuple(symbols[i : i + 4]) for i in range(len(symbols) - 3))]
    for _ in range(3):
        lower = Counter()
        for gram in tables[-1]:
            lower[gram[1:]] += 1  # one for each distinct gram above
        tables.append(lower)
    levels = []
    for table in tables:
        ones, twos = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        total, types = defaultdict(int), defaultdict(int)
        for gram, n in table.items():
            total[gram[:-1]] += n
            types[gram[:-1]] += 1
        levels.append((table, discount, total, types))

    def probability(gram, level=0):
        if level == 4:
            return 1.0 / max(2, letters)
        table, discount, total, types = levels[level]
        below = probability(gram[1:], level + 1)
        context = gram[:-1]
        if context not in total:
            return below
        return (table[gram] - discount if gram in table else 0.0) / total[context] + discount * types[context] / total[context] * below

    return probability


def test_against_plain_code():
    texts = ["the cat sat on the mat and the hat that the rat had sat on was flat", "Der Hund und die Katze, 12 im Haus; über Äpfel" * 3, "aaaa aaab aab ab b " * 5]
    for text in texts:
        for letters in (2, 9, 40):
            own, want = langid.KneserNey(*counts(text), letters), plain(text, letters)
            x = langid.symbols(text + " und the zebra qqq aab é").tolist()
            grams = [tuple(x[i : i + 4]) for i in range(len(x) - 3)]
            keys = np.array([a << 48 | b << 32 | c << 16 | d for a, b, c, d in grams], np.uint64)
            assert np.allclose(own.probability(keys), [want(g) for g in grams], rtol=1e-12, atol=0)


def test_cross_entropy_is_the_mean_of_plain_logarithms():
    a, b = "der hund und die katze sind im haus " * 4, "the dog and the cat are in the house " * 4
    letters = len({int(x) for t in (a, b) for x in langid.symbols(t)[3:]}) + 1
    for most in (langid.MOST_DENSE, 0):
        model = langid.Model.fit({"de": counts(a), "en": counts(b)}, most)
        assert (model.own is None) == (most > 0)
        for text in ("the hund is im garden", a, "x", "é 12 ü"):
            x = langid.symbols(text).tolist()
            grams = [tuple(x[i : i + 4]) for i in range(len(x) - 3)]
            size, got = model.entropies([text])
            want = [-np.mean([np.log(plain(t, letters)(g)) for g in grams]) for t in (a, b)]
            assert size[0] == len(grams) and np.allclose(got[0], want, atol=1e-4)


def test_many_languages_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), DOCS)
    dense = sorted(map(tuple, langid.identify(docs).drop("score").collect()))
    monkeypatch.setattr(langid.Model.fit.__func__, "__defaults__", (0,))
    assert sorted(map(tuple, langid.identify(docs).drop("score").collect())) == dense


def test_the_sample_is_bounded_by_characters(spark):
    long = [(5000 + i, "Der lange Text geht immer weiter. " * 3000, "de", "x", 1) for i in range(6)]
    docs = spark.createDataFrame(rows() + long, DOCS)
    model = langid.train(docs, chars_per_lang=3000)
    assert model.langs == ["de", "en"]
    only = langid.train(spark.createDataFrame(long, DOCS), chars_per_lang=10)
    assert only.langs == ["de"] or only.langs == []  # its one row may calibrate
