"""Language models: probabilities that sum to one, held-out accuracy, edges."""

import zlib

import numpy as np

from ledgerloom.llm import langid, registry

DOCS = "doc_id long, text string, lang string, score string, rejected int"


def test_symbols():
    show = lambda t: "".join(chr(int(x)) for x in langid.symbols(t))
    assert show("Ab, C3d!") == "   ab c d "
    assert show("...é") == "   é " and show("12 %") == "" and show("") == ""
    assert len(langid.symbols("𐐀")) == 5


def counts(text):
    grams, n = np.unique(langid.keys(langid.symbols(text)), return_counts=True)
    return grams, n.astype(float)


def test_probabilities_sum_to_one():
    text = "the cat sat on the mat and the hat that the rat had sat on was flat " * 3 + "abcdefgh"
    letters = sorted(set(langid.symbols(text).tolist()))
    own = langid.KneserNey(*counts(text), len(letters))
    for context in ("the", "at ", "zzz", "  t"):
        c = [ord(x) for x in context]
        keys = np.array([c[0] << 48 | c[1] << 32 | c[2] << 16 | x for x in letters], np.uint64)
        assert abs(own.probability(keys).sum() - 1) < 1e-9


def test_arrays_give_the_models_probabilities():
    a, b = "der hund und die katze sind im haus " * 4, "the dog and the cat are in the house " * 4
    model = langid.Model.fit({"de": counts(a), "en": counts(b)})
    letters = len(set(langid.symbols(a + b).tolist())) + 1
    for text in (a, b, "unseen words qqq xyz", "é"):
        keys = langid.keys(langid.symbols(text))
        got = model.log_probabilities(keys)
        for i, own in enumerate((a, b)):
            n = len(np.unique(np.concatenate([counts(a)[0], counts(b)[0]]) & np.uint64(0xFFFF))) + 1
            want = np.log(langid.KneserNey(*counts(own), n).probability(keys))
            assert np.allclose(got[:, i], want, atol=1e-4), (text, letters)
    for g in model.grams + model.contexts:
        assert (np.diff(g.astype(object)) > 0).all()


def rows():
    de = ["Der Hund liegt im Garten und schläft.", "Wir gehen heute in die Stadt und kaufen Brot.", "Das Wetter ist schön, aber kalt."]
    en = ["The dog lies in the garden and sleeps.", "We go to town today and buy bread.", "The weather is nice but cold today."]
    return [(i, (de if i % 2 else en)[i % 3] + f" {(de if i % 2 else en)[(i // 3) % 3]}", "de" if i % 2 else "en", "x", 1) for i in range(300)]


def test_operator(spark):
    odd = [(1000, None, "de", "x", 1), (1001, "", "en", "x", 1), (1002, "123 !?", "en", "x", 1), (None, "Der Hund liegt im Garten", "en", "x", 1), (1003, "The dog " * 100_000, None, "x", 1), (1003, "The dog " * 3, "fr", "x", 1), (1004, "ж", None, "x", 1)]
    docs = spark.createDataFrame(rows() + odd, DOCS)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows()) + len(odd)
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if i is not None and i < 300:
            assert r["lang_pred"] == ("de" if i % 2 else "en") and not r["rejected"]
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 1003}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["rejected"] for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == "de" and by_id[1004]["lang_pred"] != "und" and by_id[1004]["rejected"]
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1000, 1001, 1002, 1004})


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None, "x", 1)], DOCS)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_learns_from_training_rows_only(spark):
    """Held-out labels and null ones teach nothing."""
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0][:30]
    docs = spark.createDataFrame(rows() + [(i, "Le chien dort dans le jardin", "fr", "x", 1) for i in held if i >= 300], DOCS)
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"de", "en"}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in registry.table(spark, sf_dir, "documents").collect()}
    got = registry.op7_language(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.002 * len(got)
