import random

import numpy as np

from quire.llm import langid, quality
from tests.llm import corpus


def gradients_match(model, x, counts, y):
    f = model.forward(x, counts)
    loss = lambda: float(-np.mean(y * np.log(model.forward(x, counts)["s"]) + (1 - y) * np.log(1 - model.forward(x, counts)["s"])))
    for name, g in model.gradients(f, y).items():
        flat = model.p[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 5)):
            old, e = flat[k], 1e-4
            flat[k] = old + e
            up = loss()
            flat[k] = old - e
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * e) - g.reshape(-1)[k]) < 1e-4, name
    return True


def test_gradients_are_those_of_the_loss():
    r = np.random.Generator(np.random.PCG64(1))
    m = quality.AttentionModel()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    counts = np.array([3, 1, 5])
    assert gradients_match(m, r.random((9, quality.FEATURES)), counts, np.array([1.0, 0.0, 1.0]))


def labelled(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        good = i % 3 != 0
        text = " ".join(corpus.words(r, r.randint(30, 300)))
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "&&&" for w in text.split())
        docs.append((i, text, "aa" if i % 2 else "bb", "s", len(text)))
        labels.append((i, int(good), 0))
    labels += [(0, 1, 0), (1, None, 0), (None, 1, 0), (2, 7, 0)]
    return docs + [(900, None, None, None, None), (901, "", "aa", "s", 0), (None, "x y z", "aa", "s", 5), (5, docs[5][1], "aa", "s", 0)], spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_documents_it_has_not_learned_from(spark):
    docs, labels = labelled(spark)
    got = quality.classify(corpus.frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901]


def test_quality_filter_keeps_columns_and_good_rows(spark):
    docs, labels = labelled(spark)
    df = corpus.frame(spark, docs)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i in range(300) if i % 3}) > 190 and len(ids & {i for i in range(0, 300, 3)}) < 5


def test_every_passage_of_the_rows_learned_from_is_encoded(spark, monkeypatch):
    met = {}

    def fit(self, x, counts, y):
        met.update(counts=sorted(counts.tolist()), rows=len(x))
        return self

    monkeypatch.setattr(quality.AttentionModel, "fit", fit)
    docs = [(k, "a word " * (80_000 if k == 0 else 40 * k), "aa", "s", 0) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    sizes = {k: max(1, -(-len(d[1]) // quality.PASSAGE)) for k, d in enumerate(docs)}
    quality.train(corpus.frame(spark, docs), labels, held_fold=None)
    assert met["counts"] == sorted(sizes.values()) and met["rows"] == sum(sizes.values()) and max(sizes.values()) > 1000
    # A row that takes more than its share is no row to learn from; of the others as many as fit.
    quality.train(corpus.frame(spark, docs), labels, held_fold=None, fit_passages=300)
    assert met["rows"] <= 300 and max(met["counts"]) <= 30 and met["rows"] > 250


def test_nothing_to_learn_from(spark):
    docs, labels = labelled(spark)
    assert {r.score for r in quality.classify(corpus.frame(spark, docs[:5]), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(corpus.empty(spark), labels).count() == 0
    got = langid.languages(corpus.frame(spark, [(1, "some text", None, "s", 0)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.languages(corpus.empty(spark)).count() == 0


def test_languages_of_documents_it_has_not_learned_from(spark):
    r = random.Random(9)
    tongues = {"aa": "ba ce di fo gu".split(), "bb": "shra klu vro zny pti".split(), "cc": "öta yllä kään neit sää".split()}
    rows = []
    for i in range(400):
        lang = list(tongues)[i % 3]
        text = " ".join("".join(r.choice(tongues[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60)))
        rows.append((i, text, lang, "s", 0))
    rows += [(500, None, "aa", "s", 0), (501, "", "aa", "s", 0), (502, "12 34 !", "bb", "s", 0), (503, rows[0][1], None, "s", 0), (None, rows[1][1], "bb", "s", 0)]
    got = {x.doc_id: x for x in langid.languages(corpus.frame(spark, rows)).collect()}
    held = [x for i, x in got.items() if i is not None and i < 400 and x.held_out]
    assert len(held) > 90 and sum(x.lang_pred == list(tongues)[x.doc_id % 3] for x in held) / len(held) > 0.97
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"} and got[503].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= x.score <= 1 for x in got.values())


def test_codewords_are_apart_and_columns_split():
    for n in (2, 3, 4, 9, 30):
        m = langid.codewords(n)
        assert (np.abs(m.sum(0)) < n).all()
        assert n == 2 or min((m[a] != m[b]).sum() for a in range(n) for b in range(a)) >= 3
