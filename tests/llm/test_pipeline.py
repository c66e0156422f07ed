import random

import pytest

import corpus_pipeline
from quire.llm import queries
from quire.llm.minhash import near_duplicates
from quire.llm.queries import tokenizer_path
from tests.llm import corpus
from tests.llm.test_minhash import expected


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(21)
    docs, labels = [], []
    items = [(k, " ".join(corpus.words(r, 30))) for k in range(5)]
    for i in range(240):
        text = " ".join(corpus.words(r, r.randint(40, 120)))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 10 == 1:
            text += " " + items[i % 5][1]
        elif i % 10 == 3:
            text += f" write to person{i}@mail.example.com or call +1 (555) 010-{1000 + i}"
        elif i % 20 == 6:
            text = docs[-1][1] + " extra"
        docs.append((i, text, "aa", "s", len(text)))
        labels.append((i, int(i % 4 != 0), 0))
    spark.createDataFrame(docs, corpus.DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, items


def test_each_stage_takes_effect(spark, folder):
    d, docs, items = folder
    text = {i: t for i, t, *_ in docs}
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        now = spark.createDataFrame(now.collect(), corpus.DOCS)
    good = {i for i in text if i % 4}
    assert len(set(kept["quality"]) ^ good) <= 4
    groups = expected([r for r in docs if r[0] in kept["quality"]], 5, 80)
    assert set(kept["near_duplicates"]) == {i for i, c in groups.items() if i == c}
    assert set(kept["decontamination"]) == {i for i in kept["near_duplicates"] if not any(t in text[i] for _, t in items)}
    assert set(kept["private_data"]) == set(kept["decontamination"])
    for i, t in kept["private_data"].items():
        assert ("<EMAIL>" in t and "<PHONE>" in t and "@" not in t) if i % 10 == 3 and i % 20 != 6 else t == text[i] or "<EMAIL>" in t
    last = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in last} == set(kept["private_data"])
    from quire.llm.pieces import PieceModel

    m = PieceModel(tokenizer_path("piece_bpe_32k.model"))
    assert all(m.decode(r.ids).decode() == kept["private_data"][r.doc_id] and r.n_tokens == len(r.ids) for r in last)


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert near_duplicates.__doc__


def test_empty_tables_repeated_rows_and_extra_columns(spark, tmp_path):
    r = random.Random(22)
    texts = [" ".join(corpus.words(r, 60)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, texts[0] + " end"), (None, texts[2]), (4, None), (5, ""), (5, texts[3])]
    more = "doc_id bigint, text string, key string, score double, `a.b` int"
    frames = {"documents": spark.createDataFrame([(i, t, "k", 0.5, 7) for i, t in rows], more), "labels": spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id bigint, text string")}
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = frames["documents"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frames["documents"].columns
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in now.collect()) == sorted((-1 if i is None else i, t or "") for i, t in rows if i != 3)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 7
    empty = tmp_path / "empty"
    for name, df in frames.items():
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
