"""The pipeline's stages beside plain ones, and its contract."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import pieces
from tidemark.session import persist_table
from tests.llm.test_methods import plain_classes, cut_by_all_earlier_runs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(4), [], []
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    for i in range(120):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(25)) for _ in range(4))
        toxic = i % 6 == 0
        if toxic:
            text += " idiot scum of " + rng.choice(words) + " moron"
        if i % 10 == 3:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + i, rows[i + 1][1], "en", "s0", rows[i + 1][4]) for i in range(4)]
    rows += [(300, rows[7][1].replace("w1 ", "other ", 1), "en", "s1", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = persist_table(stage(spark, docs, folder), "stage")
        if i < 4:
            assert docs.columns == columns, name
        out.append({r.doc_id: r for r in docs.collect()})
    toxic, lines, near, mixed, coded = out
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(toxic) == {i for i in given if "scum" not in given[i]}
    assert {i: r.text for i, r in lines.items()} == cut_by_all_earlier_runs({i: r.text for i, r in toxic.items()})
    assert set(near) == set(plain_classes({i: r.text for i, r in lines.items()}).values())
    assert set(mixed) <= set(near) and all(mixed[i].text == near[i].text for i in mixed)
    assert all(coded[i].restored and coded[i].n_pieces == pieces.encoder().encode(__import__("pyarrow").array([mixed[i].text]))[0][0] for i in mixed)


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "restored"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "encoding"]
    assert corpus_pipeline.ORACLE_SQL is None
