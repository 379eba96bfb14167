"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, linededup, mixing, outliers, pieces, pii, records, tokens, toxicity, winnowing
from tidemark.session import ship_package

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeiorst"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(1) + "\n" + prose(2)
    out = [(i, prose(i + 10), "en", f"s{i % 3}", None) for i in range(30)]
    out += [
        (100, None, "en", "s0", None), (101, "", None, None, None), (102, " \n\t ", "en", None, 3),
        (None, "a null id and some words here", "en", "s1", None), (103, shared, None, "s2", None),
        (104, prose(3, 5) + "\n" + shared + "\n\n" + "tail", "en", "s2", 5), (105, shared, "de", "s0", 1),
        (106, prose(4, 30_000), "en", "s1", None), (107, "x" * 50_000, "en", "s1", None),
        (108, "same words " * 40, "en", "s0", None), (109, "same words " * 40, "en", "s0", None),
        (110, "one", "en", "s0", None), (110, "one", "en", "s0", None), (110, "another text of this id", "en", "s0", None),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    given = [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(given, "doc_id LONG, quality INT, toxic INT")


def exactly(df, *names):
    """Columns by exact name, beside others that differ in case only."""
    return df.toDF(*[c if c in names else f"other{i}" for i, c in enumerate(df.columns)]).select(*names)


def operators(labels):
    return {
        "mix": lambda d: mixing.mix(d, labels).select("doc_id", "size", "source_size", "target", "taken"),
        "outliers": lambda d: outliers.judge(d).select("doc_id", "n_words", "base_failed", "kept"),
        "winnowing": winnowing.compare_with_edit,
        "tokens": tokens.count_tokens,
        "pii": lambda d: pii.personal_data_digests(d),
        "classes": lambda d: bagminhash.duplicate_classes(d).select("doc_id", "class_id"),
        "pieces": pieces.piece_digests,
        "lines": lambda d: exactly(linededup.delete_repeats(d), "doc_id", "text", "n_lines", "n_deleted"),
        "records": records.encode_to_records,
        "toxicity": lambda d: toxicity.judge(d, labels).select("doc_id", "p_toxic", "rejected"),
    }


NAMES = ["mix", "outliers", "winnowing", "tokens", "pii", "classes", "pieces", "lines", "records", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result_whatever_else_the_table_holds(docs, labels, rows, name):
    run = operators(labels)[name]
    plain = sorted(map(str, run(docs).collect()))
    assert len(plain) == len(rows)
    clashing = docs.select(
        "*", *[F.lit(7).alias(c) for c in ("TEXT", "_bucket", "node", "size", "_key", "grp", "text_sha256", "hashes", "p_toxic", "n_lines")]
    )
    again = sorted(map(str, run(clashing).collect()))
    assert again == plain


@pytest.mark.parametrize("name", NAMES)
def test_no_rows_give_no_rows(spark, labels, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert operators(labels)[name](empty).count() == 0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_defined_results(docs, labels):
    counts = by_id(tokens.count_tokens(docs))
    assert counts[100]["n_tokens"] == counts[101]["n_tokens"] == counts[102]["n_tokens"] == 0
    judged = by_id(outliers.judge(docs))
    assert all(judged[i]["base_failed"] and not judged[i]["kept"] for i in (100, 101, 102, 110, 108))
    prints = by_id(winnowing.compare_with_edit(docs))
    assert prints[100]["near_next"] == 1.0  # both empty
    assert prints[108]["fingerprint"] == prints[109]["fingerprint"]
    classes = by_id(bagminhash.duplicate_classes(docs))
    assert classes[109]["class_id"] == 108 and classes[101]["class_id"] == 100 and classes[102]["class_id"] == 102
    assert classes[105]["class_id"] == 103
    cut = by_id(linededup.delete_repeats(docs))
    assert cut[100]["text"] is None and cut[105]["text"] == "" and cut[103]["n_deleted"] == 0
    assert cut[104]["text"].split("\n")[1:] == ["", "tail"] and cut[104]["n_deleted"] == 2
    assert cut[104]["n_chars"] == len(cut[104]["text"]) and cut[103]["n_chars"] is None


def test_operators_that_return_documents_keep_their_columns(docs, labels):
    wide = docs.withColumn("_key", F.lit("k")).withColumn("Source_Size", F.lit(1))
    for made in (bagminhash.drop_near_duplicates(wide), mixing.mixed_documents(wide, labels)):
        assert made.columns == wide.columns
        assert {r["_key"] for r in made.select("_key").collect()} == {"k"}
    kept = [r[0] for r in bagminhash.drop_near_duplicates(docs).select("doc_id").collect()]
    assert sorted({x for x in kept if x in (103, 105, 108, 109, 110)}) == [103, 108, 110] and None in kept


def test_unlike_texts_without_an_id_or_under_one_id_all_stay(spark):
    near = prose(5, 100)
    given = [(None, prose(i, 40)) for i in range(6)] + [(7, prose(20, 40)), (7, prose(21, 40)), (8, prose(22, 40)), (None, prose(22, 40))]
    given += [(9, near), (9, near + " tail"), (None, prose(30, 40)), (None, prose(30, 40))]
    frame = spark.createDataFrame([(*r, "en", "s", None) for r in given], SCHEMA).repartition(3)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in bagminhash.drop_near_duplicates(frame).collect())
    plain = [(str(i), t) for i, t in given[:9]] + [("None", prose(30, 40))]
    assert [r for r in kept if r[0] != "9"] == sorted(plain)
    assert len([r for r in kept if r[0] == "9"]) == 1
    classes = bagminhash.duplicate_classes(frame)
    assert classes.select("root").distinct().count() == 11


def test_labels_may_be_missing(spark, docs):
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert toxicity.judge(docs, none).filter("rejected").count() == 0
    assert mixing.mix(docs, none).count() == docs.count()
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    assert toxicity.judge(docs, one_class).filter("rejected").count() == 0


def test_edited_texts(docs, rows):
    seen = by_id(winnowing.compare_with_edit(docs.filter("doc_id < 30")))
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 30}
    for i in range(30):
        t, n = texts[i], texts[(i + 1) % 30]
        q = len(t) // 4
        assert seen[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
