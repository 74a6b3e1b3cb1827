"""Language identification: held-out accuracy, what is learned from, and odd texts."""

import random
import string
import zlib

import numpy as np
from pyspark.sql import functions as F

from tablegauge.llm.common import table
from tablegauge.llm.language import DIMENSIONS, accepted, counts, fit, identify
from tests.llm.helpers import documents


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    assert len(set(model.langs)) == 4 and len(model.langs) > 8
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [i for i in truth if held(i)]
    assert sum(got[i].lang_pred == truth[i] for i in out) >= 0.97 * len(out)
    assert not any(r.rejected for r in got.values())
    again = {r.doc_id: r for r in identify(docs.repartition(7).withColumn("lang", F.lit("xx")), fit(docs.repartition(5))).collect()}
    assert all(abs(again[i].score - got[i].score) < 1e-6 and again[i].lang_pred == got[i].lang_pred for i in got)


def test_learns_from_the_other_folds_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spoiled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    a, b = fit(docs), fit(spoiled)
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids)


def test_odd_texts(spark, sf_dir):
    model = fit(table(spark, sf_dir, "documents"))
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "漢字" * 50), (5, "the " * 50_000), (6, "a"), (6, "a"), (None, "the of and")]
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in identify(documents(spark, odd), model).collect()]
    assert len(got) == len(odd) and all(0 <= g[2] <= 1 for g in got)
    assert {g[1:] for g in got if g[0] in (1, 2, 3)} == {("und", 0.0, True)}
    assert [g[3] for g in got if g[0] == 4] == [True]
    kept = accepted(documents(spark, odd), model)
    assert kept.columns == documents(spark, odd).columns
    assert not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 5").count() == 1


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {tuple(r) for r in identify(docs, fit(docs)).collect()} == {(1, "und", 0.0, True), (2, "und", 0.0, True)}
    empty = documents(spark, [])
    assert identify(empty, fit(empty)).collect() == []


def test_long_texts_are_counted_in_blocks(monkeypatch):
    from tablegauge.llm import language

    text = "Ébène, 12 the " * 300 + "end"
    whole = counts(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (counts(text) == whole).all() and len(whole) == DIMENSIONS


def test_one_id_with_most_rows(spark, sf_dir):
    """A document that is repeated very often counts once."""
    docs = table(spark, sf_dir, "documents")
    often = docs.where("doc_id = 5").crossJoin(spark.range(500)).drop("id")
    a, b = fit(docs), fit(docs.unionByName(often))
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids)


def test_unlearned_languages_and_random_letters_are_rejected(spark, sf_dir):
    """In Latin letters, long and short; all labelled documents are kept."""
    own = random.Random(1)
    aliens = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. ",
              "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. ",
              "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. ",
              *[" ".join("".join(own.choices(string.ascii_lowercase, k=own.randint(2, 9))) for _ in range(n)) + " " for n in (20, 100, 400)]]
    for docs in (table(spark, d, "documents") for d in (sf_dir, sf_dir.replace("0.001", "0.01"))):
        model = fit(docs)
        assert [a[:20] for a in aliens for times in (1, 5) if not model.predict([a * times])[0][2]] == []
        out = [p for p in identify(docs, model).collect() if p.rejected]
        assert not out
