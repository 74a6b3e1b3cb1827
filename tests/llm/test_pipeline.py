"""The pipeline, stage by stage against brute force, and its registration."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from tablegauge.llm.common import table
from tablegauge.llm.secrets import redacted, secret_spans
from tests.llm.helpers import CLASHES, documents, prose, texts
from tests.llm.test_decontaminate import brute
from tests.llm.test_packing import check
from tests.llm.test_simhash import fingerprint, least_reachable


def test_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontamination", "secrets", "packing"]


def survivors(docs, items):
    """Ids that near-duplicate removal and decontamination leave."""
    prints = {i: fingerprint(t) for i, t in docs}
    ids, array = list(prints), np.array(list(prints.values()), dtype=np.uint64)
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(array[:a] ^ array[a]) <= 3)]
    least = least_reachable(ids, pairs)
    kept = [(i, t) for i, t in docs if least[i] == i]
    bad = {r[0] for r in brute(kept, items) if r[5]}
    return [(i, t) for i, t in kept if i not in bad]


def test_whole_run(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    expected = [(i, redacted(t, "[{kind}]")) for i, t in survivors(docs, items)]
    check(P.run(spark, sf_dir).collect(), expected, 1024)


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    docs = [(i, t) for i, t in texts(30) if i != 7] + [(7, prose(7, 60)), (7, prose(7, 60)), (None, prose(1, 50)), (800, f"token=abcdefgh1 {prose(8, 40)}")]
    frame = documents(spark, docs)
    deduped = P.near_dedup(spark, frame, sf_dir)
    assert deduped.schema == frame.schema
    rows = [(r.doc_id, r.text) for r in deduped.collect()]
    assert len([i for i, _ in rows if i is not None]) == len({i for i, _ in rows if i is not None})
    assert sum(i is None for i, _ in rows) == 2
    clean = P.decontamination(spark, frame, sf_dir)
    assert clean.schema == frame.schema and clean.count() == frame.count()
    freed = P.secrets(spark, frame, sf_dir)
    assert freed.schema == frame.schema and freed.count() == frame.count()
    row = freed.where("doc_id = 800").first()
    assert row.text.startswith("[assign] ") and row.n_chars == len(row.text) and not secret_spans(row.text)[0]
    assert all(row[c] == "x" for c in CLASHES)
    assert P.language(spark, table(spark, sf_dir, "documents").withColumn("chunk", F.lit(1)), sf_dir).columns[-1] == "chunk"


def test_contaminated_documents_go(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").where("length(text) > 150").first().text
    frame = documents(spark, [(1, prose(1, 50)), (2, f"{prose(2, 50)} {item.upper()} {prose(3, 50)}"), (None, item), (3, None)])
    assert sorted(r.doc_id for r in P.decontamination(spark, frame, sf_dir).collect()) == [1, 3]


def test_no_documents(spark, sf_dir):
    frame = documents(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, frame, sf_dir).collect() == []
