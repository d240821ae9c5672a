"""The registered queries on the smallest tables, and the pipeline on a small corpus."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import queries
from millrace.llm.packing import Capacity, pack
from tests.compare import check, duck

from .conftest import document
from .test_joins_models import near
from .test_text_operators import scanned

FOLDER = "/root/testdata/sf0.001"
KEYS = {"op1": "doc_id piece start length ids_crc32 sequence_id offset", "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op5": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6": "doc_id held_out score predicted",
        "op8": "doc_id held_out lang_pred score", "op9": "query_id rank vec_id score", "op10": "doc_id start n_tokens ids_crc32",
        "op11": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
        "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op13": "doc_id n_words n_removed kept_sha256"}


def test_names():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(entry.oracle_sql()) and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_copies", "benchmark", "secrets", "packing"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    verdict, note, _ = check(spark, duck(FOLDER), FOLDER, name, queries.QUERIES, queries.ORACLES)
    assert verdict in ("ok", "rows"), f"{verdict}: {note}"
    wanted = KEYS.get(name.split("_")[0])
    if wanted:
        assert queries.QUERIES[name](spark, FOLDER).columns[: len(wanted.split())] == wanted.split()


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """A folder with documents, labels and a benchmark, and what should become of the documents."""
    random = np.random.default_rng(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    good = [(i, prose(90).capitalize() + ".") for i in range(240)]
    bad = [(1000 + i, prose(60).upper().replace(" ", "!! ")) for i in range(60)]
    copies = [(2000 + i, near(good[i][1], 1, random)) for i in range(20)] + [(2100 + i, good[30 + i][1]) for i in range(20)]
    items = [prose(30) for _ in range(10)]
    leaks = [(3000 + i, prose(50) + " " + items[i] + " " + prose(50) + ".") for i in range(10)]
    keys = [(4000 + i, prose(40) + f" password = {'abcdef%03d' % i} " + prose(40) + ".") for i in range(15)]
    rows = [document(*r) for r in good + bad + copies + leaks + keys] + [document(5000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(good + keys)


def test_pipeline(spark, corpus):
    folder, kept = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    from millrace.scratch import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not [i for i in seen["quality"] if 1000 <= i < 2000] and len(set(kept) - set(seen["quality"])) == 0
    assert not [i for i in seen["near_copies"] if 2000 <= i < 3000] and set(kept) <= set(seen["near_copies"])
    assert not [i for i in seen["benchmark"] if 3000 <= i < 4000] and set(kept) <= set(seen["benchmark"])
    assert set(seen["secrets"]) == set(seen["benchmark"])
    for i, text in kept.items():
        assert seen["secrets"][i] == (re.sub(r"password = \S+", "[SECRET]", text) if scanned(text)[1] else text)
    whole = {tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {tuple(r)[:5] for r in pack(docs, Capacity(1024)).collect()}
    assert {r[0] for r in whole} == set(seen["secrets"])


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
