"""The pipeline's stages: each works on all that the one before it kept, and its decisions take effect."""

import corpus_pipeline as C
import pytest

from tessera.llm import decontaminate, near_duplicates, quality_classifier, suffix_dedup
from tessera.plans.lineage import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_are_those_asked_for():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]


def test_all_but_the_last_return_the_columns_of_documents(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_the_classifier_drops_what_it_rejects(spark, steps):
    before, after = steps[0]
    good = {r.doc_id for r in quality_classifier.scored(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == good
    assert 0 < after.count() < before.count()


def test_one_of_each_group_of_near_duplicates_stays(steps):
    before, after = steps[1]
    left = {r.doc_id for r in after.collect()}
    classes = {r.doc_id: r.class_id for r in near_duplicates.classes(before).collect()}
    assert left == {classes.get(r.doc_id, r.doc_id) for r in before.collect()}


def test_no_passage_repeats_and_no_benchmark_item_is_left(spark, steps):
    assert suffix_dedup.passages(cut(steps[2][1])).count() == 0
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(steps[3][1], benchmark).count() == 0
    found = {r.doc_id for r in decontaminate.contaminated(steps[3][0], benchmark).collect()}
    assert {r.doc_id for r in steps[3][1].collect()} == {r.doc_id for r in steps[3][0].collect()} - found


def test_ids_decode_to_the_text(steps):
    before, after = steps[4]
    assert {(r.doc_id, r.text) for r in before.collect()} == {(r.doc_id, r.text) for r in after.collect()}
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in after.collect())


def test_run_is_all_stages(spark, steps):
    assert sorted(map(str, C.run(spark, SF).collect())) == sorted(map(str, steps[-1][1].collect()))


def _write(spark, folder, documents, labels=(), benchmark=()):
    docs = "doc_id long, text string, lang string, source string, n_chars long, label int, node string, low double, token_ids string"
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "n", 0.5, "x") for d, t in documents], docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, q, 0, "x") for d, q in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, t, 1) for i, t in benchmark], "item_id long, text string, doc_id int").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_empty_long_repeated_rows_and_clashing_columns(spark, tmp_path):
    own = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    passage, item = own("p", 60), own("q", 20)
    rows = [(1, own(1)), (2, own(1)), (3, own(3) + " " + passage), (4, own(4) + " " + passage), (5, None), (6, ""), (None, own(7)), (None, own(7)), (8, own(8)), (8, own(8)), (9, own(9) + " " + item), (10, own(10, 30_000)), (11, " \n ")]
    sf = _write(spark, tmp_path, rows, (), [(1, item), (2, None), (3, "")])
    got = C.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "node", "low", "token_ids", "n_tokens", "round_trip"]
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect()), key=str)
    want = [(1, own(1)), (3, own(3) + " " + passage), (4, own(4) + " "), (5, None), (6, ""), (8, own(8)), (10, own(10, 30_000)), (11, " \n ")]
    assert left == sorted([*((False, d, t) for d, t in want), (True, 0, own(7)), (True, 0, own(7))], key=str)
    assert all((r.label, r.node, r.low) == (1, "n", 0.5) for r in got.collect())


def test_empty_tables(spark, tmp_path):
    got = C.run(spark, _write(spark, tmp_path, []))
    assert got.count() == 0 and "round_trip" in got.columns
