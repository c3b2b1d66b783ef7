"""The pipeline's stages on the smallest tables: each stage's decisions equal those of brute force on its own input."""

import corpus_pipeline
import pytest

from meterline.llm import toxicity
from meterline.llm.common import cut
from tests.llm.test_text_operators import brute_components, brute_contamination, brute_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's name with its input and output rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, sf_dir), name)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_stages_in_order_and_their_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontaminate", "mixing"]
    assert len(corpus_pipeline.STAGES) in (4, 5)
    for name, (_, after) in list(stages.items())[:-1]:
        assert after and after[0].__fields__ == COLUMNS


def test_toxicity_drops_what_it_scores(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, *toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if scores[r["doc_id"]] < toxicity.REJECT}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
    assert {r["doc_id"] for r in after} == {i for i, (_, least) in want.items() if i == least}


def test_repeats_are_cut(stages):
    before, after = stages["substring_dedup"]
    want = brute_repeats([(r["doc_id"], r["text"]) for r in before], 20)
    was = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {i: kept if gone else was[i] for i, (_, gone, kept) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_contaminated_documents_go(spark, sf_dir, stages):
    before, after = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = brute_contamination([(r["doc_id"], r["text"]) for r in before], items, 13)
    assert {r["doc_id"] for r in after} == {i for i, (n, hit, _) in found.items() if not (hit and 20 * len(hit) >= n)}


def test_mixing_rates_all_that_is_left(stages):
    before, after = stages["mixing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} and all(r["rate"] >= 0 for r in after)


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_on_odd_documents(spark, sf_dir, tmp_path, some):
    """Null and empty texts, repeated rows, a null id, a very long text, extra columns with inner names; and an empty table."""
    rows = [(1, "a plain text of some words", "en", "s", 26), (1, "a plain text of some words", "en", "s", 26), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a text without an id", "en", "s", 20), (4, "word " * 60_000, "en", "s", 300_000), (5, "A plain text of some words", "de", "t", 26)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, rep long, grp string, score double, hits string, words string, p double, n long"
    docs = spark.createDataFrame([(*r, 1, "x", 0.5, "h", "w", 0.1, 2) for r in (rows if some else [])], ddl)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out)
    assert ids == ([(False, 0), (True, 1), (True, 1), (True, 2), (True, 3), (True, 4)] if some else [])
    assert all(r["rate"] >= 0 for r in out)
