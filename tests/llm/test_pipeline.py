"""The corpus pipeline stage by stage against brute force, and on odd documents."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from survperf.llm import queries as Q  # noqa: E402
from tests.llm.test_operators import DOC, ODD, brute_hits, brute_secrets, fits  # noqa: E402
from tests.llm.test_similar import brute_kept  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, done[-1], SF).write.parquet(str(base / str(n)))
        done.append(spark.read.parquet(str(base / str(n))))
    return done


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage_keeps_what_the_query_predicts_good(spark, stages):
    good = {r.doc_id for r in Q.op1_quality(spark, SF).filter("predicted = 1").collect()}
    assert texts(stages[1]).keys() == good and 0 < len(good) < stages[0].count()


def test_near_copies_stage(stages):
    """Five-word shingles and a similarity of 0.8 or more, against brute force over all pairs."""
    before = texts(stages[1])
    kept, far = brute_kept(before)
    assert texts(stages[2]) == {k: before[k] for k in kept}
    assert far  # pairs that the fingerprints of op9's contract do not link


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = texts(stages[2])
    assert texts(stages[3]) == {k: t for k, t in before.items() if not brute_hits(t, items)[1]}


def test_secrets_stage(stages):
    before, after = texts(stages[3]), {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    changed = 0
    for k, text in before.items():
        spans = brute_secrets(text)
        if not spans:
            continue
        changed += 1
        assert not brute_secrets(after[k].text) and "[REDACTED]" in after[k].text and after[k].n_chars == len(after[k].text)
    assert changed and sum(before[k] != after[k].text for k in before) >= changed


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    want = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts(stages[4]).items()}
    got = defaultdict(int)
    rows = stages[5].collect()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want and fits(rows) <= 2 + 1.05 * sum(want.values()) / 2048


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[-1].select(key).collect()))


def test_stages_on_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame(ODD, DOC)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.count() <= 20
            if n < 4:
                assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[0][1](spark, docs.withColumn("_score2", F.lit(1)), SF).columns[-1] == "_score2"
