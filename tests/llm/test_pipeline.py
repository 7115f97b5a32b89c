"""The pipeline, stage by stage, against plain versions of the stages."""

import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from foliant.llm import language_id, mixing, token_files

from tests.llm.test_decontamination import plain as plain_hits
from tests.llm.test_near_copies import plain_kept

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, D).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_rows_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0


def test_language(stages):
    before, after = stages[0]
    model = language_id.train(before.filter(language_id.training_fold(before)))
    kept = [r.doc_id for r in before.collect() if language_id.score_texts(model, [(r.text or "").encode()])[1][0] >= language_id.LEAST_SCORE]
    assert ids(after) == sorted(kept)


def test_near_duplicates(stages):
    before, after = stages[1]
    assert ids(after) == plain_kept([(r.doc_id, r.text) for r in before.collect()])


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(x[0] for x in plain_hits(rows, items) if not x[4])


def test_mixture_and_tokens(spark, stages):
    before, after = stages[3]
    order = [r.doc_id for r in mixing.mix(before).orderBy("slot", "ordinal", "doc_id").collect()]
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(token_files.default_vocabulary()), 0, []
    texts = {r.doc_id: r.text for r in after.collect()}
    for i in order:
        x = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        at += len(x)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[4][1].orderBy("start").collect()] == want


def test_run(spark, stages):
    assert P.run(spark, D).exceptAll(stages[4][1]).count() == 0


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{D}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
