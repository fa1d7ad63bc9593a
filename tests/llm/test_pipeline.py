import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from secframe.llm.common import table  # noqa: E402
from secframe.llm.pieces import model_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    from sentencepiece import SentencePieceProcessor
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = {d: t for d, t in docs.items() if not brute.base_failed(t)}
    docs = {d: t for d, (t, emptied) in brute.dedup_lines(docs).items() if not emptied}
    component = brute.near(docs)
    docs = {d: t for d, t in docs.items() if component[d] == d}
    docs = {d: t for d, t in docs.items() if not brute.leaks(t, items)[1]}
    lib = SentencePieceProcessor(model_file=model_path())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs)
    differ = [r.doc_id for r in got if list(r.ids) != lib.encode(docs[r.doc_id])]
    assert not differ and all(r.round_trip for r in got)


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b", "en", "s", 3), (2, "w " * 30, "en", "s", 60)],
                                table(spark, SF, "documents").schema)
    for frame in (odd, odd.filter("doc_id < 0")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns and out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
