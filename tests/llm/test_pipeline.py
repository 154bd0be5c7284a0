import hashlib
import sys
from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline as p  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from tilecask.llm.common import written

    docs = p.table(spark, DATA, "documents")
    columns = docs.columns
    items = [tuple(r) for r in p.table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    for i, (_, stage) in enumerate(p.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, DATA))
        after = {r["doc_id"]: r for r in docs.collect()}
        if i == 1:
            assert set(after) == {d for d, _, _, kept in brute.near(before, 5) if kept}
        if i == 2:
            want = {d: (n, s) for d, _, n, s in brute.repeats(before)}
            for d, r in after.items():
                assert want[d][0] == 0 or hashlib.sha256(r["text"].encode()).hexdigest() == want[d][1]
        if i == 3:
            assert set(after) == {d for d, *_, bad in brute.leaks(before, items) if not bad}
        assert i == 4 or docs.columns == columns
    assert docs.where("not round_trip").count() == 0 and docs.count() == len(before)


def test_near_dedup_keeps_one_of_equal_rows(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (2, text("c")), (None, text("d")), (None, text("d")), (None, text("e")), (3, None), (3, None), (4, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t in rows for s in ("x", "y")], "doc_id long, text string, lang string, source string, n_chars int")
    out = p.near_dedup(spark, docs, DATA)
    want = [(1, text("a")), (1, text("b")), (2, text("c")), (None, text("d")), (None, text("e")), (3, None)]
    assert out.columns == docs.columns and out.where("source = 'x'").count() == len(want)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))


def test_tokens_take_one_python_worker_a_task(spark):
    """Two in each task, and idle ones that Spark keeps, took an executor of 2 cores over 3000 MB."""
    texts = [None, "", "a  b\n", "<|endoftext|> it's", "\u65e5\u672c \U0001f600 \xa0x", "w " * 3000, "x" * 5000, "a  b\n"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    out = p.tokens(spark, docs, DATA)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = p.vocabulary(spark)
    both = p.bpe.decode(p.bpe.encode(docs, path), path).collect()
    want = sorted((r["doc_id"], bytes(r["ids"]), len(r["ids"]) // 4, r["decoded"] == (r["text"] or "")) for r in both)
    assert sorted((r["doc_id"], bytes(r["ids"]), r["n_tokens"], r["round_trip"]) for r in out.collect()) == want
    trip = p.bpe.round_trip(docs, path)
    assert trip.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in trip.collect()) == sorted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in both)
    assert trip.where("false").count() == 0 and p.tokens(spark, docs.where("false"), DATA).count() == 0
