"""The pipeline's stages, each judged on its own input."""
import corpus_pipeline
from tests_llm_helpers import hits, linked, without_repeats  # noqa: I001

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "near_dedup":
            assert set(after) == {c for _, c in linked(before, 80).values()}
        if name == "suffix_dedup":
            assert set(after) == set(before)
            want = {d: kept for d, kept, _ in without_repeats(before.items())}
            for d, text in after.items():  # at most a part of a character more at each end of a run
                assert text == want[d].decode("utf-8", "ignore") or (not text.isascii() and set(want[d].decode('utf-8', 'ignore')) <= set(text))
        if name == "decontamination":
            assert set(after) == {d for d, (_, _, _, hit) in hits(before, items).items() if not hit}
        if name == "bpe":
            assert all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in out.collect())
        docs = out


def test_run_equals_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "stage")
    rows = lambda df: sorted(map(str, df.collect()))
    assert docs.count() > 100 and rows(corpus_pipeline.run(spark, SMALL)) == rows(docs)


def test_stages_of_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the operators' names."""
    long = "lorem ipsum dolor " * 15_000
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (5, "née 漢字 <|endoftext|> 😀"), (6, long), (None, "x y z"), (None, None)]
    names = ["lang", "p_toxic", "is_toxic", "spans", "kept", "ids", "decoded", "n_tokens", "_gone_id", "rep", "component"]
    docs = spark.createDataFrame([(i, t, len(t) if t else None, *names) for i, t in rows],
                                 "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        got = out.collect()
        assert all(tuple(r[c] for c in names) == tuple(names) for r in got)
        assert out.columns == docs.columns + (["bpe_ids", "bpe_n_tokens", "bpe_decoded"] if k == 4 else [])
        if name != "suffix_dedup":
            assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, kept))
        else:
            assert [r.doc_id for r in got].count(None) == 2 and {r.doc_id: r.text for r in got}[5] == rows[5][1]
        if k == 4:
            assert all(r.bpe_decoded == (r.text or "") and r.bpe_n_tokens == len(r.bpe_ids) for r in got)
        assert stage(spark, docs.where("false"), SMALL).count() == 0
