"""The pipeline's rows against its stages done by hand."""
import corpus_pipeline as P
from ledgerlens.llm import langid, packing, toxicity
from tests.llm.test_similar import brute_components
from tests.llm.test_exact import brute_groups

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tagger = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    score, _, _ = toxicity._Scorer(tagger).score([r["text"].encode() for r in rows])
    rows = [r for r, s in zip(rows, score) if s < 0.5]
    first = P.toxicity_stage(spark, docs, SF)
    net = langid.train(langid.training_sample(first))
    langs, scores = langid.predict_texts([r["text"].encode() for r in rows], langid._Cache(net))
    rows = [r for r, lang, s in zip(rows, langs, scores) if lang != "und" and s >= P.MIN_LANGUAGE_SCORE]
    kept = {k[1] for k in brute_groups([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in kept]
    kept = {c[2] for c in brute_components([(r["doc_id"], r["text"]) for r in rows], P.NEAR_SHINGLE, P.NEAR_NUM, P.NEAR_DEN)}
    bpe = packing.tokenizer()
    want = []
    for r in rows:
        if r["doc_id"] in kept:
            start = 0
            for n in packing.cut(len(bpe.encode(r["text"])) + 1):
                want.append((r["doc_id"], start, n))
                start += n
    got = P.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) == len(got)


def test_stages_keep_columns_and_take_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for name, stage in P.STAGES:
        for d in (docs, make_docs([])):
            out = stage(spark, d, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()
