"""The pipeline's stages: columns, and each decision against brute force on its own input."""

import corpus_pipeline
from lossledger.llm.common import stored

from .test_operators import kept_words, shingles, split


def test_stages(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    def rows(name):
        return [(r["doc_id"], r["text"]) for r in inputs[name].collect()]

    sets = {i: shingles(t, 5) for i, t in rows("minhash_near_dedup")}
    left = {i for i, _ in rows("substring_dedup")}
    for i in left:
        for j in left:
            if i < j and sets[i]:
                assert 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])
    for i in set(sets) - left:  # something smaller of its group stayed
        assert any(j < i and sets[i] & sets[j] for j in sets)
    kept = kept_words(rows("substring_dedup"))
    assert sorted((i, split(t)) for i, t in rows("benchmark_decontamination")) == sorted((i, w) for (i, _), w in kept.items() if w)
    packed = docs.toPandas()
    assert set(packed.doc_id) == {i for i, _ in rows("best_fit_packing")}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, path).select("doc_id", "piece", "ids_crc32").toPandas()
    keys = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, whole[keys].to_numpy())) == sorted(map(tuple, packed[keys].to_numpy()))
