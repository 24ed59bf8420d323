"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import decontam, simhash
from tidemark.llm.common import materialize, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    quality, lines, alone, clean, mixed = (d.toPandas() for d in seen)
    assert len(lines) == len(quality) and (lines.text.str.len() == lines.n_chars).all()
    # No two documents that stay are near copies, and whoever went has a near copy among those before.
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in lines.itertuples()}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = alone.doc_id.tolist()
    assert not any(like(a, b) for i, a in enumerate(stay) for b in stay[:i])
    assert all(any(like(a, b) for b in lines.doc_id if b < a) for a in set(lines.doc_id) - set(stay))
    assert not decontam.find(spark.createDataFrame(clean), table(spark, SF, "benchmark")).count()
    assert 0 < len(mixed) <= len(clean)
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
