import corpus_pipeline
import __spark_entry__
from lexlake.llm import packing, quality
from lexlake.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, sf, "labels")).collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scores.items() if p == 1)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert one.columns == columns and len({r.text for r in one.collect()}) == one.count() <= len(set(texts.values()))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == columns and all(texts[r.doc_id] == r.text for r in mixed.collect())
    ids = [r.doc_id for r in mixed.collect()]
    assert len(ids) == len(set(ids)) >= 0.8 * len(texts)  # nothing is repeated; what goes is what looks like the domain that is over its target
    assert corpus_pipeline.pack_sequences(spark, docs, sf).columns[:6] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and max(r.offset + r.length for r in out) <= 2048 and packing.SHARD_PIECES


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
