import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

import corpus_pipeline as C
from quarry.llm import quality_rules as Q


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents").collect()
    rows = {r["doc_id"]: r.asDict() for r in docs}
    trusted = {r[0] for r in Q.trusted_ids(C.read(spark, sf_dir, "labels")).collect()}
    text = {k: r["text"] for k, r in rows.items()}
    good = {x[0] for x in brute.quality(list(text.items()), trusted, Q.BUCKETS, Q.SMOOTHING, Q.THRESHOLD) if x[-1]}
    text = {k: t for k, t in text.items() if k in good}
    first = {x[0] for x in brute.jaccard_components(list(text.items()), 5, 80) if x[0] == x[2]}
    text = {k: t for k, t in text.items() if k in first}
    left = {x[0]: x[1] - x[2] for x in brute.substring_dedup(list(text.items())) if x[1] - x[2]}

    df = C.read(spark, sf_dir, "documents")
    for name, stage in C.STAGES[:3]:
        df = C.spool(stage(spark, df, sf_dir), name)
        assert df.columns == C.read(spark, sf_dir, "documents").columns
    cut = {r["doc_id"]: r["text"] for r in df.collect()}
    assert {k: len(t.split()) for k, t in cut.items()} == left
    items = [tuple(r) for r in C.read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    held = {x[0] for x in brute.containment(list(cut.items()), items)}
    got = C.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) == set(cut) - held
    assert got.groupby("doc_id").n_words.sum().to_dict() == {k: n for k, n in left.items() if k not in held}
    assert (got.groupby("bin").n_words.sum() <= 2048).all()
