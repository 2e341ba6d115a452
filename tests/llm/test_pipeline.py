"""The pipeline against its operators' brute-force versions on small documents."""

import random
from pathlib import Path

import corpus_pipeline
from histspark.session import shared_dir

from .test_operators import make, words


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = sentence(rng.randint(30, 60))
        rows.append((i, " ".join(x + "%%" for x in t.split()) if bad else t))
        labels.append((i, int(not bad), 0))
    item = sentence(30)
    rows += [(300, sentence(10) + " " + item), (301, rows[1][1]), (302, rows[2][1] + " extra"), (303, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            docs = docs.cache()
            kept.append({r["doc_id"] for r in docs.collect()})
    assert not {i for i in kept[0] if i % 4 == 0 and i < 240} and len(kept[0] & set(range(240))) == 180
    assert 1 not in kept[1] and 301 in kept[1]  # the larger id of equal texts
    assert 302 not in kept[2] and 2 in kept[2]  # the smaller id of near copies
    assert 300 in kept[2] and 300 not in kept[3] and kept[2] - kept[3] == {300}
    pieces = docs.collect()
    assert {p["doc_id"] for p in pieces} == kept[3]
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert [n for n in left if n.startswith("stage")] == ["stage-3"] and "signatures" not in left  # earlier tables are gone
    assert words("A b") == ["a", "b"]
