"""The pipeline's stages against brute-force decisions on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(8)
    common = "the of and to in is was that it on for with".split()
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("an er on re ti lo ka mu sha".split()) for _ in range(rnd.randint(2, 4)))
    line = lambda k: " ".join(word() for _ in range(k))
    docs = {i: "\n".join(line(20) for _ in range(6)) for i in range(30)}
    docs[40] = docs[3]  # an exact copy
    docs[41] = " ".join(docs[4].replace("\n", " ").split(" ")[:-3] + ["new", "end", "here"])  # a near copy on one line
    docs[42] = docs[5] + "\n" + docs[6].split("\n")[0]  # a copy and a repeated line
    docs[43] = " ".join(w + "$$$" for w in line(80).split())  # junk
    docs[44] = "too short"
    docs[45] = None
    item = line(25)
    docs[46] = "\n".join(line(20) for _ in range(3)) + "\n" + item
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(at.columns) == sorted(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id for r in at.collect()})
    assert kept[0] == set(docs) - {43, 44, 45}
    assert kept[1] == kept[0] - {40, 42}
    assert kept[2] == kept[1] - {41}
    assert kept[3] == kept[2] - {46}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == kept[3]
    for doc in kept[3]:
        own = sorted((r for r in pieces if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in own) == own[0].doc_tokens and own[0].start == 0
