import re

from plain import SCHEMA, documents, drop_lines, near_components, targets

import corpus_pipeline
from xeric.llm import bpe, toxicity
from xeric.llm.common import materialise


def test_stages_take_effect(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    rows = documents()
    bad = [(5000 + i, f"{t} vileword nastyone vileword", "en", "s1", 0, "", "", 0) for i, (_, t, *_) in enumerate(rows[:40])]
    spark.createDataFrame(rows + bad, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in rows] + [(r[0], 1, 1) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), "test-stage")
        outs.append((name, docs))
    get = lambda k: {r["doc_id"]: r["text"] for r in outs[k][1].collect()}
    clean, lines, kept = get(0), get(1), get(2)
    assert sum(i >= 5000 for i in clean) <= 2 and sum(i < 5000 for i in clean) >= len(rows) - 3
    assert lines == {i: x[2] for i, x in drop_lines(list(clean.items())).items()}
    comps = near_components(list(lines.items()), percent=80)
    assert set(kept) == {i for i, (_, c) in comps.items() if c == i}
    mixed = outs[3][1]
    assert all(o.columns == spark.read.parquet(str(tmp_path / "documents.parquet")).columns for _, o in outs[:4])
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, took = {}, {}
    for r in outs[2][1].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    for r in mixed.collect():
        took[r["source"]] = took.get(r["source"], 0) + count(r["text"])
    for s, t in targets(sizes).items():
        # Half a block of 16 in the quota, and a last block of one word instead of 16 in both rounds.
        assert abs(took.get(s, 0) - t) <= 8 + 2 * 15 + 1
    codec = bpe.Codec(bpe.model_path())
    assert sorted(codec.decode(r["ids"]) for r in outs[4][1].collect()) == sorted(r["text"] for r in mixed.collect())


def test_run_gives_the_last_stage(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_from_80_percent_go(spark):
    words = [f"w{i}" for i in range(54)]
    apart = lambda k: " ".join([*words[:k], "changed", *words[k + 1 :]])
    # One changed word of 54 leaves 45 of 55 shingles: 0.818; two far apart leave 40 of 60: 0.667.
    two = apart(20).replace("w35 ", "other ")
    rows = [(1, " ".join(words), "en", "s", 0, "", "", 0), (2, apart(20), "en", "s", 0, "", "", 0), (3, two.replace("changed", "third"), "en", "s", 0, "", "", 0)]
    comps = near_components([(r[0], r[1]) for r in rows], percent=80)
    assert [c for _, c in comps.values()] == [1, 1, 3]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in out.collect()} == {1, 3}


def test_lexicon_of_the_last_stage_is_counted_over_all_rows(spark, monkeypatch, tmp_path):
    import numpy as np

    from xeric.llm.lexicon import Lexicon

    sent, share = [], bpe.share_file
    monkeypatch.setattr(bpe, "share_file", lambda spark, data, stem: sent.append(data) or share(spark, data, stem))
    words = ["".join("bcdfghjklm"[int(c)] for c in f"{i:04d}") for i in range(3000)]
    docs = spark.createDataFrame([(i, w, "en", "s", 0, "", "", 0) for i, w in enumerate(words)], SCHEMA).repartition(3)
    corpus_pipeline.encode(spark, docs, "")
    (tmp_path / "lexicon").write_bytes(sent[0])
    n = np.array([len(w) for w in words])
    found = Lexicon(str(tmp_path / "lexicon")).find(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(n) - n, n)
    assert (found >= 0).all()
