"""Every registered query of the corpus operators, end to end on small tables, against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from plain import LOWER, SCHEMA, components, documents, drop_lines, near_components, sha, targets

from xeric.llm import bpe, catalog, licenses, minhash, mixing, secrets, token_counts, toxicity

ROWS = [*documents(), (9001, "x\nReleased under the MIT License.\ny", "en", "s1", 0, "", "", 0), (9003, 'so token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" here', "en", "s2", 0, "", "", 0)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(i % 5 == 0)) for i, r in enumerate(ROWS)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    r = np.random.default_rng(2)
    v = [(i, (c + r.normal(size=8) * 0.1).tolist(), 0) for i, c in enumerate(np.repeat(r.normal(size=(15, 8)), 4, axis=0))] + [(900, None, 0), (901, [0.0] * 8, 0)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def run(spark, sf, n):
    name = next(k for k in catalog.queries() if k.startswith(f"op{n}_"))
    rows = catalog.queries()[name](spark, sf).collect()
    key = "vec_id" if n == 10 else "doc_id"
    assert len({r[key] for r in rows}) == len(rows) == (62 if n == 10 else len(ROWS))
    return {r[key]: r for r in rows}


def test_op1(spark, sf):
    cue, templates = re.compile(licenses.CUES, re.IGNORECASE), licenses.Templates()
    for i, r in run(spark, sf, 1).items():
        n, hits = licenses.scan_text(next(x[1] for x in ROWS if x[0] == i) or "", templates, cue)
        assert (r["n_blocks"], r["n_licenses"], r["licenses"]) == (n, len(hits), ",".join(sorted({h[0] for h in hits})))
    assert run(spark, sf, 1)[9001]["licenses"] == "MIT"


def test_op2(spark, sf):
    groups = {}
    for r in ROWS:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    want = {i: (max(ids), len(ids), i == max(ids), sha(t)) for t, ids in groups.items() for i in ids}
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in run(spark, sf, 2).items()} == want


def test_op3(spark, sf):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.model_path())
    got = run(spark, sf, 3)
    for r in ROWS:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids
        assert (got[r[0]]["n_tokens"], got[r[0]]["ids_sha256"], got[r[0]]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False)))


def test_op4(spark, sf):
    want = near_components([(r[0], r[1]) for r in ROWS])
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in run(spark, sf, 4).items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_op5(spark, sf):
    for i, r in run(spark, sf, 5).items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= toxicity.THRESHOLD)


def test_op6(spark, sf):
    got, words = run(spark, sf, 6), {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS}
    sizes, taken = {}, {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + words[r[0]]
        taken[r[3]] = taken.get(r[3], 0) + got[r[0]]["taken"]
    want = targets(sizes)
    for r in ROWS:
        g = got[r[0]]
        assert (g["size"], g["source_size"]) == (words[r[0]], sizes[r[3]]) and abs(g["target"] - want[r[3]]) < 1e-6 and 0 <= g["taken"] <= 2 * g["size"]
    assert all(abs(taken[s] - t) <= mixing.BLOCK_TOKENS / 2 + 2 * (mixing.BLOCK_TOKENS - 1) + 1 for s, t in want.items())


def test_op7(spark, sf):
    want = {i: (a, b, sha(c)) for i, (a, b, c) in drop_lines([(r[0], r[1]) for r in ROWS]).items()}
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in run(spark, sf, 7).items()} == want


def test_op8(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    got = run(spark, sf, 8)
    for r in ROWS:
        n = len(model.encode(r[1] or ""))
        assert (got[r[0]]["n_bytes"], got[r[0]]["n_tokens"], got[r[0]]["over_limit"]) == (len((r[1] or "").encode()), n, n > 4096)


def test_op9(spark, sf):
    got = run(spark, sf, 9)
    assert got[9003]["n_secrets"] == 1 and got[9003]["secrets"].endswith(hashlib.sha256(b'"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"').hexdigest())
    assert sum(r["n_secrets"] > 0 for r in got.values()) <= 3


def test_op10(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows.items() if v is not None and any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    comp = components(list(rows), links)
    want = {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i in rows}
    assert len(links) > 30 and {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in run(spark, sf, 10).items()} == want


def test_op11_to_13_return_their_columns(spark, sf):
    spark.createDataFrame([(1, "http://a.example/", "<article><p>x  y</p></article>")], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{sf}/pages.parquet")
    columns = {
        "op11_page_texts": ["page_id", "url", "text", "n_chars"], "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
        "op13_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    }
    for name, want in columns.items():
        got = catalog.queries()[name](spark, sf)
        assert got.columns == want and got.count() > 0


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.queries()) == list(range(1, 14)) and minhash.THRESHOLD == 0.8 and secrets.THRESHOLD == 0.5
