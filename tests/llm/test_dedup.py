import numpy as np
import pytest
from plain import LOWER, SCHEMA, documents, drop_lines, near_components, sha

from xeric.llm import exact_dedup, line_dedup, minhash
from xeric.llm.components import connected_components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5)


def test_exact_dedup_matches_plain(docs):
    groups = {}
    for r in documents():
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(documents())
    for ids in groups.values():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))


def test_exact_dedup_by_shuffle_is_the_same(docs):
    a = exact_dedup.exact_dedup(docs, broadcast_keys=0).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))


def test_exact_dedup_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).collect() == []
    again = spark.createDataFrame([(1, "Ab"), (1, "aB"), (None, "ab"), (2, "x"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(again).collect()), key=str)
    assert got.count((1, 1, 3, True)) == 2 and len(got) == 5


def test_long_shared_prefix_is_read_in_full(spark):
    d = spark.createDataFrame([(1, "p" * 500 + "a"), (2, "p" * 500 + "b"), (3, "P" * 500 + "a")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(d).collect()} == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_matches_plain(docs, batches):
    want = drop_lines([(r[0], r[1]) for r in documents()])
    assert any(x[1] for x in want.values())
    out = line_dedup.line_dedup(docs, batches=batches)
    assert out.columns == [*docs.columns, "_ld_lines", "_ld_dropped"]
    got = {r["doc_id"]: (r["_ld_lines"], r["_ld_dropped"], r["text"]) for r in out.collect()}
    assert got == want


def test_line_dedup_odd_tables(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    line = "z" * 40
    d = spark.createDataFrame([(None, line), (7, line), (7, "q\n" + line), (1, line), (2, line), (3, line), (4, line + "\n")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.line_dedup(d).collect())
    assert got == sorted([(0, ""), (7, line), (7, "q\n" + line), (1, ""), (2, ""), (3, ""), (4, "")])


def test_minhash_matches_plain(docs):
    rows = [(r[0], r[1]) for r in documents()]
    want = near_components(rows)
    assert len({c for _, c in want.values()}) < len(want) - 5
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 0.85).collect()}
    assert got == want


def test_minhash_group_of_unlike_copies(spark, monkeypatch):
    """A group whose copies link in part: stars alone don't find all links; blocks do."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in r.sample(range(150), r.randint(0, 6)):
            words[k] = f"n{i}_{k}"
        rows.append((i, " ".join(words)))
    want = near_components(rows)
    assert 3 < len({c for _, c in want.values()}) < 55
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == want


def test_minhash_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A B"), (3, None), (4, " ")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d).collect())
    assert got == [(0, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_pruning_keeps_what_may_reach_the_threshold():
    need = minhash.minimum_matches(0.85, 1e-6)
    assert list(need) == [32, 64, 96, 128] and all(0 < m < 0.85 * n for n, m in need.items())
    assert minhash.minimum_matches(0.85, 1e-2)[128] > need[128]


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_digests_of_registered_queries(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in got.items()} == {i: (a, b, sha(c)) for i, (a, b, c) in drop_lines([(r[0], r[1]) for r in rows]).items()}
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.op2_exact_dedup(spark, str(tmp_path)).collect()}
    assert got == {r[0]: sha((r[1] or "").translate(LOWER)) for r in rows}


def test_exact_dedup_keeps_rows_of_one_id_apart(spark):
    rows = [(1, "aa"), (1, "bb"), (2, "aa"), (None, "bb2"), (None, "aa"), (3, "cc")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(d, digests=True).collect()), key=str)
    want = [(1, 2, 3, False, sha("aa")), (1, 1, 1, True, sha("bb")), (2, 2, 3, True, sha("aa")), (None, None, 1, True, sha("bb2")), (None, 2, 3, False, sha("aa")), (3, 3, 1, True, sha("cc"))]
    assert got == sorted(want, key=str)


def test_line_dedup_with_clashing_columns(spark):
    line = "y" * 45
    rows = [(i, line, i, i + 1, i + 2, i + 3) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _ld_gone int, _ld_id int, _LD_lines int, _ld_dropped int")
    out = line_dedup.line_dedup(d)
    assert out.columns == [*d.columns, "_ld___lines", "_ld___dropped"]
    got = sorted(map(tuple, out.collect()))
    assert got == [(i, line if i == 5 else "", i, i + 1, i + 2, i + 3, 1, int(i < 5)) for i in range(6)]


def test_line_runs_are_merged_without_shuffles_or_sorts(spark):
    runs = line_dedup.LineRuns(spark, fan_in=3)
    for k in range(2):
        runs.add(spark.createDataFrame([(i, i, k) for i in range(k, 50)], "h1 long, h2 long, id long"))
    with line_dedup.sorted_buckets(spark):
        plan = runs._merge(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = {r["h1"]: (r["n_docs"], r["keeper"], r["first_seen"]) for r in runs._merge(runs.runs()).collect()}
    assert got == {i: (1 + (i > 0), 0, True) for i in range(50)}
    runs.drop(runs.runs())


def test_minhash_parts_documents_that_share_a_passage(spark, monkeypatch):
    """A large bucket of unlike documents is dealt by rare shingles: few rows meet, and no link is lost."""
    import random

    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"n{i // 2}_{k}" for k in range(30)]
        if i % 2:
            own[-1] = "changed"
        rows.append((i, " ".join(passage + own)))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    dealt = []
    whole = minhash._by_rare_shingles
    monkeypatch.setattr(minhash, "_by_rare_shingles", lambda *a: dealt.append((a[0].count(), (out := whole(*a)).count())) or out)
    want = near_components(rows)
    assert len({c for _, c in want.values()}) == 60
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == want
    assert dealt[0][0] > 100 and dealt[0][1] < dealt[0][0] / 4


def test_prefixes_of_similar_sets_meet():
    import pyarrow as pa

    class Shared:
        value = (np.array([3, 7], np.int64), np.array([9, 2], np.int64))

    r = np.random.default_rng(2)
    base = np.arange(40)
    sets = [np.sort(np.concatenate([r.choice(base, 34, replace=False), 100 + r.choice(9, 3, replace=False)])).astype(np.int64) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"])
    keys = {}
    for out in minhash._prefixes(Shared, 800_000)([batch]):
        for i, k in zip(out.column("id").to_pylist(), out.column("key").to_pylist(), strict=True):
            keys.setdefault(i, set()).add(k)
    for i in range(60):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 5 * len(a & b) >= 4 * len(a | b):
                assert keys[i] & keys[j]


def rows_made_by_joins(spark, key, run):
    """The result of ``run``, and the rows that each kind of join on ``key`` made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    ids = lambda: [x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))]
    bus.waitUntilEmpty(30_000)
    before, made = set(ids()), {}
    out = run()
    bus.waitUntilEmpty(30_000)
    for i in set(ids()) - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and f"[{key}#" in node.desc():
                kind = node.desc().split("]")[-1].split(",")[1].strip()
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and (n := values.get(m.accumulatorId())).isDefined():
                        made[kind] = made.get(kind, 0) + int(n.get().replace(",", ""))
    return out, made


def test_minhash_joins_make_no_row_for_a_lone_band(spark):
    """One large group of near copies doesn't send the bands of all other documents through a join that keeps them."""
    base, lone = [f"w{i}" for i in range(150)], 400
    rows = [(i, " ".join([*base[: 3 * i + 5], f"n{i}", *base[3 * i + 6 :]])) for i in range(40)]
    rows += [(100 + i, " ".join(f"u{i}_{k}" for k in range(8))) for i in range(lone)]
    want = near_components(rows)
    assert len({c for _, c in want.values()}) == lone + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, made = rows_made_by_joins(spark, "key", lambda: minhash.near_duplicates(docs, 0.85).collect())
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    assert 0 < sum(made.values()) < minhash.BANDS * lone / 2, made
