import random
import re

import numpy as np
import pytest
from plain import SCHEMA, documents, sha

from xeric.llm import bpe, token_counts
from xeric.llm.lexicon import Lexicon, compile_lexicon
from xeric.llm.merging import MergeTable, merge_all


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(4)


def odd_texts(seed=2, n=400):
    r = random.Random(seed)
    return ["", " ", "a  b", "<s>hi</s>", "a\nb\t c", "▁x ▁▁ y", "\x00a", "x" * 3000, "日本語🎉" * 80, "<|endoftext|>", "a <|endoftext|><|endoftext|> it's 'S ² x\x1cy", "\x85 a b"] + [
        "".join(r.choice("ab c\n\ré日🎉th e▁'sd1²-　\xa0") for _ in range(r.randint(0, 60))) for _ in range(n)
    ]


def test_counts_equal_the_library():
    import sentencepiece

    texts = odd_texts() + [r[1] or "" for r in documents()]
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    assert token_counts.PieceCounter(token_counts.model_path()).count(texts) == [len(x) for x in model.encode(texts)]


def test_count_operator(docs, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(docs, token_counts.model_path(), limit=100).collect()}
    want = {r[0]: (len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 100) for r in documents()}
    assert got == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), token_counts.model_path()).collect() == []
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(twice, token_counts.model_path()).collect()) == [0, 1, 1]


def test_merges_of_long_and_short_sequences_agree():
    r = np.random.default_rng(1)
    pairs = [(a, b) for a in range(6) for b in range(6)]
    order = r.permutation(len(pairs))
    table = MergeTable(*(np.array(x, np.int64) for x in zip(*[(*pairs[k], i // 2, 6 + i % 5) for i, k in enumerate(order[:20])], strict=True)))
    sym = r.integers(0, 6, 5000)
    from xeric.llm import merging

    whole, counts = merge_all(table, sym, np.array([250] * 20))
    old, merging.LONG = merging.LONG, 10
    try:
        again, other = merge_all(table, sym, np.array([250] * 20))
    finally:
        merging.LONG = old
    assert (whole == again).all() and (counts == other).all()


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode() for _ in range(800)}
    entries = {w: [r.randrange(50000) for _ in range(r.randint(1, 4))] for w in words}
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon(entries))
    lexicon = Lexicon(str(path))
    asked = sorted(words) + [w + b"x" for w in words] + [b"", b"zz"]
    data, n = np.frombuffer(b"".join(asked), np.uint8), np.array([len(w) for w in asked])
    found = lexicon.find(data, np.cumsum(n) - n, n)
    for w, k in zip(asked, found, strict=True):
        assert (k >= 0) == (w in entries)
        if k >= 0:
            assert lexicon.ids[lexicon.ends[k] : lexicon.ends[k + 1]].tolist() == entries[w]
    assert len(lexicon.base) < sum(map(len, words))  # suffixes are shared


def test_encoding_equals_the_library_and_comes_back(docs, spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.model_path())
    got = {r["doc_id"]: r for r in bpe.encode(docs, bpe.model_path(), digests=True).collect()}
    for r in documents():
        ids = model.encode(r[1] or "", add_special_tokens=False).ids
        g = got[r[0]]
        assert g["ids"] == ids and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == sha(",".join(map(str, ids))) and g["decoded_sha256"] == sha(model.decode(ids, skip_special_tokens=False))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, bpe.model_path()), bpe.model_path()).collect()}
    assert back == {r[0]: r[1] or "" for r in documents()}
    assert bpe.encode(spark.createDataFrame([], SCHEMA), bpe.model_path()).collect() == []


def test_codec_without_and_with_lexicon(tmp_path):
    from tokenizers import Tokenizer

    texts = odd_texts(5)
    model = Tokenizer.from_file(bpe.model_path())
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    plain = bpe.Codec(bpe.model_path())
    words = list(dict.fromkeys(w for t in texts for w in bpe.word_pattern().findall(t)))[:200]
    ids, n = plain.encode_words(words)
    ends = np.cumsum(n)
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon({w.encode(): ids[e - k : e].tolist() for w, k, e in zip(words, n, ends, strict=True)}))
    for codec in (plain, bpe.Codec(bpe.model_path(), str(path))):
        flat, counts = codec.encode(texts)
        ends = np.cumsum(counts)
        assert [flat[e - k : e].tolist() for k, e in zip(counts, ends, strict=True)] == want


def test_lexicon_holds_the_most_frequent_words_of_all_rows(spark, tmp_path):
    from collections import Counter

    # Each word is frequent in one row of 3000 alone, so a part of the rows can't tell.
    names = ["".join("bcdfghjklm"[int(c)] for c in f"{i:04d}") for i in range(3000)]
    rows = [(i, f"it's {w} {w}, {w}\n{w}" if i % 300 == 0 else f"it's {w}") for i, w in enumerate(names)] + [(3000, None)]
    cut = bpe.word_pattern().findall
    count = Counter(w for _, t in rows for w in cut(t or ""))
    want = {w for w, n in count.items() if n > 1}
    assert len(want) == 14  # it, 's, comma, new line and a word with its space of each of ten rows
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.frequent_words_file(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bpe.model_path(), n_words=len(want)))
    lexicon = Lexicon(str(path))
    asked = [w.encode() for w in count]
    n = np.array([len(w) for w in asked])
    found = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(n) - n, n)
    assert {w for w, k in zip(count, found, strict=True) if k >= 0} == want


def test_words_are_counted_as_the_pattern_cuts_them(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    texts = odd_texts(7)
    white = re.compile(f"[{bpe.WHITE}]+").fullmatch
    cut = bpe.word_pattern().findall
    want = Counter(w for t in texts for w in cut(t) if len(w) <= bpe.LEXICON_CHARS and not white(w))
    for held in (1, 500, 10**9):
        monkeypatch.setattr(bpe, "COUNTED_CHARS", held)
        got = Counter()
        for b in bpe._word_counts([pa.RecordBatch.from_arrays([pa.array(texts[k::3])], names=["body"]) for k in range(3)]):
            got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        assert {w: n for w, n in got.items() if not white(w)} == want
