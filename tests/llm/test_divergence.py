"""The divergence audit against a plain version with Python's integers."""

import re
from collections import Counter, defaultdict

import pytest
from plain import LOWER, SCHEMA, documents

from xeric.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, top=200):
    docs = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    df = defaultdict(Counter)
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in df.items()}
    groups = defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(t for t in terms if t in kept.get(lang, ()))
    langs = defaultdict(Counter)
    for (lang, _), c in groups.items():
        langs[lang].update(c)
    p = lambda c, t, v: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)
    f = lambda a, b: (a - b) ** 2 // b
    out = set()
    for (lang, source), c in groups.items():
        v = kept.get(lang, set())
        pairs = [(o, sum(f(p(c, t, len(v)), p(d, t, len(v))) for t in v)) for (k, o), d in groups.items() if k == lang and o != source]
        own = [(t, f(p(c, t, len(v)), p(langs[lang], t, len(v)))) for t in v if c[t] and p(c, t, len(v)) > p(langs[lang], t, len(v))]
        for part, items, most in (("pair", pairs, None), ("term", own, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, t, n, i) for i, (t, n) in enumerate(items[:most], 1)}
    return out


ROWS = [(*r[:2], [None, "en", "fr"][i % 3] if i % 5 else "en", r[3] if i % 4 else f"z{i % 3}", *r[4:]) for i, r in enumerate(documents())]
ROWS += [(9000, None, "xx", None, 0, "", "", 0), (9001, "!!", "xx", "b", 0, "", "", 0), (9002, "È é_è x ́ Zz,zZ", "en", "only", 0, "", "", 0), (9002, "long " * 30000, "en", "only", 0, "", "", 0)]


@pytest.mark.parametrize("most_terms", [divergence.MOST_TERMS, 40, 0])
def test_equal_to_plain(spark, most_terms):
    """With all terms in the automata, with some of them, and with none."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = divergence.source_divergence(df, top=30, most_terms=most_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ROWS, 30)


def test_blocks_and_flushes(spark, monkeypatch):
    """Small parts and blocks of pairs change nothing, nor a join in place of the broadcast."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = plain(ROWS)
    for name, value in (("PAIRS", 2), ("FLUSH", 5), ("FLUSH_TOKENS", 7)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    assert {tuple(r) for r in divergence.source_divergence(df, most_terms=40).collect()} == want
    assert divergence.source_divergence(df.limit(0)).count() == 0
    assert len(divergence.OP12_SQL) > 100
