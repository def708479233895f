"""Source divergence audit: which terms set a source apart from its language, and how far sources lie from each other.

Two passes. The first counts exact document frequencies and keeps a language's terms. The second scans each text with an
Aho-Corasick automaton of kept terms padded by a delimiter and counts occurrences by source. The postings (source, count)
of a term are sparse; sums over all terms of a language are put together from them and from what absent terms have in
common, so no dense table of terms by sources is made.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_skewed, materialise, read_table, text_of

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Terms of all languages in the automata, and bytes of such a term: a worker's memory. Others are counted by a shuffle.
MOST_TERMS, TERM_BYTES = 150_000, 64
#: Entries that a task gathers before it hands its partial counts on.
FLUSH = 400_000
FLUSH_TOKENS = 3_000_000
#: Rows of a table of groups that is broadcast (some 100 bytes each); a larger one is joined by a shuffle.
MOST_GROUPS = 100_000
#: Pairs of sources that are compared at once.
PAIRS = 1_000_000
#: Bytes of a text to its terms: what ends a term (all ASCII but letters) is a space, A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, head boolean"


def padded(text: str) -> bytes:
    return b" " + text.encode("utf-8", "surrogatepass").translate(TABLE) + b" "


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): how many of a task's texts hold a term, in parts of bounded size."""
    found: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in found.items():
            terms = pa.array(list(c), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(c), np.int32))), terms, pa.array(c.values(), pa.int64())], ["lang", "term", "n"])
        found.clear()

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(set(padded(text).split()))
        if sum(map(len, found.values())) > FLUSH:
            yield from flush()
    yield from flush()


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, df) of the terms in at least so many of a language's documents. No column of docs is null."""
    # A task's rows differ already, so they are dealt before they are summed; a term has a few rows a task.
    part = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n long").repartition("lang", "term")
    return part.groupBy("lang", "term").agg(F.sum("n").alias("df")).filter(F.col("df") >= least_docs)


def split_vocabulary(kept: DataFrame, most_terms: int) -> tuple[dict[str, list[str]], DataFrame | None]:
    """Each language's most frequent short terms, ``most_terms`` at most in all, and the table of the others (None: no other).

    Whole classes of similar frequency (an eighth of a power of two) are taken while they fit.
    """
    level = F.floor(F.log2("df") * 8).cast("int")
    short = F.octet_length("term") <= TERM_BYTES
    sizes = kept.groupBy(F.when(short, level).otherwise(-1).alias("level")).count().collect()  # some 500 rows at most
    first, room = 1 << 30, most_terms
    for r in sorted((r for r in sizes if r["level"] >= 0), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        first = r["level"]
    head = short & (level >= first)
    terms: dict[str, list[str]] = {}
    for r in kept.filter(head).select("lang", "term").toLocalIterator():
        terms.setdefault(r["lang"], []).append(r["term"])
    rest = any(r["level"] < first for r in sizes)
    return terms, kept.filter(~head).select("lang", "term") if rest else None


NOWHERE = np.empty(0, np.int64)
#: What an automaton gives: where a term's closing delimiter is, and the term's number.
MATCH = np.dtype([("end", np.int64), ("term", np.int32)])


def unmatched(text: str, ends: np.ndarray) -> list[str]:
    """The terms of a padded text that don't end at one of ``ends``."""
    space = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
    open_ = space.copy()
    open_[1:] &= ~space[:-1]  # a space after a term
    open_[0] = False
    open_[ends] = False
    left = []
    for end in np.flatnonzero(open_).tolist():
        left.append(text[text.rfind(" ", 0, end) + 1 : end])
    return left


class Automata:
    """One automaton for each language over its terms between two delimiters; built once in a worker."""

    def __init__(self, terms: dict[str, list[str]]) -> None:
        import ahocorasick

        self.terms, self.by_lang = {}, {}
        for lang, words in terms.items():
            a = ahocorasick.Automaton()
            for i, w in enumerate(words):
                a.add_word(f" {w} ", i)
            a.make_automaton()
            self.by_lang[lang], self.terms[lang] = a, pa.array(words, pa.string())

    def count(self, batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, head) in parts; terms that no automaton holds only with ``rest``."""
        ids: dict[tuple[str, str], list[np.ndarray]] = {}
        other: dict[tuple[str, str], Counter] = {}
        seen = 0

        def rows(group, terms, n, head):
            zeros = pa.array(np.zeros(len(terms), np.int32))
            names = [pa.array([g], pa.string()).take(zeros) for g in group]
            return pa.RecordBatch.from_arrays([*names, terms, pa.array(n, pa.int64()), pa.array([head]).take(zeros)], ["lang", "source", "term", "n", "head"])

        def flush():
            for group, found in ids.items():
                n = np.bincount(np.concatenate(found))
                who = np.flatnonzero(n)
                yield rows(group, self.terms[group[0]].take(pa.array(who)), n[who], True)
            for group, c in other.items():
                yield rows(group, pa.array(list(c), pa.string()), list(c.values()), False)
            ids.clear()
            other.clear()

        for b in batches:
            for lang, source, text in zip(*(b[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                text, ends = padded(text).decode("utf-8", "surrogatepass"), NOWHERE
                if lang in self.by_lang:
                    found = np.fromiter(self.by_lang[lang].iter(text), MATCH)
                    if len(found):
                        ids.setdefault((lang, source), []).append(found["term"].copy())
                        ends = found["end"]
                        seen += len(found)
                if rest and (left := unmatched(text, ends)):
                    other.setdefault((lang, source), Counter()).update(left)
            if seen > FLUSH_TOKENS or sum(map(len, other.values())) > FLUSH:
                yield from flush()
                seen = 0
        yield from flush()


#: The automata of the last broadcast that this worker has seen.
_BUILT: dict[str, Automata] = {}


def postings(docs: DataFrame, kept: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms, by the automata and, for terms beyond them, by a join."""
    terms, rest = split_vocabulary(kept, most_terms)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    with_rest, number = rest is not None, uuid.uuid4().hex

    def count(batches):
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = Automata(shared.value)
        yield from _BUILT[number].count(batches, with_rest)

    keys = ["lang", "source", "term", "head"]
    sums = docs.select("lang", "source", "text").mapInArrow(count, COUNTS).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))
    if rest is None:
        return materialise(sums.drop("head"), "postings")
    sums = materialise(sums, "term-counts")
    left = sums.filter(~F.col("head")).join(rest, ["lang", "term"], "left_semi")
    out = materialise(sums.filter("head").unionByName(left).drop("head"), "postings")
    discard(sums)
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def scaled(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total) in longs by two steps of a long division; exact for totals below 9e13. No terms: null."""
    a = n * 10_000
    return F.when(total > 0, 1 + _div(a, total) * 100_000 + _div(a % total * 100_000, total))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) in longs."""
    return _div((p - q) * (p - q), q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what terms that two sources both have add beyond what each adds by itself.

    With f the divergence, p a source's value of the term and z its value of an absent term, a term in both adds
    f(p, p') - f(p, z') - f(z, p') + f(z, z'). Terms in equally many sources are taken together, in blocks of pairs.
    """
    for b in batches:
        lists = b["sources"]
        start = lists.offsets.to_numpy()
        size = np.diff(start)
        flat = lists.values
        names = pa.StructArray.from_arrays([b["lang"].take(pa.array(np.repeat(np.arange(len(size)), size))), flat.field("source").slice(start[0], size.sum())], ["lang", "source"])
        lang, source = (names.field(c).dictionary_encode() for c in ("lang", "source"))
        groups, code = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        p, z = (flat.field(c).slice(start[0], size.sum()).to_numpy() for c in ("p", "z"))
        start = start[:-1] - start[0]
        keys, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s in np.unique(size[size > 1]).tolist():
            rows, step = start[size == s], max(1, PAIRS // (s * s))
            for at in range(0, len(rows), step):
                here = rows[at : at + step, None] + np.arange(s)
                for g in range(0, s, max(1, PAIRS // s)):
                    one = here[:, g : g + max(1, PAIRS // s), None]
                    two = here[:, None, :]
                    v = _divergence(p[one], p[two]) - _divergence(p[one], z[two]) - _divergence(z[one], p[two]) + _divergence(z[one], z[two])
                    key, where = np.unique((code[one] * len(groups) + code[two]).ravel(), return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, where, v.ravel())
                    keys.append(key)
                    values.append(total)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate(values))
        one, two = groups[key // max(1, len(groups))], groups[key % max(1, len(groups))]
        other = one != two
        one, two, total = one[other], two[other], total[other]
        n = max(1, len(source.dictionary))
        columns = [lang.dictionary.take(pa.array(one // n)), source.dictionary.take(pa.array(one % n)), source.dictionary.take(pa.array(two % n)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def _with_groups(df: DataFrame, groups: DataFrame, n_groups: int, keys: list[str]) -> DataFrame:
    """df with its group's columns: by a broadcast if the groups are few, else by a join that splits hot groups."""
    if n_groups <= MOST_GROUPS:
        return df.join(F.broadcast(groups), keys)
    return join_skewed(df, groups, keys)


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how a source's use of terms departs from other sources and its language.

    A language's terms are those in at least ``least_docs`` of its documents. With V of them and N occurrences in a
    group (a source in a language, or the language), a term with n occurrences there has p = 1 + floor(1e9 (n + 1) /
    (N + V)). Rows of part ``pair`` hold the sum of floor((p - q)^2 / q) over all the language's terms against each other
    source's q; rows of part ``term`` hold it for the ``top`` terms that the source has and uses more than its language.

    A null text, language or source is an empty one, an empty source a source of its own. A group without terms, or in
    a language that keeps none, still has its pairs. Equal values rank by the item's UTF-8 bytes. Repeated rows count
    each time, ids are not read, texts of any length are read whole, other columns are ignored. An empty table gives an
    empty one. Sums are exact for up to 1e9 terms of a language.
    """
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], text_of(text).alias("text"))
    kept = materialise(vocabulary(d, least_docs), "vocabulary")
    post = postings(d, kept, most_terms)
    per_source = post.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = d.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v")])
    in_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = groups.join(in_lang, "lang").withColumn("z", scaled(F.lit(1).cast("long"), F.col("total") + F.col("v")))
    groups = materialise(groups, "groups")
    n_groups = groups.count()

    here = _with_groups(post, groups, n_groups, ["lang", "source"]).withColumn("p", scaled(F.col("n") + 1, F.col("total") + F.col("v")))
    row = F.struct("source", "n", "p", "z")
    lists = here.groupBy("lang", "term").agg(
        F.collect_list(row).alias("sources"), scaled(F.sum("n") + 1, F.max("lang_total") + F.max("v")).alias("q")
    )  # one entry a source of the language
    lists = materialise(lists, "term-sources")

    own = lists.select("lang", "term", "q", F.explode("sources").alias("s")).filter(F.col("s.p") > F.col("q"))
    own = own.select("lang", F.col("s.source").alias("source"), F.col("term").alias("item"), divergence(F.col("s.p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    # The filter on the row number is applied in each task before the shuffle, so a group hands on `top` rows a task.
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)

    # Pairs: V terms as if both lacked them, then what each source's terms add, by their distinct values, then what is shared.
    sides = lists.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("a"), F.col("s.p").alias("p"), F.col("s.z").alias("z"))
    sides = materialise(sides.agg(F.count("*").alias("k")), "values")
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), "v")
    other = F.broadcast(other) if n_groups <= MOST_GROUPS else other
    base = groups.select("lang", F.col("source").alias("a"), "z").join(other, "lang").filter("a <> b")
    base = base.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.when(F.col("v") > 0, F.col("v") * divergence(F.col("z"), F.col("zb"))).otherwise(0).alias("value"))
    p, z, zb, k = (F.col(c) for c in ("p", "z", "zb", "k"))
    met = sides.join(other, "lang").filter("a <> b")
    sums = F.struct(F.sum(k * (divergence(p, zb) - divergence(z, zb))).alias("out"), F.sum(k * (divergence(zb, p) - divergence(zb, z))).alias("back"))
    met = met.groupBy("lang", "a", "b").agg(sums.alias("s"))
    one = F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("s.out").alias("value"))
    two = F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("s.back").alias("value"))
    met = met.select("lang", F.explode(F.array(one, two)).alias("r")).select("lang", "r.*")
    both = lists.filter(F.size("sources") > 1).select("lang", "sources").mapInArrow(_shared_terms, "lang string, source string, item string, value long")
    pairs = base.unionByName(met).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))  # a row a source

    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for df, part in ((pairs, "pair"), (own, "term"))]
    discard(kept, post)
    return out[0].unionByName(out[1])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d)
      SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, v, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
      FROM dense JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
      FROM (SELECT lang, term, v, sum(n) AS n FROM p GROUP BY ALL)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
own AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM own)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
