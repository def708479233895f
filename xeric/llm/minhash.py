"""Near-duplicate removal: banded MinHash with sequential Bayesian verification."""

from __future__ import annotations

import re
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, WORD, attach, discard, join_skewed, materialise, read_table, text_of
from .components import connected_components
from .token_counts import slices

SHINGLE_WORDS = 5
BANDS, ROWS = 24, 5
#: Signature values, compared in batches of BATCH.
HASHES, BATCH = 128, 32
THRESHOLD = 0.8
#: Probability at which a pair at the threshold may be pruned before it is verified on its full sets.
MISS = 1e-6
#: Rows of a bucket that are compared with each other, or with as many others, in one group.
BLOCK = 384
#: Ids of candidates that are broadcast to pick their texts (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Shingles of large buckets whose frequency orders their sets (16 bytes each, sent to all tasks).
COMMON = 65_536
SLICE_CHARS = 3_000_000
REMEMBER = 300_000


def minimum_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair stays a candidate.

    With a uniform prior on the similarity s, the posterior after m of n matches is Beta(m + 1, n - m + 1), and
    P(s >= t | m, n) = P(Binomial(n + 1, t) <= m). A pair is pruned where that is below ``miss``.
    """
    out = {}
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out[n] = m
    return out


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes, and their signatures."""

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.size = words
        rng = np.random.Generator(np.random.PCG64(5))
        self.place = rng.integers(0, 2**63, (words + 1, words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.flip = rng.integers(0, 2**63, HASHES, dtype=np.uint64)
        self.times = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.find = re.compile(WORD).findall
        self.known: dict[str, int] = {}

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' sorted distinct shingle hashes end to end, and each one's count."""
        import xxhash

        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        split = [self.find(t.translate(LOWER_TABLE) if not t.isascii() else t.lower()) for t in texts]
        for words in split:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        n = np.fromiter(map(len, split), np.int64, len(split))
        get = known.__getitem__
        h = np.fromiter((get(w) for words in split for w in words), np.uint64, int(n.sum()))
        del split
        k = self.size
        shingles = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            shingles += h[i : len(h) - k + 1 + i] * self.place[k, i]
        starts = np.cumsum(n) - n
        parts = []
        for i, (a, c) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
            if c >= k:
                s = self.mix(shingles[a : a + c - k + 1])
                s.sort()
                parts.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif c:
                parts.append(self.mix(np.array([sum(int(h[a + j]) * int(self.place[c, j]) for j in range(c)) % 2**64], np.uint64)))
            else:
                parts.append(np.zeros(0, np.uint64))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts

    def signatures(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Minima of HASHES permuted hashes for each non-empty set."""
        starts = (np.cumsum(counts) - counts)[counts > 0]
        out = np.empty((len(starts), HASHES), np.uint64)
        step = 1 << 16
        # Sets are taken in runs of about ``step`` hashes, which stay in the cache.
        ends = np.append(starts[1:], len(flat))
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, side="right")))
            part, at = flat[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
            for j in range(HASHES):
                out[a:b, j] = np.minimum.reduceat((part ^ self.flip[j]) * self.times[j], at)
            a = b
        return out >> np.uint64(32)

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(signatures), BANDS), np.uint64)
        for b in range(BANDS):
            for r in range(ROWS):
                keys[:, b] += signatures[:, b * ROWS + r] * self.band[b, r]
            keys[:, b] = self.mix(keys[:, b] + np.uint64(b))
        return keys.view(np.int64)


_shinglers: dict[int, Shingler] = {}


def _shingler(words: int) -> Shingler:
    return _shinglers.setdefault(words, Shingler(words))


def _prints(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    out = np.zeros((2, len(counts)), np.uint64)
    full = counts > 0
    if full.any():
        at = (np.cumsum(counts) - counts)[full]
        out[0, full] = np.add.reduceat(Shingler.mix(flat + np.uint64(1)), at)
        out[1, full] = np.add.reduceat(Shingler.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def _signed(words: int):
    """Arrow batches of (id, body) -> (id, n, p1, p2, sig, bands)."""

    def run(batches):
        import pyarrow as pa

        s = _shingler(words)
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).to_pylist(), SLICE_CHARS):
                flat, counts = s.sets(part)
                p1, p2 = _prints(flat, counts)
                sig = s.signatures(flat, counts)
                full = counts > 0
                short = (sig & np.uint64(0xFFFF)).astype(np.uint16)
                width = np.where(full, 2 * HASHES, 0)
                binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.py_buffer(short.tobytes())])
                keys = s.bands(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(counts, pa.int64()), pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), binary, lists], names=["id", "n", "p1", "p2", "sig", "bands"])
                done += len(part)
        s.known = {}  # the worker lives on after the task

    return run


def _set_rows(words: int):
    """Arrow batches of (id, body) -> (id, p1, hashes): the whole sets."""

    def run(batches):
        import pyarrow as pa

        s = _shingler(words)
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).to_pylist(), SLICE_CHARS):
                flat, counts = s.sets(part)
                p1, _ = _prints(flat, counts)
                ends = np.concatenate([[0], np.cumsum(counts * 8)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(p1, pa.int64()), binary], names=["id", "p1", "hashes"])
                done += len(part)
        s.known = {}

    return run


def _survivors(need: dict[int, int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature arrays stay candidates, compared a batch of values at a time."""
    at = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in need.items():
        lo = n - BATCH
        matches[at] += (a[at, lo:n] == b[at, lo:n]).sum(axis=1)
        at = at[matches[at] >= least]
        if not len(at):
            break
    return at


def _pruned(need: dict[int, int], threshold: float):
    """Arrow batches of (a, b, na, nb, sa, sb) -> (a, b) that stay candidates."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
            keep = pa.array(_survivors(need, sa, sb), pa.int64())
            yield batch.select(["a", "b"]).take(keep)

    return run


def _verified(threshold_ppm: int):
    """Arrow batches of (a, b, ha, hb) -> (a, b) whose full sets are similar enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 1_000_000 * shared >= threshold_ppm * (len(u) + len(v) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _groups(batches, keys: int):
    """Arrow batches sorted by their first ``keys`` columns -> one table for each key; a key may span batches."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _candidates(need: dict[int, int], threshold: float, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block (or two) of a bucket, and the pairs of different components that stay candidates."""
    ids, comp, n, side = (table.column(c).to_numpy() for c in ("id", "component", "n", "side"))
    ok = np.triu(comp[:, None] != comp[None, :], 1)
    ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    if side.min() != side.max():
        ok &= side[:, None] != side[None, :]
    if not ok.any():
        return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
    matches = np.zeros(ok.shape, np.uint8)
    for n_seen, least in need.items():
        for v in range(n_seen - BATCH, n_seen):
            own = np.ascontiguousarray(sig[:, v])
            matches += own[:, None] == own[None, :]
        ok &= matches >= least
        if not ok.any():
            break
    i, j = np.nonzero(ok)
    return ids, i, j


def _open_rows(need: dict[int, int], threshold: float):
    """Sorted rows of blocks -> the rows that have a candidate in their block."""

    def run(batches):
        for table in _groups(batches, 3):
            _, i, j = _candidates(need, threshold, table)
            if len(i):
                yield from table.take(np.unique(np.concatenate([i, j]))).combine_chunks().to_batches()

    return run


def _block_links(need: dict[int, int], threshold: float):
    """Sorted rows of blocks with their full sets -> verified links, no more than join the block's components.

    Sets become bits over the hashes that two of them hold, so an intersection is a count of common bits.
    """

    def run(batches):
        import pyarrow as pa

        ppm = round(threshold * 1_000_000)
        for table in _groups(batches, 3):
            ids, i, j = _candidates(need, threshold, table)
            if not len(i):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count > 1)
            place = np.full(len(values), -1, np.int64)
            place[shared] = np.arange(len(shared))
            column, row = place[column], np.repeat(np.arange(len(sets)), sizes)
            row, column = row[column >= 0], column[column >= 0]
            width = -(-max(1, len(shared)) // 64)
            bits = np.zeros(len(sets) * width, np.uint64)
            np.bitwise_or.at(bits, row * width + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
            bits = bits.reshape(len(sets), width)
            links_a, links_b = [], []
            step = max(1, 4_000_000 // width)
            for a in range(0, len(i), step):
                x, y = i[a : a + step], j[a : a + step]
                both = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64)
                good = 1_000_000 * both >= ppm * (sizes[x] + sizes[y] - both)
                links_a.append(x[good])
                links_b.append(y[good])
            comp = table.column("component").to_numpy()
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    parent[c] = parent.get(parent[c], parent[c])
                    c = parent[c]
                return c

            out = []
            for x, y in zip(np.concatenate(links_a).tolist(), np.concatenate(links_b).tolist(), strict=True):
                u, v = root(int(comp[x])), root(int(comp[y]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    out.append((int(ids[x]), int(ids[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _full_sets(involved: DataFrame, nodes: DataFrame, base: DataFrame, words: int, name: str) -> DataFrame:
    """(id, hashes): the full shingle sets of the ids in ``involved``, made again from whole texts."""
    involved = materialise(involved, f"{name}-ids")
    if involved.count() <= BROADCAST_IDS:
        involved = F.broadcast(involved)
    who = nodes.select("id", "p1").join(involved, "id", "left_semi")
    sets = base.join(involved, "id", "left_semi").mapInArrow(_set_rows(words), "id long, p1 long, hashes binary")
    return materialise(sets.join(who, ["id", "p1"], "left_semi").dropDuplicates(["id"]).drop("p1"), f"{name}-sets")


def _confirm(pairs: DataFrame, nodes: DataFrame, base: DataFrame, words: int, threshold: float, name: str) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    involved = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _full_sets(involved, nodes, base, words, name)
    j = join_skewed(pairs, sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), ["a"])
    j = j.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    out = materialise(j.mapInArrow(_verified(round(threshold * 1_000_000)), "a long, b long"), name)
    discard(sets)
    return out


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, id, component) of keys that hold several components, with each key's rows as ``m``."""
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    return rows.join(materialise(keys.filter("lo <> hi").select("key", "m"), "minhash-mixed"), "key").select("key", "id", "component", "m")


def _hashes(batches):
    """Batches of (id, hashes) -> every hash of every set."""
    import pyarrow as pa

    for batch in batches:
        for x in batch.column("hashes").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], names=["h"])


def _prefixes(shared, threshold_ppm: int):
    """Batches of (id, hashes) -> (id, key): of each set the rarest hashes, one of which any set so similar holds too.

    Sets with a share t of their union in common share at least t n hashes of the n of either. So under one order of all
    hashes the first n - ceil(t n) + 1 of both have one in common.
    """

    def run(batches):
        import pyarrow as pa

        common, often = shared.value
        for batch in batches:
            ids, keys = [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                s = np.frombuffer(x, np.int64)
                k = len(s) + 1 + -threshold_ppm * len(s) // 1_000_000
                at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                rank = np.where(common[at] == s, often[at], 0) if len(common) else np.zeros(len(s))
                keys.append(s[np.lexsort((s, rank))[:k]])
                ids.append(np.full(len(keys[-1]), i))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(keys), pa.int64())], names=["id", "key"])

    return run


def _by_rare_shingles(rows: DataFrame, nodes: DataFrame, base: DataFrame, words: int, threshold: float) -> DataFrame:
    """Rows (key, id, component, m) of large mixed buckets, dealt anew by the rarest shingles of their sets.

    Where a bucket comes from a passage that many unlike documents share, its rows part here, as the passage's shingles
    are the common ones. No pair that reaches the threshold is parted, however the shingles are ordered; the order goes by
    how many of these rows hold one, as far as the COMMON most frequent ones tell.
    """
    rows = materialise(rows.select("id", "component").distinct(), "minhash-large")
    if rows.isEmpty():
        return rows.select(F.lit(0).cast("long").alias("key"), "id", "component", F.lit(0).cast("long").alias("m"))
    sets = _full_sets(rows.select("id"), nodes, base, words, "minhash-large")
    often = sets.mapInArrow(_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    often.sort()
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in often], np.int64), np.array([r[1] for r in often], np.int64)))
    keys = materialise(sets.mapInArrow(_prefixes(shared, round(threshold * 1_000_000)), "id long, key long"), "minhash-prefixes")
    return _mixed(materialise(keys.join(rows, "id").select("key", "id", "component"), "minhash-rare"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of ``threshold`` or more.

    Texts are lower-cased (A-Z only) and cut into words; a text of fewer than ``words`` words is one shingle. Equal sets
    are one class from the start. Signatures of 128 values are cut into 24 bands of 5; classes that share a band are
    candidates. First each meets the smallest id of its bucket only, so a group of any size gives a linear number of
    pairs. Pairs are pruned by the posterior of their similarity and the rest verified on full sets, made again from
    whole texts. Then only buckets that still hold several components are compared all through. Those of over ``BLOCK``
    rows are dealt anew by the rarest shingles of their full sets, which parts documents that share but a passage and
    loses no link. What remains is compared in blocks of bounded size: pruned in the same way, verified on full sets
    inside the block, and given out as no more links than join the block's components.
    No pair that shares a band is left out. A pair at the threshold 0.85 shares none with probability 8e-7 (0.8: 8e-5).

    Returns ``id_col, n_shingles, component_id, kept`` per row. Null, empty and blank texts have no shingle, link with
    nothing and stay. A row with a null id links with nothing. Rows that repeat an id are one document, that of their
    largest set; each is reported. Sets are compared as 64-bit hashes. An empty table gives an empty result; other
    columns are ignored, whatever their names. Ids are integers.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("body"))
    rows = materialise(base.mapInArrow(_signed(words), "id long, n long, p1 long, p2 long, sig binary, bands array<long>"), "minhash-rows")
    nodes = rows.filter("id is not null")
    total, distinct = nodes.agg(F.count("*"), F.countDistinct("id")).first()
    if total != distinct:
        nodes = nodes.groupBy("id").agg(F.max(F.struct("n", "p1", "p2", "sig", "bands")).alias("s")).select("id", "s.*")
        nodes = materialise(nodes, "minhash-nodes")
    need = minimum_matches(threshold, miss)

    full = nodes.filter("n > 0").select("id", "n", "p1", "p2")
    classes = full.groupBy("n", "p1", "p2").agg(F.min("id").alias("head"), F.count("*").alias("m")).filter("m > 1")
    classes = materialise(classes, "minhash-sets")
    member = join_skewed(full, classes, ["n", "p1", "p2"], "left", "m").select("id", F.coalesce("head", "id").alias("head"))
    member = materialise(member, "minhash-classes")
    heads = materialise(nodes.join(member.filter("id = head").select("id"), "id").select("id", "n", "p1", "sig", "bands"), "minhash-heads")
    bands = heads.select("id", F.explode("bands").alias("key"))
    buckets = materialise(bands.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("m")).filter("m > 1"), "minhash-keys")
    # Both sides are plain shuffles, whose large buckets Spark splits; salts would need a join that gives a row for each band.
    held = materialise(bands.join(buckets, "key").select("key", "id", "low", "m"), "minhash-buckets")

    sizes = heads.select("id", "n", "sig")
    stars = materialise(held.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "minhash-stars")
    j = join_skewed(stars, sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), ["a"])
    j = j.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    j = j.filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    pairs = materialise(j.mapInArrow(_pruned(need, threshold), "a long, b long"), "minhash-pairs")
    links = _confirm(pairs, nodes, base, words, threshold, "minhash-links")
    found = materialise(connected_components(links, "minhash-stars"), "minhash-found")

    # A bucket of two was compared in full by its star.
    labelled = held.filter("m > 2").select("key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = materialise(labelled, "minhash-labels")
    rest = _mixed(labelled)
    rest = rest.filter(F.col("m") <= BLOCK).unionByName(_by_rare_shingles(rest.filter(F.col("m") > BLOCK), nodes, base, words, threshold)).join(sizes, "id")
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    rest = rest.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("block").alias("side"), "id", "component", "n", "sig")
    key = ["key", "x", "y"]
    rest = rest.repartition(*key).sortWithinPartitions(*key).mapInArrow(_open_rows(need, threshold), rest.schema)
    rest = materialise(rest, "minhash-rest")
    if not rest.isEmpty():
        sets = _full_sets(rest.select("id").distinct(), nodes, base, words, "minhash-rest")
        rest = rest.join(sets, "id").select(*key, "side", "id", "component", "n", "sig", "hashes")
        more = rest.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_links(need, threshold), "a long, b long")
        links = links.unionAll(materialise(more, "minhash-more"))
        found = materialise(connected_components(links, "minhash-all"), "minhash-found")
        discard(sets)
    discard(classes, buckets, held, stars, pairs, labelled)

    label = member.join(found.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("component", "head").alias("component"))
    out = attach(rows.select("id", "n"), label, "id")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (F.col("id") == component)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), 0.85)
