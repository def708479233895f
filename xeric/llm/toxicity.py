"""Toxicity scores by a bidirectional GRU with attention pooling over word and character inputs."""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_stem, materialise, read_table, text_of
from .gru import Adam, BiGru, sigmoid
from .merging import _gather
from .token_counts import slices

#: Labelled rows that the classifier is fitted on at most: toxic ones, others.
TRAIN_TOXIC, TRAIN_OTHER = 600, 1200
#: Longest text, in characters, that is drawn for the fit, which bounds the sample in bytes too.
TRAIN_CHARS = 200_000
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, BUCKETS = 8, 4, 4096
FOLDS, EPOCHS, BATCH = 5, 8, 64
THRESHOLD = 0.3
#: A word or character sequence must be in so many training documents to have an evidence value.
LEAST_DOCS = 3
SLICE_CHARS = 2_000_000
REMEMBER = 120_000
WINDOWS_AT_ONCE = 4096
SEED = 3
word_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return word_runs(text.lower())


def characters(word: str) -> list[str]:
    """A word's character sequences: beginnings of 3 to 8 letters that go on, and endings of 3 and 4 letters."""
    n = len(word)
    return [word[:k] + "+" for k in range(3, min(8, n - 1) + 1)] + ["-" + word[-k:] for k in (3, 4) if n > k]


def evidence(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """For each sequence, how far its document frequency differs between n1 toxic and n0 other texts, in standard errors."""
    n1, n0 = max(1.0, float(n1)), max(1.0, float(n0))
    share = (toxic + other) / (n0 + n1)
    a = toxic + share
    b = other + 2 * (1 - share) * n0 / n1 * share + share
    with np.errstate(all="ignore"):
        z = (np.log(a / n1) - np.log(b / n0)) / np.sqrt(1 / a + 1 / b)
    return np.where((toxic + other >= LEAST_DOCS) & (np.abs(z) > 1), np.clip(z, -8, 12) / 4, 0.0)


class Characters:
    """Numbers for character sequences, so that each is hashed and looked up once however many words hold it."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's sequences (number 0 if it has none) end to end, and how many they are."""
        number = self.number
        flat, counts = array("q"), array("q")
        for w in words:
            found = characters(w) or [""]
            counts.append(len(found))
            flat.extend([number[g] if g in number else number.setdefault(g, len(number)) for g in found])
        return np.frombuffer(flat, np.int64).copy() if len(flat) else np.zeros(0, np.int64), np.array(counts, np.int64)


def buckets(names: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in names), np.int64, len(names))


class Inputs:
    """A word's vector: evidence of the word, largest and mean evidence of its character sequences, and embeddings."""

    WIDTH = 3 + 2 * EMBED

    def __init__(self, of_words: dict[str, float], of_chars: dict[str, float]) -> None:
        self.of_words, self.of_chars = of_words, of_chars

    def values(self, words: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of words, and of character sequences."""
        w, c = self.of_words, self.of_chars
        return np.fromiter((w.get(x, 0.0) for x in words), float, len(words)), np.fromiter((c.get(x, 0.0) for x in names), float, len(names))


def fixed_part(z_words: np.ndarray, z_chars: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at, z = np.cumsum(counts) - counts, z_chars[grams]
    return np.stack([z_words, np.maximum.reduceat(z, at), np.add.reduceat(z, at) / counts], axis=1)


def vectors(fixed: np.ndarray, own: np.ndarray, grams: np.ndarray, counts: np.ndarray, ew: np.ndarray, ec: np.ndarray) -> np.ndarray:
    """Word vectors; ``own`` and ``grams`` are rows of the embeddings ew and ec."""
    means = np.add.reduceat(ec[grams], np.cumsum(counts) - counts, axis=0) / counts[:, None]
    return np.concatenate([fixed, ew[own], means], axis=1)


def window_starts(n: int) -> np.ndarray:
    """Overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - WINDOW + 1, STRIDE)
    return s if s[-1] == n - WINDOW else np.append(s, n - WINDOW)


class Model:
    """The fitted network with its inputs and the calibration from a text's best window to a probability."""

    def __init__(self, inputs: Inputs, net: BiGru, ew: np.ndarray, ec: np.ndarray, slope: np.ndarray) -> None:
        self.inputs, self.net, self.ew, self.ec, self.slope = inputs, net, ew, ec, slope
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)
        self.chars = Characters()
        self.char_z, self.char_rows = np.zeros(0), np.zeros(0, np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "table", "chars", "char_z", "char_rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _learn(self, new: list[str]) -> None:
        """Add the gates of new words to the table; row 0 is the padding, which is a word without any evidence."""
        if not self.place:
            new = ["", *new]
        known = len(self.char_z)
        grams, counts = self.chars.of(new)
        names = list(itertools.islice(self.chars.number, known, None))
        z_words, z_chars = self.inputs.values(new, names)
        self.char_z, self.char_rows = np.append(self.char_z, z_chars), np.append(self.char_rows, buckets(names))
        x = vectors(fixed_part(z_words, self.char_z, grams, counts), buckets(new), self.char_rows[grams], counts, self.ew, self.ec)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.table = np.concatenate([self.table, self.net.gates(x).astype(np.float32)])

    def windows(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, and each text's number of windows."""
        if len(self.place) > REMEMBER:
            self._forget()
        new = {w: None for words in split for w in words if w not in self.place}
        if new or not self.place:
            self._learn(list(new))
        get = self.place.__getitem__
        counts = np.zeros(len(split), np.int64)
        full, at, flat, base = [], [], [], 0
        short: list[tuple[int, list[int]]] = []
        n_all = 0
        for i, words in enumerate(split):
            n = len(words)
            if n >= WINDOW:
                s = window_starts(n)
                flat += map(get, words)
                full.append(s + base)
                base += n
                counts[i] = len(s)
                at.append(np.arange(n_all, n_all + len(s)))
            else:
                short.append((n_all, [get(w) for w in words]))
                counts[i] = 1
            n_all += int(counts[i])
        out = np.zeros(n_all)
        if full:
            codes = np.array(flat, np.int64)
            begin, place = np.concatenate(full), np.concatenate(at)
            span = np.arange(WINDOW)
            for a in range(0, len(begin), WINDOWS_AT_ONCE):
                rows = codes[begin[a : a + WINDOWS_AT_ONCE, None] + span]
                out[place[a : a + WINDOWS_AT_ONCE]] = self.net.score(self.table, rows)
        for a in range(0, len(short), WINDOWS_AT_ONCE):
            part = short[a : a + WINDOWS_AT_ONCE]
            rows, mask = np.zeros((len(part), WINDOW), np.int64), np.zeros((len(part), WINDOW), np.float32)
            for k, (_, words) in enumerate(part):
                rows[k, : len(words)] = words
                mask[k, : max(1, len(words))] = 1
            out[[w for w, _ in part]] = self.net.score(self.table, rows, mask)
        return out, counts

    def tops(self, split: list[list[str]]) -> np.ndarray:
        """Each text's largest window logit and the logarithm of its number of windows."""
        logits, counts = self.windows(split)
        best = np.maximum.reduceat(logits, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)
        return np.stack([np.clip(best, -30, 30), np.log(counts), np.ones(len(counts))], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.tops([words_of(t) for t in texts]) @ self.slope)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    beta = np.array([0.5, 0.0, 0.0])
    ridge = np.diag([0.02, 1.0, 0.01])
    for _ in range(30):
        p = sigmoid(x @ beta)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    beta[0] = max(beta[0], 1e-3)
    return beta


def fit(texts: list[str], labels: list[int], other_weight: float = 1.0, seed: int = SEED) -> Model:
    """Train on whole texts, each labelled as a whole.

    Evidence values for a text come from the other folds' texts, so the network learns how far they hold for texts that
    they were not counted on. Each epoch all windows of all texts are scored and each text is represented by its best
    window, as a text is toxic if any window is. ``other_weight`` restores the share of the labels in the calibration
    if the two classes were sampled at different rates.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array(labels, float)
    # Texts become numbers of words at once; only the distinct words are kept as strings.
    place: dict[str, int] = {"": 0}
    codes = [np.fromiter((place[w] if w in place else place.setdefault(w, len(place)) for w in words_of(t)), np.int32) for t in texts]
    vocabulary = list(place)
    del place
    chars = Characters()
    sequences, counts = chars.of(vocabulary)
    names = list(chars.number)
    del chars
    begin = np.cumsum(counts) - counts
    own, grams = buckets(vocabulary), buckets(names)[sequences]
    fold = rng.permutation(len(texts)) % FOLDS
    of_words, of_chars = np.zeros((FOLDS, 2, len(vocabulary)), np.int32), np.zeros((FOLDS, 2, len(names)), np.int32)
    for k, label, c in zip(fold.tolist(), labels, codes, strict=True):
        held = np.unique(c)
        of_words[k, label, held] += 1
        of_chars[k, label, np.unique(sequences[_gather(begin[held], counts[held])])] += 1
    per_fold = np.array([[((fold == k) & (y == label)).sum() for label in range(2)] for k in range(FOLDS)])

    def values(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of words and sequences from all folds but one."""
        use = [k for k in range(FOLDS) if k != without and per_fold[k].sum()] or [without or 0]
        n1, n0 = int(per_fold[use, 1].sum()), int(per_fold[use, 0].sum())
        return tuple(evidence(of[use, 1].sum(0), of[use, 0].sum(0), n1, n0) for of in (of_words, of_chars))

    whole = values(None)
    inputs = Inputs(*({text[i]: float(z[i]) for i in np.flatnonzero(z).tolist()} for text, z in zip((vocabulary, names), whole, strict=True)))
    fixed = [fixed_part(*values(k), sequences, counts).astype(np.float32) for k in range(FOLDS)]
    del of_words, of_chars, whole, sequences, names, vocabulary
    net = BiGru(Inputs.WIDTH, HIDDEN, seed)
    ew, ec = rng.normal(0, 0.1, (BUCKETS, EMBED)), rng.normal(0, 0.1, (BUCKETS, EMBED))
    params = {**net.p, "ew": ew, "ec": ec}
    net.p = params
    starts = [window_starts(len(s)) for s in codes]

    def window(i: int, s: int) -> tuple[np.ndarray, int]:
        c = codes[i][s : s + WINDOW]
        return np.pad(c, (0, WINDOW - len(c))), max(1, len(c))

    def all_logits() -> list[np.ndarray]:
        out: list = [None] * len(codes)
        for k in range(FOLDS):
            mine = np.flatnonzero(fold == k)
            rows, mask = [], []
            for i in mine:
                if len(codes[i]) >= WINDOW:
                    rows.append(codes[i][starts[i][:, None] + np.arange(WINDOW)])
                    mask.append(np.ones((len(starts[i]), WINDOW), np.float32))
                else:
                    c, n = window(i, 0)
                    rows.append(c[None])
                    mask.append((np.arange(WINDOW) < n)[None].astype(np.float32))
            if not rows:
                continue
            rows, mask = np.concatenate(rows), np.concatenate(mask)
            frozen = BiGru(Inputs.WIDTH, HIDDEN)
            frozen.p = {n: v.astype(np.float32) for n, v in params.items()}
            table = frozen.gates(vectors(fixed[k], own, grams, counts, frozen.p["ew"], frozen.p["ec"]).astype(np.float32))
            logits = np.concatenate([frozen.score(table, rows[a : a + WINDOWS_AT_ONCE], mask[a : a + WINDOWS_AT_ONCE]) for a in range(0, len(rows), WINDOWS_AT_ONCE)])
            for i, part in zip(mine, np.split(logits, np.cumsum([len(starts[i]) for i in mine])[:-1]), strict=True):
                out[i] = part
        return out

    def first_guess() -> list[np.ndarray]:
        out = []
        for i, c in enumerate(codes):
            z = fixed[fold[i]][c].max(axis=1) if len(c) else np.zeros(1)
            out.append(np.array([z[s : s + WINDOW].max() for s in starts[i]]))
        return out

    adam = Adam(0.01)
    for epoch in range(EPOCHS):
        logits = first_guess() if not epoch else all_logits()
        picked = [(i, int(starts[i][int(z.argmax())])) for i, z in enumerate(logits)]
        # Of other texts also a window at random, so that common windows stay in view.
        picked += [(i, int(rng.choice(starts[i]))) for i in range(len(codes)) if not y[i]]
        picked = [picked[i] for i in rng.permutation(len(picked))]
        for a in range(0, len(picked), BATCH):
            part = picked[a : a + BATCH]
            got = [window(i, s) for i, s in part]
            c, n = np.stack([g[0] for g in got]), np.array([g[1] for g in got])
            mask = (np.arange(WINDOW) < n[:, None]).astype(float)
            f = np.stack([fixed[fold[i]][row] for (i, _), row in zip(part, c, strict=True)])
            words, at = np.unique(c, return_inverse=True)
            g = np.concatenate([grams[begin[w] : begin[w] + counts[w]] for w in words])
            means = np.add.reduceat(params["ec"][g], np.cumsum(counts[words]) - counts[words], axis=0) / counts[words][:, None]
            embedded = np.concatenate([params["ew"][own[words]], means], axis=1)[at].reshape(*c.shape, -1)
            x = np.concatenate([f, embedded], axis=2)
            target = y[[i for i, _ in part]]
            _, grad, dx = net.gradients(x, target, np.ones(len(part)), mask)
            d = np.zeros((len(words), 2 * EMBED))
            np.add.at(d, at.ravel(), dx[:, :, 3:].reshape(-1, 2 * EMBED))
            grad["ew"], grad["ec"] = np.zeros_like(params["ew"]), np.zeros_like(params["ec"])
            np.add.at(grad["ew"], own[words], d[:, :EMBED])
            np.add.at(grad["ec"], g, np.repeat(d[:, EMBED:] / counts[words][:, None], counts[words], axis=0))
            adam.step(params, grad)
    logits = all_logits()
    tops = np.stack([np.clip([z.max() for z in logits], -30, 30), np.log([len(z) for z in logits]), np.ones(len(logits))], axis=1)
    slope = calibrate(tops, y, np.where(y > 0, 1.0, other_weight))
    ew, ec = params.pop("ew"), params.pop("ec")
    return Model(inputs, net.as_float32(), ew, ec, slope)


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_other: int = TRAIN_OTHER, id_col: str = "doc_id", text_col: str = "text", most_chars: int = TRAIN_CHARS) -> tuple[DataFrame, float]:
    """A bounded sample (id, toxic, at, body) of labelled whole texts without the held-out rows; and other_weight.

    Labelled texts of up to ``most_chars`` characters are drawn by a hash of the id.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    usable = usable.filter(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) != 2).groupBy("id").agg(F.max("toxic").alias("toxic"))
    bodies = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    usable = usable.join(bodies.filter(F.length("body") <= most_chars).select("id").distinct(), "id")
    usable = materialise(usable.withColumn("at", F.xxhash64(F.lit(SEED), "id")), "toxicity-labels")
    n = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.filter(F.col("toxic") == k).orderBy("at", "id").limit(most) for k, most in ((1, most_toxic), (0, most_other))]
    chosen = materialise(parts[0].unionAll(parts[1]), "toxicity-sample")
    rows = bodies.filter(F.length("body") <= most_chars).join(F.broadcast(chosen), "id").groupBy("id", "toxic", "at").agg(F.max("body").alias("body"))
    rates = [min(n.get(k, 0), most) / max(1, n.get(k, 0)) for k, most in ((1, most_toxic), (0, most_other))]
    return rows, (rates[0] / rates[1] if rates[1] else 1.0)


def _fitted(other_weight: float):
    """Batches of the sample -> the fitted model, pickled (null without both labels), and the share of toxic texts."""

    def run(batches):
        import pyarrow as pa

        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("at", "id", "toxic", "body")), strict=True)]
        rows.sort(key=lambda r: r[:2])
        y, texts = [r[2] for r in rows], [r[3] for r in rows]
        del rows
        model = pickle.dumps(fit(texts, y, other_weight)) if 0 < sum(y) < len(y) else None
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary()), pa.array([sum(y) / max(1, len(y))], pa.float64())], names=["model", "share"])

    return run


def _scored(shared, text_at: int, name: str):
    """Arrow batches with their score as a last column; the others pass through."""

    def run(batches):
        import pyarrow as pa

        model = pickle.loads(shared.value)
        for batch in batches:
            out: list[float] = []
            for part in slices([t or "" for t in batch.column(text_at).to_pylist()], SLICE_CHARS):
                out += model.score(part).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_other: int = TRAIN_OTHER, id_col: str = "doc_id", text_col: str = "text", most_chars: int = TRAIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with the score of each whole text as a last column, ``_tox_score``; see ``toxicity``.

    The network is fitted in one task, on the bounded sample; the driver only hands its weights on. If a column's name
    begins with ``_tox_score``, the last column's has underscores added.
    """
    name = free_stem(docs.columns, "_tox_score")
    rows, other_weight = training_rows(docs, labels, most_toxic, most_other, id_col, text_col, most_chars)
    fitted = rows.repartition(1).mapInArrow(_fitted(other_weight), "model binary, share double").first()
    if fitted is None or fitted["model"] is None:
        return docs.withColumn(name, F.lit(fitted["share"] if fitted else 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(bytes(fitted["model"]))
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_scored(shared, docs.columns.index(text_col), name), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_toxic: int = TRAIN_TOXIC, most_other: int = TRAIN_OTHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each row's whole text: ``id_col, held_out, score, predicted``.

    The classifier is fitted on at most ``most_toxic`` and ``most_other`` labelled rows of up to ``TRAIN_CHARS``
    characters, chosen by a hash of the id among those whose crc32(id as text) mod 4 is not 2. Only the text is scored.
    Windows of 32 words begin at every 16th word and at the last 32, so each overlaps the next by half; all count, and
    the best one decides. Equal texts get equal scores. Null, empty and wordless texts are one window without any evidence and get its score.
    Labels that are null or neither 0 nor 1 are left out; an id labelled twice is toxic if any label says so. Without a
    toxic or without another label all scores are the share of toxic labels. Rows with null or repeated ids are scored
    like any other. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = scored(rows, labels, most_toxic, most_other, "id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2, F.lit(False))
    score = F.col("_tox_score")
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
