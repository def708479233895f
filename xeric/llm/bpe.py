"""Byte-level BPE encoding and decoding with a transducer lexicon for frequent words."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, share_file, text_of
from .lexicon import Lexicon, compile_lexicon
from .merging import MergeTable, _gather, merge_all
from .token_counts import slices

MODEL = "byte_bpe_50k.json"
#: The lexicon holds so many of the most frequent words of all texts: it alters speed, not results.
LEXICON_WORDS = 40_000
#: Longer words, in characters, are left to the merges.
LEXICON_CHARS = 32
#: A task counts the words of about so many characters before it gives their counts out.
COUNTED_CHARS = 10_000_000
SLICE_CHARS = 3_000_000
WHITE = "\t\n\x0b\f\r \x85\xa0  -     　"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranges(kind: str) -> str:
    """The code points whose general category begins with ``kind``, as the inside of a character class."""
    out, begin = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == kind
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{i - 1:08x}")
            begin = None
    return "".join(out)


@cache
def word_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern, its property classes written out."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encodes and decodes batches of texts as the byte-level BPE model file at ``path`` says.

    ``lexicon`` is a compiled file; words that it lacks are merged exactly, all of a batch at once.
    """

    def __init__(self, path: str, lexicon: str | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["post_processor"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE model")
        letters, vocab = byte_letters(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rows = {}
        for r, (a, b) in enumerate(pairs):
            rows[vocab[a], vocab[b]] = (r, vocab[a + b])
        left, right = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        rank, merged = (np.array(x, np.int64) for x in zip(*rows.values(), strict=True))
        self.table = MergeTable(left, right, rank, merged)
        self.by_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.by_byte[b] = vocab[c]
        self.pattern = word_pattern()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lexicon = Lexicon(lexicon) if lexicon else None
        digits = [f"{i},".encode() for i in range(size)]
        self.digits = np.zeros((size, max(map(len, digits))), np.uint8)
        for i, d in enumerate(digits):
            self.digits[i, : len(d)] = np.frombuffer(d, np.uint8)

    def words(self, text: str) -> list[str]:
        if not self.split or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out = []
        for k, part in enumerate(self.split.split(text)):
            out += ["\0special\0" + part] if k % 2 else self.pattern.findall(part)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct words: by the lexicon, or else by merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        rank = self.lexicon.find(data, starts, lengths) if self.lexicon is not None and len(self.lexicon) else np.full(len(raw), -1)
        counts = np.zeros(len(raw), np.int64)
        old, new = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        if len(old):
            begin = self.lexicon.ends[rank[old]].astype(np.int64)
            counts[old] = self.lexicon.ends[rank[old] + 1] - begin
        special = {i: self.special[words[i][9:]] for i in new.tolist() if words[i].startswith("\0special\0")} if self.special else {}
        if special:
            new = np.array([i for i in new.tolist() if i not in special], np.int64)
        merged = np.zeros(0, np.int64)
        if len(new):
            merged, counts[new] = merge_all(self.table, self.by_byte[data[_gather(starts[new], lengths[new])]], lengths[new])
        for i in special:
            counts[i] = 1
        begin_out = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int64)
        if len(old):
            ids[_gather(begin_out[old], counts[old])] = self.lexicon.ids[_gather(begin, counts[old])]
        if len(new):
            ids[_gather(begin_out[new], counts[new])] = merged
        for i, v in special.items():
            ids[begin_out[i]] = v
        return ids, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and each text's count."""
        place: dict[str, int] = {}
        codes, per_text = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            found = self.words(t)
            per_text[k] = len(found)
            codes += [place.setdefault(w, len(place)) for w in found]
        if not codes:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        pool, counts = self.encode_words(list(place))
        at = np.array(codes, np.int64)
        del codes
        n = counts[at]
        ids = pool[_gather((np.cumsum(counts) - counts)[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(per_text)]
        return ids, np.diff(ends, prepend=0)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        flat = self.digits[ids].ravel()
        return flat[flat > 0].tobytes()[:-1]


def _word_counts(batches):
    """Batches of whole texts -> how often each word of up to LEXICON_CHARS characters is in them, in parts that add up.

    A space begins a word unless it is in a run of white space. So texts are cut at spaces, and only distinct pieces are
    cut into words. The counts are exact but for runs of white space, which are parted at their spaces.
    """
    import pyarrow as pa

    cut = word_pattern().findall
    first, later, read = Counter(), Counter(), 0

    def counted():
        found = Counter()
        for space, pieces in (("", first), (" ", later)):
            for piece, n in pieces.items():
                for w in cut(space + piece):
                    if len(w) <= LEXICON_CHARS:
                        found[w] += n
            pieces.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            pieces = t.split(" ")
            first[pieces[0]] += 1
            later.update(pieces[1:])
            read += len(t)
            if read >= COUNTED_CHARS:
                yield counted()
                read = 0
    yield counted()


def _compiled(path: str):
    """Batches of at most LEXICON_WORDS words -> their lexicon as one file's bytes."""

    def run(batches):
        import pyarrow as pa

        words = sorted(w for batch in batches for w in batch.column(0).to_pylist())
        ids, sizes = Codec(path).encode_words(words)
        ends = np.cumsum(sizes)
        data = compile_lexicon({w.encode("utf-8", "surrogatepass"): ids[e - s : e].tolist() for w, s, e in zip(words, sizes, ends, strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return run


def frequent_words_file(docs: DataFrame, path: str, n_words: int = LEXICON_WORDS, text_col: str = "text") -> bytes:
    """Compile a lexicon of the ``n_words`` most frequent words of all rows' whole texts.

    The texts are counted where they lie; one task compiles the words, whose number and length are bounded.
    """
    counts = docs.select(text_of(text_col).alias("body")).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(counts.orderBy(F.desc("n"), "word").limit(n_words).select("word"), "lexicon-words")
    made = words.repartition(1).mapInArrow(_compiled(path), "data binary").first()
    return bytes(made[0]) if made else compile_lexicon({})


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, lexicon: str) -> Codec:
    from pyspark import SparkFiles

    if (path, lexicon) not in _codecs:
        _codecs.clear()
        _codecs[path, lexicon] = Codec(path, SparkFiles.get(lexicon))
    return _codecs[path, lexicon]


def _encoded(path: str, lexicon: str, with_ids: bool, digests: bool):
    def run(batches):
        import pyarrow as pa

        codec = _codec(path, lexicon)
        for batch in batches:
            done = 0
            texts = batch.column(1).to_pylist()
            for part in slices(texts, SLICE_CHARS):
                ids, counts = codec.encode(part)
                ends = np.concatenate([[0], np.cumsum(counts)])
                head = [batch.column(0).slice(done, len(part)), pa.array(counts, pa.int64())]
                done += len(part)
                names = ["id", "n_tokens"]
                if with_ids:
                    head.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                if digests:
                    hashes, decoded = [], []
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        hashes.append(hashlib.sha256(codec.decimal(ids[a:b])).hexdigest())
                        decoded.append(hashlib.sha256(codec.decode(ids[a:b].tolist()).encode("utf-8")).hexdigest())
                    head += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(head, names=names)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = True, digests: bool = False, n_words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids`` of each row's whole text under the model file at ``path``.

    With ``digests`` also the SHA-256 of the decimal ids joined by commas and of the text decoded from the ids, as
    ``ids_sha256`` and ``decoded_sha256``; without ``with_ids`` the ids themselves are left out. Special tokens written in a text are that token, as the model
    says; none is added. Null text counts as empty and has no ids. Ids pass through, null and repeated ones too; each
    row is encoded by itself. Words of any length are merged exactly. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    name = share_file(spark, frequent_words_file(docs, path, n_words, text_col), "lexicon")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return rows.mapInArrow(_encoded(path, name, with_ids, digests), schema).withColumnRenamed("id", id_col)


def _decoded(path: str):
    def run(batches):
        import pyarrow as pa

        key = (path, "")
        if key not in _codecs:
            _codecs[key] = Codec(path)
        for batch in batches:
            texts = [_codecs[key].decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text``: the text of each row's ids. Null or no ids give the empty text."""
    r = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return r.mapInArrow(_decoded(path), f"id {dict(r.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), model_path(), with_ids=False, digests=True)
