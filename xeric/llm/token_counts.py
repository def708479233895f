"""Token counts by rank-synchronous merging of batched pre-tokens."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .merging import MergeTable, merge_all

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
#: Characters of text that are cut and merged together.
SLICE_CHARS = 4_000_000
#: Pre-tokens whose counts a worker remembers.
REMEMBER = 400_000
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts tokens as a byte-fallback BPE piece model does, from its pieces and scores.

    A text gets a space in front and its spaces become U+2581. No piece has another character before U+2581 and none
    has \\n, so text is cut there without changing a merge (checked when the model is read; a model of another kind is
    refused). Distinct pre-tokens of a slice are held as one ragged array of symbols; all apply their best pair at
    once, round by round. What survives counts 1, or its UTF-8 bytes if it is a character outside the vocabulary.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces) or sum(model.is_byte(i) for i in range(n)) != 256 or model.encode("ﬁÅ", out_type=str)[-2:] != ["ﬁ", "Å"]:
            raise ValueError(f"{path}: not a piece model without normalisation that can be cut at spaces and \\n")
        chars = sorted({c for p in pieces for c in p})
        # Symbols: characters of pieces first, then longer pieces; other characters get the last number.
        self.symbol = {c: i for i, c in enumerate(chars)}
        for p in pieces:
            self.symbol.setdefault(p, len(self.symbol))
        self.other = len(self.symbol)
        self.by_char = np.full(0x110000, self.other, np.int32)
        self.by_char[[ord(c) for c in chars]] = [self.symbol[c] for c in chars]
        levels = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rows = [(self.symbol[p[:k]], self.symbol[p[k:]], levels[s], self.symbol[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.table = MergeTable(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
        # Tokens of a surviving symbol: a piece is one; a character that is no piece is its bytes.
        self.cost = np.ones(self.other + 1, np.int64)
        for c in chars:
            if c not in pieces:
                self.cost[self.symbol[c]] = len(c.encode())
        self.cut = re.compile(" +[^ \n]*|\n|[^ \n]+")
        self.known: dict[str, int] = {}

    def _fresh(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        flat = "".join(words).replace(" ", SPACE)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.by_char[codes]
        kept, counts = merge_all(self.table, symbols, lengths)
        who = np.repeat(np.arange(len(words)), counts)
        total = np.bincount(who, self.cost[kept].astype(float), len(words)).astype(np.int64)
        odd = np.flatnonzero(symbols == self.other)
        if len(odd):
            width = 1 + (codes[odd] > 0x7F) + (codes[odd] > 0x7FF) + (codes[odd] > 0xFFFF)
            owner = np.searchsorted(np.cumsum(lengths), odd, side="right")
            np.add.at(total, owner, width.astype(np.int64) - 1)
        return total

    def count(self, texts: list[str]) -> list[int]:
        cut, known = self.cut.findall, self.known
        if len(known) > REMEMBER:
            known.clear()
        split = [cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh = list({w: None for words in split for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self._fresh(fresh).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, words)) for words in split]


_counters: dict[str, PieceCounter] = {}


def _counts(path: str, limit: int):
    def run(batches):
        import pyarrow as pa

        if path not in _counters:
            _counters[path] = PieceCounter(path)
        counter = _counters[path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[int] = []
            for part in slices(texts, SLICE_CHARS):
                out += counter.count(part)
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            n = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pa.compute.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def slices(texts: list[str], chars: int):
    """Consecutive parts of about ``chars`` characters each, or one text."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of each row's whole text under the piece model at ``path``.

    Null text counts as empty: 0 bytes, 0 tokens. Ids pass through, null and repeated ones too; each row is counted by
    itself. An empty table gives an empty result. Pre-tokens of any length are merged exactly, those of over 256
    symbols by a heap. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    out = rows.mapInArrow(_counts(path, limit), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), model_path())
