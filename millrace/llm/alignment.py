"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in the whole corpus.

A text, with a space in front, is cut by a byte-level tokenizer (A) and by a piece tokenizer that adds that space itself (B). Groups are
what lies between byte offsets at which tokens of both end. They come from divide and conquer: a common end near an interval's middle,
found by bisection in the other side's ends, splits it in two, and an interval without one is a leaf, a group. All open
intervals of a block of documents are searched and split together, level by level.

A pair of ids counts the links (overlapping tokens) that hold it. The most frequent pairs, a bounded number, are broadcast;
links of all other pairs meet their counts in a shuffle, in which no pair is frequent.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged
from .tokens import _LETTERS, ChunkEncoder, _Chunks, slices

#: So many of the most frequent pairs at most are broadcast, some 25 bytes each.
MOST_PAIRS = 500_000

#: Stretches that pieces of the model do not reach over: a line feed, a word with the spaces before it, spaces alone.
_UNITS = re.compile(r"\n| *[^ \n]+| +")


class ByteEncoder(ChunkEncoder):
    """Ids of texts by a byte-level tokenizer, packed; strings of special tokens are ordinary text. bytes: those of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        letters = {ord(c): b for b, c in _LETTERS.items()}
        self.bytes = [(self.tokenizer.id_to_token(i) or "").translate(letters).encode("latin-1", "replace") for i in range(self.tokenizer.get_vocab_size())]

    def same(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of ids are raw; without a normalizer, the bytes of any text come back."""
        return self.kind == "spaced" or b"".join([self.bytes[i] for i in ids.tolist()]) == raw


class PieceEncoder:
    """Ids of texts by a sentencepiece model, packed; each distinct unit is encoded once. bytes: those of each id.

    Models with pieces that reach over units, or that do more than put a space in front, encode whole texts.
    """

    def __init__(self, path: str, cache_entries: int = 600_000):
        import sentencepiece

        self.model, self.limit, self.units = sentencepiece.SentencePieceProcessor(model_file=path), cache_entries, _Chunks(self._unit)
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.dtype = np.dtype("<u2" if len(pieces) < 1 << 16 else "<u4")
        apart = all("\n" not in p and "▁" not in p.lstrip("▁") for p in pieces)
        self.whole = not apart or any(self._joined(self.model.encode(t)) != b" " + t.encode() for t in ("\n", " \n", "a  b \n c"))

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def _unit(self, unit: str) -> bytes:
        """The model puts a space in front: it is that of the unit, or it is cut off again with a line feed."""
        encode = self.model.encode
        if not unit.strip(" "):
            ids = encode(unit[1:] + "\n")[:-1]
        elif unit[0] == " ":
            ids = encode(unit[1:])
        else:
            ids = encode(unit)[1:] if unit == "\n" else encode("\n" + unit)[2:]
        return np.array(ids if self._joined(ids) == unit.encode() else [len(self.bytes)], self.dtype).tobytes()

    def same(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of ids are raw. Units that are not given back have an id beyond all others."""
        return self._joined(ids.tolist()) == raw if self.whole else not len(ids) or int(ids.max()) < len(self.bytes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each of which gets a space in front; empty ones have none."""
        if self.whole:
            return [np.array(self.model.encode(t), self.dtype).tobytes() for t in texts]
        if len(self.units) > self.limit:
            self.units.clear()
        get = self.units.__getitem__
        return [b"".join(map(get, _UNITS.findall(" " + t))) if t else b"" for t in texts]


_encoders: dict[tuple[str, str], tuple[ByteEncoder, PieceEncoder]] = {}


def _encoder_pair(a: str, b: str) -> tuple[ByteEncoder, PieceEncoder]:
    if (a, b) not in _encoders:
        _encoders[a, b] = ByteEncoder(a), PieceEncoder(b)
    return _encoders[a, b]


def _cuts(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """For each open interval (rows a0, a1, b0, b1 of token numbers) the token of A nearest to its middle that ends inside it where one of B does; -1: none.

    Candidates around the middle are looked up in b by bisection, in windows that grow until one is common or none is left.
    """
    a0, last = open_[0], open_[1] - 1  # the end of the last token is the interval's own
    middle, out, width = (a0 + last) // 2, np.full(len(a0), -1), 0
    live = np.flatnonzero((last > a0) & (open_[3] - open_[2] > 1))
    middle = np.minimum(middle, last - 1)
    while len(live):
        low, high = np.maximum(a0[live], middle[live] - width), np.minimum(last[live], middle[live] + width + 1)
        n = high - low
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(starts - low, n)
        ends = a[at]
        common = b[np.searchsorted(b, ends)] == ends
        off = at - np.repeat(middle[live], n)
        rank = np.minimum.reduceat(np.where(common, 2 * np.abs(off) + (off < 0), np.iinfo(np.int64).max), starts)
        hit = rank < np.iinfo(np.int64).max
        out[live[hit]] = middle[live[hit]] + np.where(rank[hit] % 2, -(rank[hit] // 2), rank[hit] // 2)
        live = live[~hit & ((low > a0[live]) | (high < last[live]))]
        width = 4 * width + 2
    return out


def leaf_groups(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Groups of all documents in order, as rows a0, a1, b0, b1 of token numbers (a1 and b1 excluded).

    a and b are the byte offsets at which tokens end, ascending over all documents in a row; n_a and n_b count the tokens of each document, which
    covers the same bytes in both, or has none.
    """
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    open_, leaves = np.stack([to_a - n_a, to_a, to_b - n_b, to_b])[:, n_a > 0], []
    while open_.shape[1]:
        cut = _cuts(a, b, open_)
        leaves.append(open_[:, cut < 0])
        (a0, a1, b0, b1), at = open_[:, cut >= 0], cut[cut >= 0]
        of_b = np.searchsorted(b, a[at]) + 1
        open_ = np.concatenate([np.stack([a0, at + 1, b0, of_b]), np.stack([at + 1, a1, of_b, b1])], axis=1)
    out = np.concatenate(leaves, axis=1) if leaves else open_
    return out[:, np.argsort(out[0])]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of A and B that overlap: one pair for each stretch between neighbouring ends of either."""
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


class Aligner:
    """Aligns blocks of texts with a pair of encoders."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = _encoder_pair(byte_path, piece_path)
        self.size_a, self.size_b = (np.array([len(x) for x in e.bytes], np.int64) for e in (self.a, self.b))
        self.words = np.array([f"{i}{mark}".encode() for i in range(max(len(self.a.bytes), len(self.b.bytes))) for mark in ",|;"], object)

    def _ids(self, texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text, none where the bytes of either are not those of the text with a space in front."""
        known = [t or "" for t in texts]
        both = [], []
        for t, x, y in zip(known, self.a.encode([" " + t for t in known]), self.b.encode(known)):
            i, j, raw = np.frombuffer(x, self.a.dtype), np.frombuffer(y, self.b.dtype), b" " + t.encode()
            same = t and self.a.same(i, raw) and self.b.same(j, raw)
            for ids, out in zip((i, j), both):
                out.append(ids if same else ids[:0])
        return both

    def _written(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """By document, its groups as decimal ids: a,a|b;a|b,b."""
        marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        marks_a[groups[1] - 1], marks_b[groups[3] - 1] = 1, 2
        of_a, of_b = (np.repeat(np.arange(groups.shape[1]), groups[i + 1] - groups[i]) for i in (0, 2))
        text = np.empty(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + groups[2][of_a]] = 3 * a + marks_a
        text[np.arange(len(b)) + groups[1][of_b]] = 3 * b + marks_b
        parts, ends = self.words[text].tolist(), np.cumsum(counts).tolist()
        return [b"".join(parts[i:j])[:-1] for i, j in zip([0, *ends], ends)]

    def block(self, texts: list, with_groups: bool) -> pa.RecordBatch:
        per_a, per_b = self._ids(texts)
        n_a, n_b = (np.array([len(x) for x in p], np.int64) for p in (per_a, per_b))
        a, b = (np.concatenate(p).astype(np.int64) if len(p) else np.zeros(0, np.int64) for p in (per_a, per_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        groups = leaf_groups(ends_a, ends_b, n_a, n_b)
        n_groups = np.bincount(np.searchsorted(np.cumsum(n_a), groups[0], "right"), minlength=len(texts))
        n_links = n_a + n_b - n_groups
        i, j = overlaps(ends_a, ends_b)
        space = len(self.a.bytes) * len(self.b.bytes)
        keys, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * space + a[i] * len(self.b.bytes) + b[j], return_counts=True)
        offsets = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * space).astype(np.int32))
        written = self._written(a, b, groups, n_a + n_b)
        columns = {
            **{k: pa.array(v) for k, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))},
            "groups_sha256": pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written]),
            **({"groups": pa.array([w.decode() for w in written])} if with_groups else {}),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(keys % space)),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
        }
        return pa.RecordBatch.from_pydict(columns)


def described(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """Staged: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if asked for), and the distinct id pairs of its links with their times."""
    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + (", groups string" if with_groups else "") + ", pairs array<long>, times array<long>"

    def work(batches):
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                made = aligner.block(texts[i:j], with_groups)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made.columns], ["doc_id", *made.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {fields}")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame, pieces: int) -> DataFrame:
    """Staged: pair (id of A times pieces plus id of B), n (its links in all rows), best (no pair of its id of B has more)."""
    links = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*")
    counts = staged(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("pair") % pieces).alias("b")).agg(F.max("n").alias("most"))
    out = staged(counts.join(most, F.col("pair") % pieces == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    drop(counts)
    return out


def frequent(pairs: DataFrame, most: int) -> int:
    """The least power of two such that no more than most pairs have so many links or more (1: all pairs)."""
    sizes = dict(pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*")).collect())  # 64 rows at most
    power, held = 64, 0
    while power > 0 and held + sizes.get(power - 1, 0) <= most:
        power -= 1
        held += sizes.get(power, 0)
    return 1 << power


def align(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (if asked for).

    n_best counts the links whose pair is its id of B's most frequent one (ties included), count_sum adds the counts of all links' pairs.
    Texts that are null or empty, and those that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty
    string. Rows alike are aligned and counted each for itself, long texts are aligned whole, an empty table gives an empty result, and other
    columns are not used.
    """
    pieces = len(_encoder_pair(byte_path, piece_path)[1].bytes)
    rows = described(docs, byte_path, piece_path, with_groups)
    pairs = pair_counts(rows, pieces)
    least = frequent(pairs, most_pairs)
    hot = pairs.filter(F.col("n") >= least) if least > 1 else pairs
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("p"), F.col("x.times").alias("times"))
    met = links.join(F.broadcast(hot), F.col("p") == F.col("pair"))
    if least > 1:
        rest = links.join(F.broadcast(hot.select("pair")), F.col("p") == F.col("pair"), "left_anti")
        met = met.unionByName(rest.join(pairs.filter(F.col("n") < least).hint("shuffle_hash"), F.col("p") == F.col("pair")))
    sums = met.groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = rows.join(sums, F.col("row") == F.col("of"), "left").withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
