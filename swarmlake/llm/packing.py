"""Cost-balanced packing of documents into training sequences.

Each partition is packed by itself in blocks of a bounded number of tokens, so nothing is shuffled.
A block's tokens fill whole sequences; what is left over fills sequences whose lengths are powers
of two, which need no padding. Documents go in descending order of estimated attention cost (linear
plus quadratic in the length) to the sequence of the lowest cost that still has room for them; a
document that fits nowhere is cut, first into the sequence of the lowest cost.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"

# Fixed value: how the word-end tokenizers cut a text, lower-cased, before the merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts of characters below U+0300 hold no combining marks: lower-casing and cutting them at spaces
# before the tokenizer does both gives the same ids.
OTHER = re.compile("[^\x00-\u02ff]")


class Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n

    def since(self, n: int) -> list:
        """Keys numbered n and above."""
        new = list(islice(reversed(self), len(self) - n))
        new.reverse()
        return new


class Ragged:
    """Rows of 32-bit numbers, one after another, in a buffer that grows."""

    def __init__(self):
        self.n, self.ids, self.ends = 0, np.zeros(1 << 12, np.uint32), np.zeros(1, np.int64)

    def add(self, rows: list[bytes]) -> None:
        new = np.frombuffer(b"".join(rows), np.uint32)
        while self.n + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.n : self.n + len(new)] = new
        self.n += len(new)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 4)))

    def row(self, n: int) -> bytes:
        return self.ids[self.ends[n] : self.ends[n + 1]].tobytes()

    def take(self, rows: np.ndarray) -> np.ndarray:
        start = self.ends[rows]
        size = self.ends[rows + 1] - start
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class WordCache:
    """Ids of texts by a tokenizers file. With a vocabulary that marks word ends and drops white
    space, words are encoded once and kept, and texts are put together from their words.

    Only the speed depends on the cache. It holds the last `limit` to twice `limit` words, so a
    worker's memory is bounded.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.limit, self.whole = path, limit, None
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        made = json.loads(self.merges.to_str())
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = made["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and json.dumps(CUTS) in json.dumps(made["pre_tokenizer"])
        if self.by_word:  # the pieces of CUTS need the merges only
            self.merges.normalizer = None
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.merges.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cut = regex.compile(CUTS).findall
        self.words, self.ids, self.before = Numbered(), Ragged(), (Numbered(), Ragged())

    def tokenizer(self):
        """The file's tokenizer as it is, for texts that can't be put together from words."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return self.whole

    def _learn(self, n: int) -> None:
        """Gives ids to the words numbered n and above."""
        new, (old, old_ids) = self.words.since(n), self.before
        pieces = Numbered()
        cut = [None if w in old else (pieces[w],) if w.isalpha() else tuple(map(pieces.__getitem__, self.cut(w))) for w in new]
        ids: list[bytes] = []
        if pieces:
            found = np.array(self.merges.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.last[found]) + 1) * 4
            if len(ends) != len(pieces):
                raise ValueError("every piece of a word ends in a token that marks its end")
            raw, starts = found.tobytes(), [0, *ends[:-1].tolist()]
            ids = [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
        self.ids.add([old_ids.row(old[w]) if c is None else ids[c[0]] if len(c) == 1 else b"".join([ids[i] for i in c]) for w, c in zip(new, cut, strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        if len(self.words) > self.limit:
            self.before = (self.words, self.ids)
            self.words, self.ids = Numbered(), Ragged()
        known, number, plain, rest = len(self.words), self.words.__getitem__, [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or OTHER.search(text):
                rest.append(i)
            else:
                plain.append((i, np.fromiter(map(number, text.lower().replace("\n", " ").split(" ")), np.int64)))
        for i, found in zip(rest, self.tokenizer().encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        if len(self.words) > known:
            self._learn(known)
        for i, words in plain:
            out[i] = self.ids.take(words).astype("<u4", copy=False).tobytes()
        return out


_caches: dict[str, WordCache] = {}


def assign(lengths: np.ndarray, capacity: int, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of documents (document, start, length, sequence, offset) and the sequences' lengths."""
    total = int(lengths.sum())
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)
    sizes, cost, pieces = room.copy(), np.zeros(len(room)), []

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, at, sizes[at] - room[at]))
        room[at] -= n
        cost[at] += n + quadratic * n * n

    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[doc])
        while left:
            n = min(left, capacity)
            fits = room >= n
            if not fits.any():
                fits = room > 0
            at = int(np.where(fits, cost, np.inf).argmin())
            n = min(n, int(room[at]))
            put(doc, start, n, at)
            start, left = start + n, left - n
    return np.array(pieces, np.int64).reshape(-1, 5), sizes


def pack(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 2, quadratic: float = 1 / 2048,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length, ids.

    A document is its tokens and then `end_id`, so null and empty texts are one token; without an
    end id they have no piece. `quadratic` is the cost of a token pair in units of a token. Every
    row is packed, rows that repeat an id each as a document of its own; ids are cast to long, null if
    they are no numbers. A block ends with the row that fills it, so a very long text is a block of its
    own. Extra columns are not read; an empty table gives no pieces. sequence_id is unique over the table and the same on a rerun
    over the same splits. `ids` are little-endian unsigned 32-bit ids.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(PIECES))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _caches.get(tokenizer_file) or _caches.setdefault(tokenizer_file, WordCache(tokenizer_file))
        sequence = TaskContext.get().partitionId() << 32
        names, tokens, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            lengths = np.array([len(t) // 4 for t in tokens], np.int64)
            pieces, sizes = assign(lengths, capacity, quadratic)
            for at in range(0, len(pieces), 512):
                doc, start, n, seq, offset = pieces[at : at + 512].T
                cols = [
                    pa.array([names[d] for d in doc], pa.int64()), start, n, lengths[doc], seq + sequence, offset, sizes[seq],
                    pa.array([tokens[d][a * 4 : (a + k) * 4] for d, a, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], schema=arrow)
            sequence += len(sizes)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for name, ids in zip(piece.column(0).to_pylist(), cache.encode(piece.column(1).to_pylist()), strict=True):
                    names.append(name)
                    tokens.append(ids + end)
                    held += len(tokens[-1]) // 4
                    if held >= block_tokens:
                        yield from flush()
                        names, tokens, held = [], [], 0
        if tokens:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)
