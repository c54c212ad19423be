"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one partition, up to a fixed number of words, so memory is bounded
and nothing is shuffled. Its words become symbols: words of the benchmark get a number, a run of
other words one separator that no phrase holds. The suffixes are sorted, the last column of the
sorted rotations goes to a wavelet tree, and every phrase is searched backwards through ranks in
that tree. Matching rows are located by walking to sampled suffix positions, and the spans of all
phrases are merged per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, Scratch, words

WINDOW = 10
SPAN_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class Phrases:
    """The windows of the benchmark items as symbols: one row per distinct window, and the numbers of its items in `names`."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        number: dict[str, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = seen.setdefault(tuple(ids[i : i + window]), set())
                if item is not None:
                    owners.add(number.setdefault(item, len(number)))
        self.names = list(number)
        self.length = np.array([len(x) for x in seen], np.int32)
        width = max(self.length, default=0)
        # Right-aligned, since the search runs from the last word to the first.
        self.symbols = np.zeros((len(seen), int(width)), np.int32)
        for row, x in zip(self.symbols, seen, strict=True):
            row[width - len(x) :] = x
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in seen.values()]))).astype(np.int64)
        self.owner = np.fromiter((x for own in seen.values() for x in sorted(own)), np.int32, int(self.first[-1]))

    def items_of(self, row: int) -> list[int]:
        return self.owner[self.first[row] : self.first[row + 1]].tolist()

    def symbols_of(self, text: list[bytes]) -> np.ndarray:
        get = self.symbol.get
        return np.fromiter([get(w, 0) for w in text], np.int32, len(text))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of symbols, by prefix doubling; each 0 ends its suffixes and differs from the others by place."""
    n = len(text)
    rank = text.astype(np.int64)
    ends = text == 0
    # Separators sort first and by place, so suffixes never compare past one.
    rank[ends] = np.arange(np.count_nonzero(ends))
    rank[~ends] += np.count_nonzero(ends) - 1
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_rank[1:] != sorted_rank[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    same = ~fresh
    same[:-1] |= ~fresh[1:]
    open_rows = np.flatnonzero(same)  # rows of the order whose rank is shared
    k = 1
    while len(open_rows):
        at = order[open_rows]
        group, nxt = rank[at], rank[np.minimum(at + k, n - 1)]
        resort = np.lexsort((nxt, group))
        at, group, nxt = at[resort], group[resort], nxt[resort]
        order[open_rows] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, open_rows, 0))
        shared = ~new
        shared[:-1] |= ~new[1:]
        open_rows = open_rows[shared]
        k *= 2
    return order


class WaveletTree:
    """Ranks in a sequence of symbols, by levels of bits (most significant first), as a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.n = bits, [], len(symbols)
        for level in reversed(range(bits)):
            ones = (symbols >> level) & 1
            packed = np.packbits(ones.astype(np.uint8))
            per_word = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            counts = np.zeros(len(per_word) + 1, np.int64)
            np.cumsum(np.bitwise_count(per_word), out=counts[1:])
            zeros = len(symbols) - int(counts[-1])
            self.levels.append((per_word.byteswap(), counts, zeros))
            chosen = ones.astype(bool)
            symbols = np.concatenate((symbols[~chosen], symbols[chosen]))

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        per_word, counts, _ = level
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        # bit 0 of the sequence is the highest bit of its word
        kept = np.where(bit == 0, np.uint64(0), per_word[word] >> (np.uint64(64) - np.maximum(bit, np.uint64(1))))
        return counts[word] + np.bitwise_count(kept)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = np.where(one, level[2] + a, low - a), np.where(one, level[2] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in self.levels:
            before, after = self._ones(level, at), self._ones(level, at + 1)
            one = after > before
            out = out * 2 + one
            at = np.where(one, level[2] + before, at - before)
        return out


class FMIndex:
    """An index of one shard's symbols; 0 separates, so no phrase crosses it."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 16):
        self.text_length = len(text)
        order = suffix_order(text)
        last = text[order - 1]  # place -1 is the text's end, a separator
        self.tree = WaveletTree(last.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.before = np.zeros(alphabet + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet + 1), out=self.before[1:])
        # Separators' rows are sampled as well: a walk over one would not follow the text's order.
        kept = (order % sample == 0) | (last == 0)
        self.kept, self.at = WaveletTree(kept.astype(np.int64), 1), order[kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last row of each right-aligned phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_length, np.int64)
        width = phrases.shape[1]
        for i in reversed(range(width)):
            live = np.flatnonzero((length >= width - i) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, i].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text place of each row."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        one = np.ones(1, np.int64)
        while len(todo):
            here = self.kept.access(rows) == 1
            found = rows[here]
            out[todo[here]] = self.at[self.kept.rank(np.broadcast_to(one, found.shape), found)] + steps
            rows, todo = rows[~here], todo[~here]
            if len(todo):
                symbol = self.tree.access(rows)
                rows = self.before[symbol] + self.tree.rank(symbol, rows)
                steps += 1
        return out


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set[int]]]:
    """For each document (symbols) of a shard: merged spans (start, end) of hit words, and the numbers of the items found."""
    spans, items = [np.empty((0, 2), np.int64) for _ in docs], [set() for _ in docs]
    if not docs or not len(phrases.length):
        return spans, items
    gap = np.zeros(1, np.int32)
    whole = np.concatenate([x for doc in docs for x in (doc, gap)])
    starts = np.concatenate(([0], np.cumsum([len(doc) + 1 for doc in docs])))
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:] != 0) | (whole[:-1] != 0)
    place, text = np.flatnonzero(keep), whole[keep]
    index = FMIndex(text, len(phrases.symbol))
    low, high = index.search(phrases.symbols, phrases.length)
    count = high - low
    hit = np.flatnonzero(count)
    if not len(hit):
        return spans, items
    window = np.repeat(hit, count[hit])
    offset = np.arange(len(window)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    start = place[index.locate(low[window] + offset)]
    end = start + phrases.length[window]
    doc = np.searchsorted(starts, start, "right") - 1
    for d, w in np.unique(np.stack((doc, window), 1), axis=0):
        items[d].update(phrases.items_of(w))
    by_start = np.argsort(start, kind="stable")
    start, end, doc = start[by_start], end[by_start], doc[by_start]
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    merged = np.stack((start[first], np.maximum.reduceat(end, first)), 1) - starts[doc[first]][:, None]
    for d, group in zip(*_grouped(doc[first], merged), strict=True):
        spans[d] = group
    return spans, items


def _grouped(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cuts], np.split(rows, cuts[1:])


def find_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    shard_words: int = 600_000, max_item_words: int = 500_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (word offsets, merged, half open), items, and the columns of `carry`.

    Words are those of `common.words`. Null and empty texts have no words and no hits. Items are listed by
    their ids as strings, whatever the type, in the order of strings. Items without words are never found; the
    words of an item without an id are hit, but it is not listed; items that repeat an id count as
    one; rows that repeat an id are searched one by one. A very long text is a shard of its own. Extra columns are not read,
    whatever their names; an empty table, or an empty benchmark, gives no rows or no hits.

    The benchmark is dealt by a hash of the item to parts of about `max_item_words` words (a longer
    item is read whole). Only one part at a time is on the driver, in a broadcast and in a worker:
    a benchmark of one part takes one pass over the documents, a larger one a pass for each part,
    whose spans and items are merged by row. At the full 500,000
    words the driver needs about 220 MB, and a worker 110 MB with a full shard (35 MB for the benchmark, measured).
    """
    item = F.col(item_col).cast("string").alias("item")
    query = benchmark.select(item, F.col(item_text_col).cast("string").alias("text"))
    size = query.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # a word and its end have two bytes at least
    parts = max(1, -(-int(size) // max_item_words))
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if parts == 1:
        carried = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
        found = _pass(docs.select(*own, *carried), _phrases(query, window), shard_words)
        return found.select("doc_id", "n_words", "n_hit", "spans", "items", *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)))
    scratch = Scratch(docs.sparkSession, "spans")
    carried = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    rows = scratch.stage(docs.select(*own, *carried).withColumn("_row", F.monotonically_increasing_id()), "documents")
    hits = None
    for part in range(parts):
        phrases = _phrases(query.filter(F.pmod(F.xxhash64(F.coalesce("item", "text")), F.lit(parts)) == part), window)
        one = _pass(rows.select("doc_id", "text", F.col("_row").alias("_carry0")), phrases, shard_words).filter("n_hit > 0").select(F.col("_carry0").alias("_row"), "spans", "items")
        one = scratch.stage(one, f"hits{part}")
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.mapInArrow(_merged, "_row long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>")
    none = SPAN_SCHEMA["spans"].dataType
    return _counted(rows).join(merged, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(none)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)),
    )


def _phrases(query: DataFrame, window: int) -> Phrases:
    """The windows of one part of the benchmark, whose size `find_spans` bounds."""
    return Phrases(((r["item"], r["text"]) for r in query.toLocalIterator()), window)


def _counted(rows: DataFrame) -> DataFrame:
    """Adds n_words and drops the text."""

    n_words = F.udf(lambda text: len(words(text)), "long", useArrow=True)
    return rows.withColumn("n_words", n_words("text")).drop("text")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjacent spans of a row become one."""
    for batch in batches:
        spans = []
        for listed in batch.column(1).to_pylist():
            out: list[dict[str, int]] = []
            for span in listed:
                if out and span["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], span["end"])
                else:
                    out.append(span)
            spans.append(out)
        hit = pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), hit, pa.array(spans, batch.schema.field(1).type), batch.column(2)], ["_row", "n_hit", "spans", "items"])


def _pass(src: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    """Spans and items of (doc_id, text, carried columns) by one part of the benchmark, in a pass without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*SPAN_SCHEMA.fields, *src.schema.fields[2:]])
    arrow = to_arrow_schema(schema)
    shared, width = src.sparkSession.sparkContext.broadcast(phrases), len(src.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        held, counts, symbols, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            spans, items = search_shard(symbols, phrases)
            cols = [
                pa.concat_arrays([x.column(0) for x in held]), pa.array(counts, pa.int64()), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], arrow.field(3).type), pa.array([sorted(phrases.names[x] for x in i) for i in items], arrow.field(4).type),
                *(pa.concat_arrays([x.column(i) for x in held]) for i in range(2, width)),
            ]
            held.clear(), counts.clear(), symbols.clear()
            n = 0
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(1)):
                found = words(text.as_py())
                counts.append(len(found))
                symbols.append(phrases.symbols_of(found))
                n += len(found)
                if n >= shard_words:
                    held.append(batch.slice(first, i + 1 - first))
                    first = i + 1
                    yield flush()
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield flush()

    return src.mapInArrow(run, schema)


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their own columns, the hit words cut out of the text with what stands between them.

    A text without hits stays as it is; a null text stays null. Cuts leave one space.
    """
    own = docs.columns
    names = {c: f"_c{i}" for i, c in enumerate(own)}
    found = find_spans(docs.withColumnsRenamed(names), benchmark, names[id_col], names[text_col], carry=tuple(names.values()), **options)

    cut = F.udf(lambda text, spans: _cut(text, spans) if text and spans else text, "string", useArrow=True)
    hit = F.col("n_hit") > 0
    return found.select(*(F.when(hit, cut(F.col(names[c]).cast("string"), F.col("spans"))).otherwise(F.col(names[c])).alias(c) if c == text_col else F.col(names[c]).alias(c) for c in own))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _cut(text: str, spans: list) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    # A word's bytes keep their places when letters are lower-cased one by one.
    places = [m.span() for m in _WORD.finditer(raw.translate(WORD_TABLE))]
    out, at = [], 0
    for span in spans:
        out.append(raw[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    out.append(raw[at:])
    return b" ".join(x.strip() for x in out if x.strip()).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose share of hit words is at most `max_share`, with their own columns.

    Null and empty texts stay. `without_spans` cuts the passages out instead.
    """
    own = docs.columns
    names = {c: f"_c{i}" for i, c in enumerate(own)}
    found = find_spans(docs.withColumnsRenamed(names), benchmark, names[id_col], names[text_col], carry=tuple(names.values()), **options)
    clean = found.filter(F.col("n_hit") <= F.lit(max_share) * F.col("n_words"))
    return clean.select(*(F.col(names[c]).alias(c) for c in own))
