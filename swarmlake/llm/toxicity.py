"""Toxicity by weak supervision.

Terms (words and word beginnings) that mark toxic texts are mined from a bounded sample of labelled
rows. They are dealt to several lexicon voters; a fixed lexicon and text patterns vote as well. A
generative label model, fitted by expectation maximisation to the vote patterns of all documents,
estimates each voter's accuracy and finds pairs of voters that agree more than the classes explain;
such a pair votes as one. A linear classifier is trained on the model's posterior labels of all
documents, labelled or not.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, Scratch

# Common English terms of abuse.
ABUSE = frozenset(b"bastard clown cretin disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash ugly vermin worthless".split())
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginning that make a term
LEXICONS = 8
PATTERNS = 8
REPEATS = (2, 3)  # distinct words of one beginning that make a further term
VOTERS = LEXICONS + PATTERNS
SHOUT = re.compile(r"[A-Z]{2,}[^a-z]{12,}[A-Z]{2,}")
MARKS = re.compile(r"[!?]{2,}")


def held_out(doc_id: Column) -> Column:
    """Rows never used for labels; a null id has no label anyway."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split())


def terms_of(found: set[bytes]) -> set[bytes]:
    """Terms of a text: =word, n:beginning of words longer than n, and n:beginning#k if k of them begin so."""
    out = {b"=" + w for w in found}
    for n in PREFIXES:
        for start, k in Counter(w[:n] for w in found if len(w) > n).items():
            if n == PREFIXES[0] and not start.isascii():
                continue  # fewer than four letters say little
            term = b"%d:%s" % (n, start)
            out.add(term)
            out.update(term + b"#%d" % r for r in REPEATS if k >= r)
    return out


@dataclass
class Lexicon:
    """Chosen terms; a term's place is its feature, its precision and checksum fix its lexicon voter."""

    chosen: list[tuple[bytes, float]]
    terms: list[bytes] = field(init=False)
    place: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        self.terms = [t for t, _ in self.chosen]
        self.place = {t: i for i, t in enumerate(self.terms)}
        # Four lexicons of precise terms, two of fair and two of weak ones: a voter's accuracy is that of its terms.
        self.voter = [zlib.crc32(t) % 4 if p >= 0.9 else (4 if p >= 0.6 else 6) + zlib.crc32(t) % 2 for t, p in self.chosen]
        self.whole = {t[1:]: i for t, i in self.place.items() if t.startswith(b"=")}
        self.starts = {n: {t.partition(b":")[2].partition(b"#")[0] for t in self.terms if t.startswith(b"%d:" % n)} for n in PREFIXES}

    def read(self, text: str | None) -> tuple[list[int], int]:
        """Features and votes (a bit per voter) of a text."""
        text = text or ""
        every = (text.lower().encode("utf-8", "surrogatepass")).translate(WORD_TABLE).split()
        found = set(every)
        marked = self.whole.keys() & found
        hits, marked = {self.whole[w] for w in marked}, set(marked)
        for n in PREFIXES:
            if not (here := self.starts[n] & {w[:n] for w in found}):
                continue
            for start in here:
                own = [w for w in found if len(w) > n and w.startswith(start)]
                marked.update(own)
                names = (b"%d:%s" % (n, start), *(b"%d:%s#%d" % (n, start, r) for r in REPEATS if len(own) >= r))
                hits.update(self.place[t] for t in (names if own else ()) if t in self.place)
        votes = 0
        for i in hits:
            votes |= 1 << self.voter[i]
        abuse, rate = len(ABUSE & found), len(marked) / max(1, len(every))
        for bit, vote in enumerate((abuse > 0, abuse > 2, SHOUT.search(text), MARKS.search(text), len(marked) > 1, len(marked) > 2, len(marked) > 1 and rate > 0.006, len(marked) > 2 and rate > 0.01)):
            votes |= bool(vote) << (LEXICONS + bit)
        return sorted(hits), votes


def mine_terms(rows: DataFrame) -> list[tuple[bytes, float]]:
    """Terms of `rows` (text, toxic) whose link to the label can't be chance, with their precision.

    All significant candidates are thinned out one by one: each choice must be significant on the
    rows that no earlier choice hits, so words that merely stand beside others are left out. Terms of
    ten toxic rows and no other stay besides. Candidates grow with the words of the rows only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def emit() -> pa.RecordBatch:
            keys = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sums[1][k] for k in keys], pa.int64()), pa.array([sums[0][k] for k in keys], pa.int64())], ["term", "pos", "neg"])
            sums[0].clear(), sums[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[toxic].update(terms_of(distinct_words(text)))
                if len(sums[0]) + len(sums[1]) > 400_000:
                    yield emit()
        yield emit()

    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n1, n = int(totals[0] or 0), int(totals[1])
    if not n1 or n1 == n:
        return []
    seen = rows.select("text", "toxic").mapInArrow(count, "term binary, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    seen = seen.filter("pos >= 3")
    rate, df = n1 / n, F.col("pos") + F.col("neg")
    gain = lambda k, p: F.when(k > 0, k * F.log(k / (df * p))).otherwise(0.0)
    g2 = 2 * (gain(F.col("pos"), rate) + gain(F.col("neg"), 1 - rate))
    bound = 2 * np.log(60.0 * n)  # about the number of terms that were tried
    best = seen.filter(F.col("pos") > 3 * rate * df).withColumn("g2", g2).filter(F.col("g2") > F.lit(float(bound)))
    got = [(bytes(r["term"]), r["pos"], r["neg"]) for r in best.orderBy(F.desc("g2"), F.length("term"), "term").collect()]
    if not got:
        return []
    candidates = Lexicon([(term, pos / (pos + neg)) for term, pos, neg in got])
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = pa.array([shared.value.read(t)[0] for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([hits, batch.column(1)], ["hits", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(find, "hits array<int>, toxic int").toPandas()  # a row for each labelled id at most
    toxic = found["toxic"].to_numpy()
    owner = np.repeat(np.arange(len(found)), found["hits"].map(len))
    term = np.concatenate([*found["hits"], np.empty(0, np.int32)]).astype(np.int64)
    open_rows, chosen = np.ones(len(found), bool), []
    while True:
        live = open_rows[owner]
        pos = np.bincount(term[live & (toxic[owner] == 1)], minlength=len(got)).astype(float)
        df = np.bincount(term[live], minlength=len(got)).astype(float)
        p = max(toxic[open_rows].mean() if open_rows.any() else 0, 1e-4)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(pos > 0, pos * np.log(pos / (df * p)), 0) + np.where(df > pos, (df - pos) * np.log((df - pos) / (df * (1 - p))), 0))
        g2[(pos < 3) | (pos < 0.5 * df)] = 0
        best = int(np.argmax(g2))
        if g2[best] <= bound:
            known = {t for t, _ in chosen}
            return chosen + [(t, 1.0) for t, pos, neg in got if not neg and pos >= 10 and t not in known]
        chosen.append((got[best][0], float(pos[best] / df[best])))
        open_rows[owner[term == best]] = False


class LabelModel:
    """Two latent classes over binary votes; factors are voters or correlated pairs of voters."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labelled: np.ndarray, rounds: int = 60):
        """`patterns`: distinct vote masks; `counts`: their documents; `labelled`: (class, pattern) counts."""
        self.patterns = patterns
        self.bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
        self.factors: list[tuple[int, ...]] = [(v,) for v in range(VOTERS)]
        self.correlated: dict[tuple[int, int], float] = {}
        self._fit(counts, labelled, rounds)
        while found := self._strongest_pair(counts):
            # One pair at a time: a pair counted twice distorts the correlations of the others.
            a, b = found[0]
            self.correlated[a, b] = found[1]
            self.factors = [f for f in self.factors if f not in ((a,), (b,))] + [(a, b)]
            self._fit(counts, labelled, rounds)

    def _outcome(self, factor: tuple[int, ...]) -> np.ndarray:
        return sum(self.bits[:, v] << i for i, v in enumerate(factor))

    def _fit(self, counts: np.ndarray, labelled: np.ndarray, rounds: int) -> None:
        outcomes = [self._outcome(f) for f in self.factors]
        free = np.maximum(counts - labelled.sum(0), 0)
        post = (labelled[1] + 0.1) / (labelled.sum(0) + 1.0)
        for _ in range(rounds):
            weight = np.stack((labelled[0] + free * (1 - post), labelled[1] + free * post))
            share = (weight.sum(1) + 1) / (weight.sum() + 2)
            logit = np.full(len(self.patterns), np.log(share[1] / share[0]))
            self.tables = []
            for f, out in zip(self.factors, outcomes, strict=True):
                size = 1 << len(f)
                table = np.stack([np.bincount(out, w, size) + 0.2 for w in weight])
                table /= table.sum(1, keepdims=True)
                self.tables.append(table)
                logit += np.log(table[1] / table[0])[out]
            new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            done, post = np.abs(new - post).max() < 1e-6, new
            if done:
                break
        self.posterior, self.balance = post, share[1]
        # of a voter that fires: how much likelier under the toxic class
        self.accuracy = {f: t[1] / t[0] for f, t in zip(self.factors, self.tables, strict=True)}

    def _strongest_pair(self, counts: np.ndarray, least: float = 0.3) -> tuple[tuple[int, int], float] | None:
        """Of voters that are factors of their own, the pair with the highest correlation within a class, if it is at least `least`."""
        alone, best = [f[0] for f in self.factors if len(f) == 1], None
        for side in (1 - self.posterior, self.posterior):
            w = counts * side
            if w.sum() < 20:
                continue
            centred = self.bits - (w[:, None] * self.bits).sum(0) / w.sum()
            cov = (centred * w[:, None]).T @ centred / w.sum()
            scale = np.sqrt(np.diag(cov))
            for i, a in enumerate(alone):
                for b in alone[i + 1 :]:
                    if scale[a] > 1e-3 and scale[b] > 1e-3 and (c := abs(cov[a, b]) / (scale[a] * scale[b])) >= least and (best is None or c > best[1]):
                        best = (a, b), float(c)
        return best


def fit_linear(row: np.ndarray, col: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, l2: float = 1e-4, steps: int = 600) -> np.ndarray:
    """Logistic regression on weighted rows of sparse binary features (last weight: bias), by accelerated gradient steps."""
    n, share = len(target), weight / weight.sum()
    most = np.bincount(row, minlength=n).max() + 1
    rate = 4.0 / most
    w = ahead = np.zeros(width + 1)
    for step in range(steps):
        logit = np.bincount(row, ahead[col], n) + ahead[-1]
        slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target) * share
        grad = np.append(np.bincount(col, slope[row], width)[:width], slope.sum()) + l2 * np.append(ahead[:-1], 0)
        new = ahead - rate * grad
        w, ahead = new, new + step / (step + 3) * (new - w)
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_examples: int = 50_000, threshold: float = 0.7,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels are read only for rows whose crc32 of the id mod 3 is not 1, and of those for at most
    `max_labelled`, the first by a hash of the id; they serve to mine terms and to start and orient
    the label model, which takes the votes of all documents. Its posteriors label all documents; of
    those more likely toxic and of the others the classifier learns from about `max_examples` each,
    drawn by a hash and weighted for the rest. All texts vote and are scored whole, whatever their
    length. Null and empty texts have no terms and get a low score; null ids have no label. Labels of
    null, or an id labelled both ways, are left out; of an id that repeats with different texts the
    lowest text is mined. Without labels of both classes only the fixed
    voters score. Rows that repeat an id are scored one by one; an empty table gives an empty result;
    extra columns are not read, whatever their names.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").drop("_most")
    sample = scratch.stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "sample")
    sample = F.broadcast(sample)  # at most max_labelled rows of two numbers
    # One text an id, so that what is mined is as bounded as the ids, however often they repeat.
    own = src.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    taught_texts = scratch.stage(own.select("text", "toxic").dropDuplicates(), "texts")
    lexicon = Lexicon(mine_terms(taught_texts))
    shared = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.read
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                got = [read(t) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([h for h, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.int32())], ["doc_id", "hits", "votes"])

    id_type = src.schema["doc_id"].dataType.simpleString()
    read = scratch.stage(src.mapInArrow(vote, f"doc_id {id_type}, hits array<int>, votes int"), "votes")
    counted = {r["votes"]: r["n"] for r in read.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2**VOTERS rows
    taught = {(r["votes"], r["toxic"]): r["n"] for r in read.join(sample, "doc_id").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({y for _, y in taught}) < 2:
        weights = fixed_weights(len(lexicon.terms))
    else:
        patterns = np.array(sorted(counted), np.int64)
        counts = np.array([counted[p] for p in patterns.tolist()], np.float64)
        labelled = np.array([[taught.get((p, y), 0) for p in patterns.tolist()] for y in (0, 1)], np.float64)
        posterior = LabelModel(patterns, counts, labelled).posterior
        likely = posterior >= 0.5
        share = [min(1.0, max_examples / max(1.0, counts[likely == side].sum())) for side in (False, True)]
        known = spark.createDataFrame(list(zip(patterns.tolist(), np.where(likely, share[1], share[0]).tolist(), strict=True)), "votes int, share double")
        drawn = F.pmod(F.xxhash64("doc_id", "hits", "votes"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        examples = read.join(F.broadcast(known), "votes").filter(drawn).groupBy("hits", "votes").agg(F.count(F.lit(1)).alias("n"), F.first("share").alias("share")).orderBy("votes", "hits").toPandas()
        weights = _train(examples, dict(zip(patterns.tolist(), posterior.tolist(), strict=True)), len(lexicon.terms))
    model = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        terms = len(w) - VOTERS - 1
        for batch in batches:
            hits = batch.column(1)
            owner = np.repeat(np.arange(len(hits)), np.asarray(hits.value_lengths()))
            logit = np.bincount(owner, w[np.asarray(hits.flatten())], len(hits)) + w[-1]
            votes = np.asarray(batch.column(2))
            for v in range(VOTERS):
                logit = logit + w[terms + v] * ((votes >> v) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], ["doc_id", "score"])

    scored = read.mapInArrow(score, f"doc_id {id_type}, score double")
    return scored.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fixed_weights(terms: int) -> np.ndarray:
    """Nothing to learn from: the fixed lexicon alone decides."""
    w = np.zeros(terms + VOTERS + 1)
    w[terms + LEXICONS : terms + LEXICONS + 2], w[-1] = (4.0, 2.0), -3.0
    return w


def _train(examples, posterior: dict[int, float], terms: int) -> np.ndarray:
    """Weights of terms, voters and bias, learned from the label model's posteriors; `examples` is a pandas table (hits, votes, n, share)."""
    rows, cols = [], []
    for i, (hits, votes) in enumerate(zip(examples["hits"], examples["votes"], strict=True)):
        own = [*hits, *(terms + v for v in range(VOTERS) if votes >> v & 1)]
        cols.extend(own)
        rows.extend([i] * len(own))
    target = np.array([posterior[v] for v in examples["votes"]])
    return fit_linear(np.array(rows, np.int64), np.array(cols, np.int64), target, (examples["n"] / examples["share"]).to_numpy(float), terms + VOTERS)
