"""Secret scan: patterns find labelled credentials, grammars inferred from them find others of their format.

The values that the patterns find are the labelled strings. Of each kind a prefix tree is built over
character classes, and states whose outcomes are statistically alike are merged (a red-blue search with
Hoeffding's bound), which gives a small probabilistic automaton. Another one is inferred from the other
runs of the credential alphabet. A run is added to the spans if the odds of its likelihoods outweigh
the prior odds that a run is a credential.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("assign", "access", "hex", "likely")  # in the order of spans that begin together
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
HINTS = ("passw", "secret", "token", "api_key", "apikey")  # one of them is in each assignment, in lower case
ACCESS, HEX, RUN = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}"), re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
CLASSES = str.maketrans({c: k for k, of in {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in of})
SYMBOLS = 11  # five classes and six signs that stand for themselves
LEAST = 8  # characters of a value or a run
LONGEST = 512  # characters of a value that teaches; longer ones are scanned and scored like others, and a task keeps none of them
FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the patterns' matches; leftmost and without overlap for each kind, short ones left out."""
    low, out = text.lower(), []
    if any(h in low for h in HINTS):
        out += [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]


def runs(text: str, base: list[tuple[int, str, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, run) of the other runs: longest runs of the credential alphabet without signs at their ends, clear of all base spans."""
    taken = sorted((s, e) for s, _, e, _ in base)
    k = 0
    for m in RUN.finditer(text):
        run, start = m[0], m.start()
        if run[-1] in "+/_.-" or run[0] in "+/_.=-":
            bare = run.rstrip("+/_.-")
            run = bare.lstrip("+/_.=-")
            start += len(bare) - len(run)
            if len(run) < LEAST:
                continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        j = k  # a span may end before one that begins earlier, so all that begin before the run's end are looked at
        while j < len(taken) and taken[j][0] < start + len(run) and taken[j][1] <= start:
            j += 1
        if j == len(taken) or taken[j][0] >= start + len(run):
            yield start, run


class Automaton:
    """A probabilistic automaton, inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.total, self.ends, self.next, self.freq = [0], [0], [{}], [{}]
        for s, n in sorted(Counter(strings).items()):
            at = 0
            self.total[0] += n
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.total)
                    self.total.append(0), self.ends.append(0), self.next.append({}), self.freq.append({})
                self.freq[at][c] = self.freq[at].get(c, 0) + n
                at = self.next[at][c]
                self.total[at] += n
            self.ends[at] += n
        self._slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._bind()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self._slack * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two states, and those that the same strings lead to, have like shares of ends and symbols."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total[a], self.total[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.freq[a].keys() | self.freq[b].keys():
                if self._differ(self.freq[a].get(c, 0), na, self.freq[b].get(c, 0), nb):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.freq[b].items():
                self.freq[a][c] = self.freq[a].get(c, 0) + n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _infer(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = next(((q, c, child) for q in red for c, child in sorted(self.next[q].items()) if child not in known), None)
            if blue is None:
                break
            parent, c, child = blue
            like = next((q for q in red if self._compatible(q, child)), None)
            if like is None:
                red.append(child)
            else:
                self.next[parent][c] = like
                self._fold(like, child)
        self.states = red

    def _bind(self) -> None:
        """Log probabilities with half a count for each outcome; states by number."""
        number = {q: k for k, q in enumerate(self.states)}
        self.log, self.to, self.stop, self.none = [], [], [], []
        for q in self.states:
            whole = self.total[q] + 0.5 * (SYMBOLS + 1)
            self.log.append({c: math.log((n + 0.5) / whole) for c, n in self.freq[q].items()})
            self.to.append({c: number[x] for c, x in self.next[q].items()})
            self.stop.append(math.log((self.ends[q] + 0.5) / whole))
            self.none.append(math.log(0.5 / whole))
        del self.total, self.ends, self.next, self.freq

    def likelihood(self, s: str) -> float:
        """Log probability; past a symbol that a state never saw, all outcomes are alike."""
        at, out = 0, 0.0
        for k, c in enumerate(s):
            if c not in self.log[at]:
                return out + self.none[at] - (len(s) - k) * math.log(SYMBOLS + 1)
            out += self.log[at][c]
            at = self.to[at][c]
        return out + self.stop[at]


class Grammars:
    """The automata of the labelled kinds, and that of other runs.

    Unlabelled runs may be credentials too, and would teach the wrong side: those that are likelier
    under a kind's automaton are left out and the other automaton is inferred anew, ROUNDS times at most.
    """

    ROUNDS = 4

    def __init__(self, labelled: dict[str, list[str]], others: list[str], prior: float, enough: int):
        self.kinds = {k: Automaton(v.translate(CLASSES) for v in values) for k, values in sorted(labelled.items()) if len(values) >= enough}
        self.needed = math.log((1 - prior) / prior)
        every = Counter(o.translate(CLASSES) for o in others)
        best = {s: max((a.likelihood(s) for a in self.kinds.values()), default=-math.inf) for s in every}
        rest, self.other = every, Automaton(every.elements())
        for _ in range(self.ROUNDS):
            fewer = Counter({s: n for s, n in rest.items() if best[s] <= self.other.likelihood(s)})
            if len(fewer) == len(rest):
                break
            rest, self.other = fewer, Automaton(fewer.elements())
        self._seen: dict[str, float] = {}

    def odds(self, run: str) -> float:
        """Log of the likelihood under the best kind over that of other runs; minus infinity without kinds."""
        s = run.translate(CLASSES)
        found = self._seen.get(s)
        if found is None:
            found = max((a.likelihood(s) for a in self.kinds.values()), default=-math.inf) - self.other.likelihood(s)
            if len(s) <= 64 and len(self._seen) < 200_000:
                self._seen[s] = found
        return found

    def likely(self, run: str) -> bool:
        return self.odds(run) > self.needed


def samples(docs: DataFrame, text_col: str, labelled: int, others: int) -> tuple[dict[str, list[str]], list[str]]:
    """Distinct values of each kind and distinct other runs, those of the lowest checksums: at most `labelled` a kind and `others`.

    A task keeps no more than it may return; the order by checksum makes the sample the same however rows are dealt.
    """

    def run(batches):
        import pyarrow as pa

        kept: dict[str, dict[str, int]] = {k: {} for k in KINDS}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                for kind, value in [*((k, v) for _, k, _, v in base), *(("likely", v) for _, v in runs(text or "", base))]:
                    if len(value) <= LONGEST:
                        kept[kind].setdefault(value, zlib.crc32(value.encode()))
            for kind, values in kept.items():
                most = others if kind == "likely" else labelled
                if len(values) > 2 * most:
                    kept[kind] = dict(heapq.nsmallest(most, values.items(), key=lambda x: (x[1], x[0])))
        for kind, values in kept.items():
            held = heapq.nsmallest(others if kind == "likely" else labelled, values.items(), key=lambda x: (x[1], x[0]))
            for k in range(0, len(held), 1000):
                some = held[k : k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some)), pa.array([v for v, _ in some]), pa.array([h for _, h in some], pa.int64())], ["kind", "value", "h"])

    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "kind string, value string, h long")
    rows = scratch.stage(rows.dropDuplicates(["kind", "value"]), "samples")
    found = {k: [r["value"] for r in rows.filter(F.col("kind") == k).orderBy("h", "value").limit(others if k == "likely" else labelled).collect()] for k in KINDS}
    scratch.drop("samples")
    return {k: found[k] for k in KINDS[:3]}, found["likely"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = 2000, others: int = 6000, prior: float = 1e-5, enough: int = 20) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    spans is `kind:start:end` of all spans by start, then kind (as in KINDS), comma-joined, in code points with
    exclusive ends; base_sha256 is the digest of those of the patterns alone. Null and empty texts have none.
    Spans of one kind don't overlap; a run that touches a pattern's span is not added. Texts are read
    whole, whatever their length. A kind with fewer than `enough` labelled values has no grammar. The grammars
    are inferred on the driver from samples of fixed size: at most `labelled` distinct values a kind, `others`
    runs; counts and scores cover everything. `prior` is the share of runs expected to be credentials. Rows
    that repeat an id are rows of their own; extra columns are not read; an empty table gives no rows.
    """
    grammars = Grammars(*samples(docs, text_col, labelled, others), prior, enough)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = [(s, "likely", s + len(r)) for s, r in runs(text or "", base) if grammars.likely(r)]
                said = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))
                own = [b[:3] for b in base]
                n = Counter(k for _, k, _ in own)
                rows.append((n["assign"], n["access"], n["hex"], sha256(said(own).encode()).hexdigest(), said(own + more)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)
