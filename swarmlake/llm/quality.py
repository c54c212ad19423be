"""Quality by hierarchical empirical Bayes.

A classifier gives each document evidence, a log-likelihood ratio of high against low quality. Hosts
and the paths below them get posteriors: grouped means of the documents' probabilities, shrunk towards
the level above by a strength that is estimated from how much the groups differ. A document's score
adds its evidence to its path's log odds. Labels only teach the classifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups

_LETTER_RUN = re.compile(r"[^\W\d_]+")
_MARK_RUN = re.compile(r"[^\w\s]{2,}")
FEATURES = ("short", "length", "letters", "digits", "marks", "mark_runs", "upper", "word_length", "new_words", "line_repeats", "bigram_repeats", "bars", "sentences", "long_words")


def features(text: str | None) -> list[float]:
    """Measures of a whole text, each about 0 to 1."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    letters = sum(map(len, _LETTER_RUN.findall(text)))
    lines = [x for x in text.split("\n") if x]
    pairs = set(zip(words, words[1:]))
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        float(len(words) < 20), min(1.0, np.log1p(len(words)) / 8), letters / n, sum(map(text.count, "0123456789")) / n, 1 - (letters + text.count(" ") + text.count("\n")) / n,
        min(1.0, 4 * len(_MARK_RUN.findall(text)) / m), sum(w.isupper() and len(w) > 1 for w in words) / m, min(1.0, (n / m) / 12), len(set(words)) / m,
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(pairs) / max(1, len(words) - 1), min(1.0, 2 * text.count("|") / m), min(1.0, 8 * ends / m), sum(len(w) > 20 for w in words) / m,
    ]


class Classifier:
    """Logistic regression on step functions of the features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 8, l2: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, steps + 1)[1:-1])) for c in x.T]
        design = self._design(x)
        w = np.zeros(design.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (p - y) + l2 * np.append(w[:-1], 0)
            hess = (design.T * (p * (1 - p))) @ design + np.diag(np.append(np.full(len(w) - 1, l2), 1e-9))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        rate = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(rate / (1 - rate)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        steps = [(c[:, None] > cut[None, :]).astype(float) for c, cut in zip(x.T, self.cuts, strict=True)]
        return np.concatenate([*steps, x, np.ones((len(x), 1))], 1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio: the log odds without those of the labelled rows at large."""
        return self._design(x) @ self.w - self.prior


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shrunk(groups: DataFrame, above: Column, least: float = 1.0, most: float = 1e4) -> float:
    """The strength (in documents) of the level above, from the groups' spread around it by moments.

    Of groups with n documents, mean m and the mean a above, the sum of n (m - a)^2 beyond what
    chance gives, the sum of a (1 - a), is the share s of the sum of n a (1 - a) that groups explain;
    the strength is (1 - s) / s. Groups of one document say nothing; without others it is `most`.
    """
    m, n = F.col("_sum") / F.col("_n"), F.col("_n")
    got = groups.filter("_n > 1").agg(
        F.sum(n * (m - above) * (m - above)).alias("spread"), F.sum(above * (1 - above)).alias("noise"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n * above * (1 - above)).alias("var")
    ).first()
    if not got["k"] or not got["n"] or not got["var"]:
        return most
    between = max(0.0, (got["spread"] - got["noise"]) / got["var"])  # share of the variance that groups explain
    return float(min(most, max(least, (1 - min(between, 0.999)) / max(between, 1e-9))))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality",
    max_labelled: int = 20_000, max_hosts: int = 50_000, threshold: float = 0.5,
) -> DataFrame:
    """One row per document: id, host, path, evidence, score, held_out, predicted, kept.

    `host` and `path` name a document's site and its part of it (default: its source, and its source
    and language). The classifier learns from at most `max_labelled` labelled rows whose crc32 of
    the id mod 3 is not 1; the sums of hosts and paths take every document, and a document's score those of all
    others, so its evidence counts once. Null and empty texts
    have the features of a text without words; null hosts and paths are a group; null ids have no
    label; ids labelled both ways and null labels are left out. Without labels of both classes all
    evidence is zero. Rows that repeat an id are scored one by one and teach once, by the least of
    their features. Texts of any length are measured whole. Extra columns are not read, whatever their
    names; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = pa.array([features(t) for t in part.column(3).to_pylist()], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), x], ["doc_id", "host", "path", "x"])

    measured = scratch.stage(src.mapInArrow(measure, f"doc_id {id_type}, host string, path string, x array<float>"), "features")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").drop("_y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    taught = measured.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).drop("doc_id").toPandas()  # at most max_labelled rows
    model = None
    if len(taught) and taught["y"].nunique() == 2:
        model = Classifier(np.stack(taught["x"].to_numpy()).astype(float), taught["y"].to_numpy(float))
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(-1, len(FEATURES)).astype(float)
            e = shared.value.evidence(x) if shared.value else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(e)], ["doc_id", "host", "path", "evidence"])

    judged = scratch.stage(measured.mapInArrow(judge, f"doc_id {id_type}, host string, path string, evidence double"), "evidence")
    prior = model.prior if model else 0.0
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = scratch.stage(judged.groupBy("host", "path").agg(F.sum(p).alias("_sum"), F.count(F.lit(1)).alias("_n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    whole = paths.agg(F.sum("_sum"), F.sum("_n")).first()
    top = (float(whole[0] or 0) + 0.5) / (float(whole[1] or 0) + 1)
    k_host = shrunk(hosts, F.lit(top))
    hosts = hosts.select("host", F.col("_sum").alias("_host_sum"), F.col("_n").alias("_host_n"), ((F.col("_sum") + k_host * top) / (F.col("_n") + k_host)).alias("_host"))
    levels = paths.join(hosts, "host")
    k_path = shrunk(levels, F.col("_host"))
    levels = scratch.stage(levels.drop("_host"), "levels")
    # What a document's site says of it comes from the others: its own share is taken out of both sums.
    host_rest = (F.greatest(F.col("_host_sum") - p, F.lit(0.0)) + k_host * top) / (F.col("_host_n") - 1 + k_host)
    path_rest = (F.greatest(F.col("_sum") - p, F.lit(0.0)) + k_path * host_rest) / (F.col("_n") - 1 + k_path)
    odds = F.col("evidence") + F.log(path_rest / (1 - path_rest))
    # Hosts and paths of many documents are few and known to all tasks; only the others are shuffled for.
    scored = join_groups(judged, levels, ["host", "path"], "_n", int(whole[1] or 0), max_hosts).withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select(
        F.col("doc_id").alias(id_col), "host", "path", "evidence", "score", held_out(F.col("doc_id")).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("kept")
    )
