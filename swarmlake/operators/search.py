"""Conjunctive token search over the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, query_tokens
from ..schema import POSTING_CAP, SEARCH_DEFAULT, SEARCH_MAX
from .catalog import Bounds, category_filter, newest, page, since_time


def parse_query(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(query_tokens(F.lit(text)).alias("t")).first()["t"]


def matches(postings: DataFrame, tokens: list[str], cap: int | None = POSTING_CAP, strict_stopwords: bool = True) -> DataFrame:
    """Infohashes that have all tokens, with their time; postings are distinct.

    Of a token only the first `cap` infohashes in byte order are looked at, as the catalog has always
    done, so very common tokens can miss; None looks at all. The index has no stopwords, so a query
    with one finds nothing, unless strict_stopwords is off.
    """
    wanted = list(dict.fromkeys(tokens if strict_stopwords else (t for t in tokens if t not in STOPWORDS)))
    rows = postings.filter(F.col("token").isin(wanted) if wanted else F.lit(False))
    if cap is not None:
        first = Window.partitionBy("token").orderBy("infohash")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cap)
    time = [F.max("discovered_at").alias("discovered_at")] if "discovered_at" in postings.columns else []
    return rows.groupBy("infohash").agg(F.count(F.lit(1)).alias("_k"), *time).filter(F.col("_k") == len(wanted)).drop("_k")


def search(
    entries: DataFrame, categories: DataFrame, postings: DataFrame, text: str, category: str | None = None, limit: int = SEARCH_DEFAULT, offset: int = 0,
    cap: int | None = POSTING_CAP, strict_stopwords: bool = True, bounds: Bounds = (None,),
) -> DataFrame:
    """Result rows of a search, newest first; the limit is at most SEARCH_MAX.

    An unclassified entry passes any category filter here, other than in `recent`. Postings hold an entry's time and
    are sorted by token and time, so without a cap the newest of each token are looked at first, back to one of
    `bounds` after the other, until the page is full. The cap is by hash, so with it all of a token's are read.
    """
    tokens, code = parse_query(entries.sparkSession, text), category_filter(category)

    def keys(since: int | None) -> DataFrame:
        found = matches(since_time(postings, since), tokens, cap, strict_stopwords)
        if code is None:
            return found
        codes = since_time(categories, since).select("infohash", "category")
        return found.join(codes, "infohash", "left").filter(F.col("category").isNull() | (F.col("category") == code))

    return page(newest(keys, bounds if cap is None else (None,), offset, min(limit, SEARCH_MAX)), entries, categories)
