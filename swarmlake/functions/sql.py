"""SQL names for the library's expressions, so that plain SQL can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import CATEGORIES, EPOCH_OFFSET, U48_MASK
from .text import SPLIT, STOPWORDS


def register(spark: SparkSession) -> None:
    """Temporary functions that Catalyst inlines: swarm_tokens, swarm_label, swarm_unix, swarm_u48."""
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    labels = ", ".join(f"'{c}'" for c in CATEGORIES)
    split = SPLIT.replace("\\", "\\\\")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION swarm_tokens(name STRING) RETURNS ARRAY<STRING> RETURN "
        f"array_distinct(filter(split(lower(coalesce(name, '')), '{split}'), t -> octet_length(t) >= 2 AND t NOT IN ({words})))"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION swarm_label(code INT) RETURNS STRING RETURN coalesce(get(array({labels}), code), 'other')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION swarm_unix(discovered_at BIGINT) RETURNS BIGINT RETURN discovered_at + {EPOCH_OFFSET}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION swarm_u48(size BIGINT) RETURNS BIGINT RETURN size & {U48_MASK}")
