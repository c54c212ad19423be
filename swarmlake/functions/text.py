"""Index and query tokens of a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the index leaves out.
STOPWORDS = tuple("the and for are but not you all can had her was one our out has have from with this that what www com org net".split())
SPLIT = r"[^\p{IsAlphabetic}\p{N}]"


def query_tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs of at least two UTF-8 bytes, in order; stopwords stay."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: F.octet_length(t) >= 2)


def index_tokens(text: Column) -> Column:
    """Distinct tokens without stopwords."""
    return F.array_distinct(F.filter(query_tokens(text), lambda t: ~t.isin(*STOPWORDS)))
