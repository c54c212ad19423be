"""Types, constants and the category dimension of a torrent-metadata catalog."""

from __future__ import annotations

from pyspark.sql import types as T

EPOCH_OFFSET = 1_577_836_800  # 2020-01-01T00:00:00Z
U48_MASK = (1 << 48) - 1

# Category labels by code, and the order in which a listing shows them.
CATEGORIES = ("other", "movie", "tv", "music", "software", "game", "book", "xxx", "audiobook", "anime", "course")
DISPLAY_ORDER = ("movie", "tv", "anime", "music", "game", "software", "book", "audiobook", "course", "xxx", "other")
CODE = {label: code for code, label in enumerate(CATEGORIES)}

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])
ENTRY = T.StructType([
    T.StructField("infohash", T.BinaryType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("discovered_at", T.LongType()), T.StructField("files", T.ArrayType(FILE)),
])

NEAR, MAX_HASHES, LOOKUP_PEERS = 8, 80, 10
RECENT_PAGE, SEARCH_DEFAULT, SEARCH_MAX, POSTING_CAP, K_NEAREST, MAX_PEERS = 50, 20, 100, 10_000, 80, 20
