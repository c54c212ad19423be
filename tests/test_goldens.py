"""Hand-derived results of the classifier, the tokenizers, the catalog rules and the codecs."""

import io

import pytest
from pyspark.sql import functions as F

from swarmlake.functions import classify, text
from swarmlake.functions import format as fmt
from swarmlake.operators import catalog, search
from swarmlake.schema import CATEGORIES, ENTRY
from swarmlake.sources import codecs, datasource, sink
from swarmlake.streaming import ingest

NAMES = {
    "Show.Name.S01E02.720p.HDTV.x264": "tv", "Some Movie 2019 1080p BluRay x264 YIFY": "movie", "Movie (1999)": "other", "deadbeef [DEADBEEF]": "anime", "[SubsPlease] Show - 05 [1080p]": "anime",
    "Artist - Album (2001) FLAC": "music", "Tool v1.2": "other", "Tool v1.2 x64": "software", "Game.Name-CODEX": "game", "Game REPACK": "game", "Photoshop CODEX windows": "game",
    "Learn Python course linux": "course", "course patch 18+ x": "course", "Novel unabridged audiobook": "audiobook", "Novel epub": "book", "xxx S01E01": "xxx", "xxx S01E01 1080p": "tv",
    "xxx GOG portable": "game", "[judas] xxx 1080p": "xxx", "EP x": "music", "äEP x": "other", "": "other", "cold widget": "other",
}


def test_categories(spark):
    rows = classify.with_category(spark.createDataFrame([(n,) for n in NAMES], "name string")).collect()
    assert {r["name"]: CATEGORIES[r["category"]] for r in rows} == NAMES


def test_patterns_are_evaluated_once(spark):
    plan = classify.with_category(spark.createDataFrame([("x",)], "name string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") <= len(classify.PATTERNS) + 3


def test_gates_let_every_match_through(spark):
    """Names made of the patterns' own words, in many spellings, score the same with all patterns run."""
    import random
    import re

    rng, names = random.Random(1), []
    for _, _, pattern in classify.PATTERNS:
        for part in re.split(r"[|()]", pattern):
            word = re.sub(r"\\[bd]|\[\\s[^\]]*\]\??|\[.*?\]|[\\?+{}]", lambda m: {"[": rng.choice(["", " ", ".", "_", "-"]), "\\": "7" if m[0] == "\\d" else ""}.get(m[0][0], ""), part)
            names += [f"a {word} b", word.upper(), f"[{word}]", f"x.{word}_y", f"ü {word}", f"{word}s"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    gated = df.withColumn("g", classify.possible(F.col("name"))).withColumn("a", classify.scores(F.col("name"), F.col("g")))
    both = gated.withColumn("b", classify.scores(F.col("name"), F.lit(-1).cast("long")))
    assert both.filter("a <> b").select("name").collect() == [] and both.filter("exists(a, x -> x > 0)").count() > 400
    assert len(classify.GATES) > 50


def test_pattern_counts():
    per = {c: sum(p[0] == c for p in classify.PATTERNS) for c in CATEGORIES}
    assert len(classify.PATTERNS) == 68
    assert per == {"other": 0, "xxx": 6, "audiobook": 3, "anime": 8, "course": 5, "tv": 9, "game": 9, "movie": 8, "music": 6, "software": 7, "book": 7}


def test_tokens(spark):
    rows = spark.createDataFrame([("The Matrix (1999)",), ("S01E02.Foo_bar",), ("É a é",), ("a - b",), (None,)], "name string")
    got = rows.select(text.index_tokens(F.col("name")).alias("i"), text.query_tokens(F.col("name")).alias("q")).collect()
    assert [r["i"] for r in got] == [["matrix", "1999"], ["s01e02", "foo", "bar"], ["é"], [], []]
    assert [r["q"] for r in got] == [["the", "matrix", "1999"], ["s01e02", "foo", "bar"], ["é", "é"], [], []]


def entries(spark, rows):
    return spark.createDataFrame([(bytes([i]) * 20, n, s, t, []) for i, n, s, t in rows], ENTRY)


def test_first_write_wins(spark):
    stored = entries(spark, [(1, "a", 1, 1)])
    incoming = entries(spark, [(1, "b", 2, 2), (2, "c", 3, 3), (2, "d", 4, 4)])
    got = catalog.upsert_first_wins(stored, incoming, F.col("discovered_at")).collect()
    assert sorted((r["infohash"][0], r["name"]) for r in got) == [(1, "a"), (2, "c")]
    assert catalog.new_entries(stored, incoming, F.col("discovered_at")).count() == 1


def test_conversions(spark):
    row = spark.range(1).select(
        fmt.from_unix(F.lit(1577836799)).alias("a"), fmt.from_unix(F.lit(1577836801)).alias("b"), fmt.u48(F.lit((1 << 48) + 5)).alias("c"), fmt.parse_hash(F.lit("zz")).alias("d"),
        fmt.parse_hash(F.lit("AB" * 20)).alias("e"), fmt.size_binary(F.lit(1536)).alias("f"), fmt.size_decimal(F.lit(1500)).alias("g"), fmt.size_decimal(F.lit(999)).alias("h"), classify.label(F.lit(200)).alias("i"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], bytes(row["e"])) == (0, 1, 5, None, b"\xab" * 20)
    assert (row["f"], row["g"], row["h"], row["i"]) == ("1KB", "1.5KB", "999B", "other")


def test_display_sizes(spark):
    """Values written down from the rules: half to even of exact binary tenths; doubles below or above the midpoint."""
    binary = {0: "0KB", 1023: "0KB", 512_000: "500KB", 1_048_576: "1.0MB", 1_310_720: "1.2MB", 1_835_008: "1.8MB", 1_288_490_189: "1.2GB", 1_342_177_280: "1.2GB", 1_073_741_823: "1024.0MB"}
    decimal = {0: "0B", 999: "999B", 1000: "1.0KB", 1150: "1.1KB", 1250: "1.3KB", 1350: "1.4KB", 1450: "1.4KB", 1550: "1.6KB", 1750: "1.8KB", 999_999: "1000.0KB", 1_150_000: "1.1MB", 8_350_000_000: "8.3GB", 281_474_976_710_655: "281.5TB"}
    for f, want in ((fmt.size_binary, binary), (fmt.size_decimal, decimal)):
        rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", f(F.col("n")).alias("s")).collect()
        assert {r["n"]: r["s"] for r in rows} == want


def test_listing_rules(spark):
    rows = entries(spark, [(1, "a", 1, 5), (2, "b", 1, 5), (3, "c", 1, 4)])
    codes = spark.createDataFrame([(bytes([1]) * 20, 1)], "infohash binary, category tinyint")
    assert [r["name"] for r in catalog.recent(rows, codes).collect()] == ["b", "a", "c"]
    assert [r["name"] for r in catalog.recent(rows, codes, "movie").collect()] == ["a"]
    assert [r["name"] for r in catalog.recent(rows, codes, "other").collect()] == ["b", "c"]
    assert catalog.recent(rows, codes, "nonsense").count() == 3
    with pytest.raises(ValueError):
        catalog.point_lookup(rows, codes, "abc")
    assert catalog.point_lookup(rows, codes, "AA" * 20).count() == 0


def test_search_rules(spark):
    rows = entries(spark, [(i, "red fish" if i % 2 else "red bird", 1, i) for i in range(1, 8)])
    codes = spark.createDataFrame([(bytes([1]) * 20, 1), (bytes([3]) * 20, 2)], "infohash binary, category tinyint")
    index = catalog.postings(rows)
    names = lambda **k: [r["discovered_at"] - 1577836800 for r in search.search(rows, codes, index, k.pop("q", "red fish"), **k).collect()]
    assert names() == [7, 5, 3, 1]
    assert names(category="movie") == [7, 5, 1]
    assert names(limit=0) == []
    assert names(q="the red") == []
    assert names(q="the red", strict_stopwords=False) == [7, 6, 5, 4, 3, 2, 1]
    assert names(q="- !") == []
    assert names(cap=3) == [3, 1]


def test_pages_join_up_to_the_scan(spark, sf):
    from swarmlake.plans import corpus

    t = corpus.torrents(spark, sf)
    whole = [(r["discovered_at"], bytes(r["infohash"])) for r in t.orderBy("discovered_at", "infohash").limit(300).collect()]
    got, cursor = [], (0, bytes(20))
    while len(got) < 300:
        page = [(r["discovered_at"], bytes(r["infohash"])) for r in catalog.entries_after(t, *cursor, limit=100).collect()]
        got, cursor = got + page, page[-1]
    assert got == whole


def test_codecs_round_trip():
    e = {"infohash": b"\x01" * 20, "name": "naïve", "size": 7, "discovered_at": 9, "files": [("a/b", 3), ("c", 1 << 40)]}
    assert {**codecs.decode_entry(codecs.encode_entry(e)), "infohash": e["infohash"]} == e
    assert list(codecs.read_frames(codecs.write_frame(e) * 2 + b"\0\0")) == [e, e]
    assert codecs.write_frame(e | {"name": ""}) == b""
    dump = codecs.write_dump(e)
    assert list(codecs.read_dump(io.BytesIO(dump + dump[:10]))) == [e]
    with pytest.raises(codecs.Truncated):
        list(codecs.read_dump(io.BytesIO(dump[:40])))
    with pytest.raises(ValueError):
        codecs.decode_entry(b"")
    assert codecs.read_old_store(b"T" + e["infohash"], (1577836809).to_bytes(8, "big") + (7).to_bytes(8, "big") + b"\x02\x00\x01xrest")["name"] == "x"
    assert codecs.read_header(codecs.write_header((1, 2, 3, 4, 5))) == (1, 2, 3, 4, 5)


def test_bencode():
    value = {b"a": [1, b"xy", {b"k": -3}]}
    assert codecs.bdecode(codecs.bencode(value)) == (value, len(codecs.bencode(value)))
    for bad in (b"", b"i5", b"5:ab", b"d1:a", b"x", b"li1e"):
        with pytest.raises(ValueError):
            codecs.bdecode(bad)
    assert codecs.compact_nodes(bytes(26) + b"x") == []
    single = codecs.info_dict(codecs.bencode({"name": "n", "length": 5, "files": [{"length": 1, "path": ["q"]}]}))
    assert single == {"name": "n", "size": 5, "files": [("n", 5)]}
    many = codecs.info_dict(codecs.bencode({"name": "n", "files": [{"length": 7, "path": []}, {"length": 1, "path": ["d", "f"]}]}))
    assert many == {"name": "n", "size": 8, "files": [("d/f", 1)]}
    assert codecs.parse_message(b"junk") is None
    assert (codecs.announce_port(True, 5, 6), codecs.announce_port(False, 5, 6), codecs.announce_port(False, None, 6)) == (6, 5, 6)


def test_dump_files(spark, tmp_path):
    rows = entries(spark, [(1, "a", 1, 5), (2, "", 2, 6)])
    sink.write_dump(rows.coalesce(1), f"file://{tmp_path}/d")
    got = datasource.read_dump(spark, f"file://{tmp_path}/d").orderBy("discovered_at").collect()
    assert [(bytes(r["infohash"]), r["name"], r["size"], r["discovered_at"]) for r in got] == [(b"\x01" * 20, "a", 1, 5), (b"\x02" * 20, "", 2, 6)]


def test_cool_down_batch_and_stream_agree(spark, sf):
    from swarmlake.plans import corpus, registry

    e = corpus.table(spark, sf, "events").select("user_id", corpus.unix_seconds(F.col("ts")).alias("seconds"))
    batch = {tuple(r) for r in ingest.cool_down(e, "user_id", "seconds", registry.GAP, streaming=False).collect()}
    assert batch == {tuple(r) for r in registry.QUERIES["cooldown_dedup"](spark, sf).collect()}


def test_cool_down_state_ends_with_event_time(spark, tmp_path):
    """Ten days, a file each, with other keys every day: the state never holds more than the last days' keys."""
    gap, day = 3600, 86_400
    for d in range(1, 11):
        rows = [(d * 1000 + k, d * day + s) for k in range(200) for s in (0, 10, gap, gap + 5, 3 * gap)]
        spark.createDataFrame(rows, "k long, seconds long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run(days):
        stream = spark.readStream.schema("k long, seconds long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = ingest.cool_down(stream, "k", "seconds", gap).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/rows")
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    sizes = run(10)
    assert len(sizes) >= 10 and max(sizes) <= 3 * 2 * 200  # a value and a timer a key, of two days at most
    got = spark.read.parquet(f"file://{tmp_path}/rows")
    assert got.count() == 10 * 200 * 3 and got.groupBy("k").count().filter("count <> 3").count() == 0
    spark.createDataFrame([(1001, 10 * day + 3 * gap + 1), (10_001, 10 * day + 3 * gap + 1), (10_002, 10 * day + 4 * gap)], "k long, seconds long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run(1)  # after a restart a key of the first day is new again, those of the last day are as they were
    assert {(r["k"], r["seconds"]) for r in spark.read.parquet(f"file://{tmp_path}/rows").filter(F.col("seconds") > 10 * day + 3 * gap).collect()} == {(1001, 10 * day + 3 * gap + 1), (10_002, 10 * day + 4 * gap)}


def test_routing_table_goes_on_after_a_restart(spark, tmp_path):
    """Stopped in the middle of a batch and started anew between batches: the table of one run."""
    from swarmlake.operators import routing

    schema = "id string, insert_seq long, ip string, port int, at long, responded boolean, event_id long"
    sha = lambda i: F.sha1(F.concat(F.lit("c"), i.cast("string")))
    for n in range(4):
        i = F.col("id")
        rows = spark.range(n * 60, n * 60 + 120).select(sha(i).alias("id"), i.alias("insert_seq"), F.lit("10.0.0.1").alias("ip"), i.cast("int").alias("port"), (i + n).alias("at"), (i % 3 == 0).alias("responded"), (i + n * 1000).alias("event_id"))
        rows.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run(at, fail_at=None):
        table = ingest.Numbered(spark, f"file://{tmp_path}/{at}/table", "id string, ip string, port int, last_responded long, insert_seq long", lambda known, rows: routing.merged(known, rows, F.sha1(F.lit("s1"))))

        def batch(rows, n):
            table.batch(rows, n)
            if n == fail_at:
                raise ConnectionError("cut off")

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        try:
            ingest.run_available(stream, f"file://{tmp_path}/{at}/state", batch)
        except Exception:
            assert fail_at is not None
        return sorted(tuple(r) for r in table.rows().collect())

    whole = run("a")
    assert len(whole) == 80
    first, second = run("b", 0), run("b", 2)
    assert len(first) == 80 and first != second
    assert run("b") == whole and run("b") == whole


def test_replayed_batches_keep_their_rows(spark, tmp_path):
    store = ingest.Catalog(spark, f"file://{tmp_path}/c", ENTRY).create()
    names = lambda: sorted((r["name"], r["discovered_at"]) for r in store.rows().collect())
    first, second = entries(spark, [(1, "a", 1, 5), (2, "", 1, 6), (3, "b", 1, 7)]), entries(spark, [(3, "late", 1, 5), (4, "c", 1, 7)])
    for _ in range(2):
        store.append(first, 0, F.col("discovered_at"), arrived=100)
        assert names() == [("a", 100), ("b", 100)]
    for _ in range(2):
        store.append(second, 1, F.col("discovered_at"), arrived=200)
        assert names() == [("a", 100), ("b", 100), ("c", 200)]
    store.append(first, 0, F.col("discovered_at"), arrived=100)
    assert names() == [("a", 100), ("b", 100), ("c", 200)]


def test_stable_bloom():
    bloom = codecs.StableBloom(1000)
    keys = [i.to_bytes(20, "little") for i in range(1, 50)]
    assert not bloom.test_and_add(keys[0]) and bloom.test_and_add(keys[0])


def test_bencode_numbers_are_strict():
    for bad in (b"i1_0e", b"i+5e", b"i 5e", b"i05e", b"i-0e", b"+2:ab", b"0_2:ab", b"02:ab"):
        with pytest.raises(ValueError):
            codecs.bdecode(bad)
    assert codecs.bdecode(b"i-12e") == (-12, 5) and codecs.bdecode(b"0:") == (b"", 2)


def test_messages_written_by_hand():
    """The examples of the published protocol, byte by byte, and what a peer gets wrong."""
    read = codecs.parse_message
    ping = read(b"d1:ad2:id20:abcdefghij0123456789e1:q4:ping1:t2:aa1:y1:qe")
    assert (ping["kind"], ping["method"], ping["transaction"], ping["id"]) == ("q", "ping", b"aa", b"abcdefghij0123456789")
    find = read(b"d1:ad2:id20:abcdefghij01234567896:target20:mnopqrstuvwxyz123456e1:q9:find_node1:t2:aa1:y1:qe")
    assert (find["method"], find["target"]) == ("find_node", b"mnopqrstuvwxyz123456")
    peers = read(b"d1:rd2:id20:abcdefghij01234567895:token8:aoeusnth6:valuesl6:axje.u6:idhtnmee1:t2:aa1:y1:re")
    assert peers["kind"] == "r" and peers["peers"] == [("97.120.106.101", 11893), ("105.100.104.116", 28269)]
    announce = read(b"d1:ad2:id20:abcdefghij012345678912:implied_porti1e9:info_hash20:mnopqrstuvwxyz1234564:porti6881e5:token8:aoeusnthe1:q13:announce_peer1:t2:aa1:y1:qe")
    assert (announce["port"], announce["implied"], announce["target"]) == (6881, True, b"mnopqrstuvwxyz123456")
    assert read(b"d1:eli201e23:A Generic Error Ocurrede1:t2:aa1:y1:ee")["error"] == 201
    # Keys out of order and bytes behind the message are read; wrong lengths, cut ends and other kinds of values are not.
    assert read(b"d1:y1:q1:t2:aa1:q4:ping1:ad2:id20:abcdefghij0123456789eetrailing")["method"] == "ping"
    for bad in (b"d1:ad2:id-1:abe1:q4:ping1:t2:aa1:y1:qe", b"d1:ad2:id99:abcdefghij0123456789e1:q4:ping1:t2:aa1:y1:qe", b"d1:ad2:id20:abcdefghij0123456789e1:q4:ping1:t2:aa1:y1:q", b"d1:t2:aa1:yi1ee", b"l1:t2:aae", b"d1:ti5e1:y1:qe"):
        assert read(bad) is None, bad
    short = read(b"d1:ad2:id19:abcdefghij012345678e1:q4:ping1:t2:aa1:y1:qe")
    assert short["method"] == "ping" and short["id"] is None


def test_frames_written_by_hand():
    """Two sync frames byte by byte: lengths big-endian, a name of two characters and three bytes, a list of one file."""
    raw = bytes.fromhex("0003" + "11" * 20 + "0000000a" + "000000000100" + "61c3a9" + "0001" + "0000000000000007" + "0001" + "66" + "0001" + "22" * 20 + "00000000" + "000000000000" + "62" + "0000" + "0000")
    first, second = codecs.read_frames(raw + b"behind the end")
    assert first == {"infohash": b"\x11" * 20, "name": "aé", "size": 256, "discovered_at": 10, "files": [("f", 7)]}
    assert second == {"infohash": b"\x22" * 20, "name": "b", "size": 0, "discovered_at": 0, "files": []}
    with pytest.raises(codecs.Truncated):
        list(codecs.read_frames(raw[:40]))


def test_pieces_and_handshakes():
    data = bytes(range(256)) * 100
    cut = [codecs.piece_message(codecs.DATA, i // codecs.PIECE, data[i : i + codecs.PIECE]) for i in range(0, len(data), codecs.PIECE)]
    assert codecs.assembled([*reversed(cut), b"junk"], len(data)) == data
    assert codecs.assembled(cut, 0) is None
    assert codecs.assembled(cut[:1], len(data)) is None and codecs.assembled([codecs.piece_message(codecs.REJECT, 0), *cut], len(data)) is None
    h = b"\x07" * 20
    assert codecs.handshake_error(codecs.handshake(h), h) is None and codecs.handshake_error(codecs.handshake(h), bytes(20)) == "infohash"
    assert codecs.extension_error(b"\x14\x00" + codecs.bencode({"m": {"ut_metadata": 1}, "metadata_size": 1})) is None


def test_nodes_match_by_id_or_address(spark):
    from swarmlake.operators import routing

    table = spark.createDataFrame([("aa", "1.1.1.1", 1, 0), ("aa", "2.2.2.2", 1, 1), ("bb", "3.3.3.3", 1, 2)], "id string, ip string, port int, insert_seq long")
    seen = spark.createDataFrame([("aa", "9.9.9.9", 1), ("cc", "3.3.3.3", 1), ("dd", "4.4.4.4", 1)], "id string, ip string, port int")
    assert sorted((r["id"], r["matched"]) for r in routing.upserted(table, seen).collect()) == [("aa", 0), ("cc", 2), ("dd", None)]
