"""Exact operators: WARC, exact dedup, sharding, packing, chat, decontamination."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from swarmlake.llm import chat, fm_index, packing, queries, warc
from swarmlake.llm.common import words
from swarmlake.llm.exact_dedup import exact_dedup
from swarmlake.llm.sharding import histogram_shards, write_shards

LONG = "A very long line. " * 400
ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "äBC"), (6, "Äbc"), (7, LONG), (8, LONG.upper()), (8, LONG.upper()), (9, LONG + "x"), (None, "Abc"), (None, None), (10, "abc")]
DOCS = "doc_id long, text string, name string, _id long, hash string"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "n", 0, "h") for i, t in rows], DOCS)


def plain(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.apply(lambda s: s.astype(float) if s.dtype.kind in "ifu" or str(s.dtype).startswith("Int") else s.fillna("-").astype(str))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert plain(got).equals(plain(want))


@pytest.mark.parametrize("block", [3, 1024])
def test_exact_dedup(spark, block):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t in ROWS:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(documents(spark), block_bytes=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup(documents(spark, [])).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def shards_hold(rows, shards, whole=0.05, tolerance=0.001):
    """Slots are gapless; bytes before a boundary are as near to their target as the docstring says; small groups are whole."""
    by, groups = {}, {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        groups.setdefault((r["size"], r["text_crc32"]), []).append(r)
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by.values())
    assert set(by) <= set(range(shards))
    share = sum(r["size"] for r in rows) / shards
    slack = max(share * whole, max(r["size"] for r in rows)) / 2 + max(1, share * tolerance) + 1
    before = 0
    for s in range(shards - 1):
        before += sum(x["size"] for x in by.get(s, []))
        assert abs(before - share * (s + 1)) <= slack
    cut = [own for own in groups.values() if len({r["shard"] for r in own}) > 1]
    assert all(sum(r["size"] for r in own) > share * whole for own in cut)
    return cut


def test_sharding(spark, sf):
    rows = queries.op8_sharding(spark, sf).collect()
    texts = {i: t for i, t in duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 16, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)
    shards_hold(rows, 40)


def test_sharding_edges(spark, tmp_path):
    assert histogram_shards(documents(spark, [])).count() == 0
    rows = histogram_shards(documents(spark), shards=3).collect()
    assert len(rows) == len(ROWS) and sum(r["size"] == 16 for r in rows) == 3
    hot = [(i, "same text" if i % 3 else f"text {i % 600}") for i in range(3000)]
    rows = histogram_shards(documents(spark, hot), shards=8).collect()
    assert len(rows) == 3000
    assert len(shards_hold(rows, 8)) == 1  # the text of two thirds of the rows is cut, no other
    write_shards(documents(spark, [*hot, (5000, "very long " * 100_000), (None, None)]), str(tmp_path / "s"), shards=8)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(back) == 3002 and {r["name"] for r in back} == {"n"}
    want = {r["doc_id"]: r["shard"] for r in histogram_shards(documents(spark, [*hot, (5000, "very long " * 100_000), (None, None)]), shards=8).collect()}
    assert {r["doc_id"]: r["shard"] for r in back} == want
    with pytest.raises(ValueError):
        write_shards(documents(spark).withColumn("shard", F.lit(1)), str(tmp_path / "t"))


@pytest.mark.parametrize("limit", [1000, 0])
def test_warc(spark, tmp_path, limit):
    big = "ü" * 600
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "\r\n\r\nWARC/1.1\r\n"), (4, "u", "\r\n\r\nWARC/1.1\r\n"), (5, "u", None), (6, "u", big), (6, "u", big), (None, "u", big), (7, "u", "x" * 1000), (8, "u", ""), (9, "u", "long é" * 200_000)]
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, record_id string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, file_bytes=600, max_broadcast=limit)
    got = warc.resolved(warc.read_archives(spark, path)).collect()
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i != max(x[0] for x in pages if x[2] == h and x[0] is not None)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 6 if again else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_sha1"], r["warc_type"], r["refers_to_page"]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["payload_digest"] == r["payload_sha1"] for r in got)
    warc.write_archives(df.limit(0), f"{path}0")
    assert warc.read_archives(spark, f"{path}0").count() == 0


def test_archives_are_members_that_stand_alone(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h/{i}", f"page {i} " * 300) for i in range(20)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", file_bytes=3000)
    files = sorted(tmp_path.glob("w/part-*"))
    assert len(files) > 2 and sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: response") for f in files) == 20
    packed = files[0].read_bytes()
    starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08\x00", packed)]
    for a in starts:
        assert zlib.decompressobj(31).decompress(packed[a:]).startswith(b"WARC/1.1\r\n")
    for cut in (packed[: starts[1] + 5], packed[: starts[0]] + packed[starts[1] :]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(cut))
    # Members of other writers may hold several records, or one be spread over several members.
    whole = gzip.decompress(packed)
    again = b"".join(gzip.compress(whole[i : i + 700]) for i in range(0, len(whole), 700))
    assert list(warc.parse_archive(again)) == list(warc.parse_archive(packed)) == list(warc.parse_archive(gzip.compress(whole)))


def test_a_payload_of_many_captures(spark, tmp_path):
    """Most captures share a payload: what is known about it is broadcast, in both joins."""
    rows = [(i, "u", "y" * 2000 if i % 4 else f"{i} " * 600) for i in range(1600)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["page_id"]: (r["warc_type"], r["refers_to_page"], r["payload_bytes"]) for r in warc.resolved(warc.read_archives(spark, path)).collect()}
    assert got == {i: ("response", None, len(h)) if i % 4 == 0 or i == 1599 else ("revisit", 1599, 2000) for i, _, h in rows}


def test_word_cache_gives_the_tokenizers_ids(sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    texts += ["", "  ", "İstanbul I'LL don't 12ab3 ''s x", "é H̱ ΑΣ Σ", "a\tb\r\nc d e\x1cf", "<|endoftext|> x", "日本 語!?", "#$%&!! --", "ﬁ ǅ ß"]
    cache = packing.WordCache(path, limit=500)
    assert cache.by_word
    for at in range(0, len(texts), 20):  # the small limit turns the cache over again and again
        part = texts[at : at + 20]
        assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode(part)] == [whole.encode(t, add_special_tokens=False).ids for t in part]
    other = packing.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word and len(other.encode(["Hello world"])[0]) == 8


def test_packing(spark):
    rows = [*ROWS, (11, "word " * 30000)]
    pieces = packing.pack(documents(spark, rows), public_tokenizers.path("word_bpe_49k.json"), block_tokens=5000).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect = sorted([i or -1, *whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows)
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == own[0]["sequence_length"] and (at == 4096 or at & (at - 1) == 0)
    assert sum(p["length"] for p in pieces) == sum(len(x) - 1 for x in expect)
    (long,) = [v for k, v in by_doc.items() if k[0] == 11]
    ids = b"".join(bytes(p["ids"]) for p in sorted(long, key=lambda p: p["start"]))
    assert np.frombuffer(ids, "<u4").tolist() == whole.encode("word " * 30000, add_special_tokens=False).ids + [2]
    assert packing.pack(documents(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_costs_are_balanced():
    lengths = np.array([100] * 70 + [1500, 1500, 1500, 1500, 500, 500, 288])
    pieces, sizes = packing.assign(lengths, 4096, 1 / 2048)
    cost = np.bincount(pieces[:, 3], pieces[:, 2] + pieces[:, 2] ** 2 / 2048)[sizes == 4096]
    assert cost.max() / cost.min() < 1.3


def test_chat_fold_and_escape(spark):
    events = [
        (1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "he"), (1, 0, 2, "delta", None, "llo"), (1, 1, 3, "start", "assistant", None), (1, 1, 4, "delta", None, "bad"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "good"), (1, 70, 7, "start", "user", None), (1, 70, 8, "delta", None, "void"), (1, 0, 9, "edit", None, "edited"),
        (1, 1, 10, "start", "assistant", None), (1, 1, 11, "delta", None, "a<b\\</turn>"), (2, None, None, "start", None, None), (None, 0, 0, "delta", "assistant", "x"),
    ]
    df = spark.createDataFrame([(*e, "z") for e in events], "conv_id long, turn long, seq long, kind string, role string, text string, block string")
    got = {r["conv_id"]: list(chat.parse(r["formatted"])) for r in chat.format_events(df).collect()}
    assert got == {1: [("user", "edited"), ("assistant", "a<b\\</turn>")], 2: [("", "")], None: [("assistant", "x")]}
    rng = random.Random(3)
    for _ in range(300):
        role, said = ("".join(rng.choices("<>\\/turn \nä", k=rng.randrange(9))) for _ in range(2))
        text, span = chat.render(role, said, frozenset({role}))
        assert list(chat.parse(text)) == [(role, said)] and chat.unescaped(text[span[0] : span[1]]) == said
    assert chat.format_events(df.limit(0)).count() == 0


def test_chat_nulls_in_every_column(spark):
    """No event of a log with nulls in any column, after an edit too, stops the fold; the rules of the docstring hold."""
    rows = [(1, 0, 5, "start", "user", None), (1, 0, 6, "delta", None, "a"), (1, 0, 9, "edit", None, "b"), (1, 1, None, "start", "assistant", None), (1, 1, None, "delta", None, "void"), (1, 1, 10, "delta", "assistant", "c"),
            (1, 1, 11, None, "x", "skipped"), (1, None, 3, "start", None, None), (1, None, None, None, None, None), (None, None, None, "edit", None, None), (2, 0, None, None, None, "nothing")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = {r["conv_id"]: [x for b in sorted(y for y in chat.format_events(df).collect() if y["conv_id"] == r["conv_id"]) for x in chat.parse(b["formatted"])] for r in chat.format_events(df).collect()}
    assert got == {1: [("", ""), ("user", "b"), ("assistant", "c")], None: [("", "")]}


def test_chat_log_of_restarts(spark):
    """All four kinds of event, in turns that repeat a number as well, fold to what was said."""
    rows = [(c, t, role, f"{role} {t} <x> \\ ünd " * (1 + t % 9 * 20)) for c in range(3) for t in range(130) for role in ("user", "assistant")] + [(5, None, "user", None), (5, 1 << 40, "user", "far"), (5, 1 << 41, "user", "farther")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.message_events(df, chunk=400, restarts=True)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(chat.EVENTS)
    plain = chat.digests(chat.format_events(chat.message_events(df))).collect()
    assert sorted(chat.digests(chat.format_events(log)).collect()) == sorted(plain) and len(plain) == 4


def test_chat_long_texts_edits_and_regenerations(spark):
    """A random log against a plain fold of its events in order, and a text of many deltas."""
    rng, log, seq = random.Random(7), [], 0
    state: dict[int, dict[int, tuple[str, str]]] = {}
    for _ in range(1500):
        conv, turn = rng.randrange(3), rng.randrange(150)
        own, kind, text = state.setdefault(conv, {}), rng.choice(["start", "delta", "delta", "edit", "regenerate"]), f"<x{seq}\\>"
        seq += 1
        if kind == "start":
            own[turn] = ("assistant", "")
            log.append((conv, turn, seq, "start", "assistant", None))
        elif kind == "delta":
            role, said = own.get(turn, ("", ""))
            own[turn] = (role, said + text)
            log.append((conv, turn, seq, "delta", None, text))
        elif kind == "edit":
            own[turn] = (own.get(turn, ("", ""))[0], text)
            for later in [t for t in own if t > turn]:
                del own[later]
            log.append((conv, turn, seq, "edit", None, text))
        else:
            if turn in own:
                own[turn] = (own[turn][0], "")
            log.append((conv, turn, seq, "regenerate", None, None))
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    rendered = chat.format_events(df).orderBy("conv_id", "block").collect()
    got = {}
    for r in rendered:
        got.setdefault(r["conv_id"], []).extend(chat.parse(r["formatted"]))
    assert got == {c: [own[t] for t in sorted(own)] for c, own in state.items()}
    said = "".join(rng.choices("ab<\\> ü\n", k=90_000))
    one = spark.createDataFrame([(1, 0, "assistant", said)], "conv_id long, turn long, role string, text string")
    events = chat.message_events(one, chunk=1000)
    assert events.count() == 92
    got = chat.digests(chat.format_events(events)).first()
    assert (got["loss_chars"], got["loss_sha256"]) == (90_000, hashlib.sha256(said.encode()).hexdigest())


def test_chat_one_conversation_over_many_blocks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(1000)] + [(1, 5, "user", "again"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.format_events(chat.message_events(df))
    assert rendered.count() == 17
    got = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    ordered = sorted(rows[:-1], key=lambda r: (r[1], r[2], r[3]))
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in ordered).encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["turns_sha256"]) == (1, hashlib.sha256(b"\n\n").hexdigest())


def brute_spans(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_decontamination_is_brute_force(spark, sf):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices(["a", "b", "ab", "Ä", "c1"], k=n))
    items = [(i, some(rng.choice([3, 9, 10, 11, 14]))) for i in range(12)] + [(12, None), (13, " . "), (14, "c1"), (0, "ab Ä ab"), ("b-2", some(9)), ("B/2", some(10)), (None, some(11))]
    docs = [(i, some(rng.randrange(60)) + rng.choice(["", " zz ", "! "]) + some(rng.randrange(60))) for i in range(60)] + [(61, None), (62, ""), (62, items[0][1]), (None, items[0][1].upper().replace("Ä", "Ä"))]
    bench = spark.createDataFrame([(i if i is None else str(i), t) for i, t in items], "item_id string, text string")
    for options in ({}, {"shard_words": 1}, {"max_item_words": 60}, {"max_item_words": 25, "shard_words": 100}):
        got = fm_index.find_spans(documents(spark, docs).coalesce(1), bench, **options).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=str) == brute_spans(docs, items)
        assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)
    assert fm_index.find_spans(documents(spark, []), bench).count() == 0
    none = fm_index.find_spans(documents(spark, docs), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    clash = documents(spark, docs).withColumnsRenamed({"name": "spans", "hash": "n_hit"}).withColumn("items", F.lit(1)).withColumn("_row", F.lit(2))
    clean = [r["doc_id"] for r in fm_index.decontaminate(clash, bench).collect()]
    assert sorted(clean, key=str) == sorted((i for i, _, n, _ in brute_spans(docs, items) if not n), key=str)
    cut = fm_index.without_spans(clash, bench)
    assert cut.columns == clash.columns
    left = [r["text"] for r in cut.collect()]
    assert sum(len(words(t)) for t in left) == sum(n - k for _, n, k, _ in brute_spans(docs, items))
    con = duckdb.connect()
    tables = [con.execute(f"SELECT * FROM '{sf}/benchmark.parquet'").fetchall(), con.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    want = [(i, n, k, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), k > 0) for i, n, k, x in brute_spans(tables[1], tables[0])]
    assert sorted(map(tuple, queries.op3_benchmark_decontamination(spark, sf).collect())) == sorted(want)


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400).astype(np.int32)
    text[-1] = 0
    order = fm_index.suffix_order(text)
    zeros = np.cumsum(text == 0)
    key = [[(0, zeros[j]) if text[j] == 0 else (1, text[j]) for j in range(i, min(i + 40, 400))] for i in range(400)]
    assert order.tolist() == sorted(range(400), key=lambda i: key[i])
    index = fm_index.FMIndex(text, 3, sample=7)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            phrase = rng.integers(1, 4, n).astype(np.int32)
            low, high = index.search(phrase[None, :], np.array([n]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(400 - n + 1) if np.array_equal(text[i : i + n], phrase)]
