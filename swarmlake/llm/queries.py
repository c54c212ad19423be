"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .common import Scratch, table
from .chat import digests, format_events, message_events
from .exact_dedup import exact_dedup
from .fm_index import find_spans
from .html_extract import extract_text
from .merkle import manifest
from .packing import pack
from .prob_minhash import near_duplicates
from .quality import score_quality
from .secret_scan import scan
from .sharding import histogram_shards
from .sweep_join import band_join
from .toxicity import score_toxicity
from .warc import read_archives, resolved, write_archives


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), scratch.path("archives"))
    records = scratch.stage(read_archives(spark, scratch.path("archives")), "records")
    return resolved(records).select(
        "page_id", F.col("payload_bytes").cast("long").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_events(message_events(rows, chunk=400, restarts=True)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Digest columns of the packed pieces; also the last stage of the pipeline."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"), shards=40)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"), ranks=5)


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_toxicity, op3_benchmark_decontamination, op4_chat_formatting, op5_packing, op6_quality_classifier, op7_exact_dedup, op8_sharding, op9_minhash_near_dedup, op10_html_extraction, op11_secret_scan, op12_merkle_manifest, op13_band_join)}


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, for an engine without such a function: two steps of four bits a byte."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    step = lambda c, b: f"xor({table}[(xor({c}, {b}) & 15) + 1], {c} >> 4)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {step(step('c', 'b'), '(b >> 4)')}, 4294967295::BIGINT), 4294967295)"


def _climb_sql(nodes: str, paths: str, levels: int, tag: str) -> str:
    """Common tables that lead a forest's `nodes` (g, pos, n, h) and rows (g, pos, cur, sib, ...) beside them `levels` levels up; {paths}{levels} has the result."""
    out = []
    for k in range(levels):
        a, b, at = (nodes if k == 0 else f"{tag}n{k}"), (paths if k == 0 else f"{tag}p{k}"), f"pos // {3**k}"
        run = "OVER (PARTITION BY g, pos // 3 ORDER BY pos ROWS BETWEEN"
        out += [
            f"{tag}r{k} AS (SELECT g, pos AS at, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a})",
            f"{tag}p{k + 1} AS (SELECT p.* REPLACE (CASE WHEN n = 1 THEN cur ELSE sha256(l || cur || r) END AS cur, CASE WHEN n = 1 THEN sib ELSE sib || l || r END AS sib) FROM {b} p JOIN {tag}r{k} r ON p.g = r.g AND p.{at} = r.at)",
            f"{tag}n{k + 1} AS (SELECT g, pos // 3 AS pos, CASE WHEN n = 1 THEN 1 ELSE (n + 2) // 3 END AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {a} GROUP BY g, pos // 3, n)",
        ]
    return ", ".join(out)


def _merkle_sql(levels: int = 11, top_levels: int = 5) -> str:
    """Up to 3^levels rows of a source and 3^top_levels sources."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    return f"""
        WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf,
                {leaf("(CASE WHEN " + crc32_sql('doc_id::VARCHAR') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS bad FROM documents),
        s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
        nodes AS (SELECT g, pos, n, leaf AS h FROM s), paths AS (SELECT doc_id, leaf, g, pos, bad AS cur, '' AS sib FROM s),
        {_climb_sql('nodes', 'paths', levels, 'a')},
        subs AS (SELECT g AS name, h AS sub, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM an{levels}),
        tops AS (SELECT 0 AS g, pos, n, sub AS h FROM subs), tpaths AS (SELECT doc_id, leaf, sub, 0 AS g, subs.pos, cur, sib FROM ap{levels} p JOIN subs ON p.g = subs.name),
        {_climb_sql('tops', 'tpaths', top_levels, 'b')}
        SELECT doc_id, leaf, sub AS subroot, h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM bp{top_levels}, bn{top_levels}
    """


ORACLE_SQL = {
    "op12_merkle_manifest": _merkle_sql(),
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT h, max(page_id) AS keep FROM p WHERE strlen(h) >= 1000 GROUP BY h)
        SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
            CASE WHEN g.keep IS NOT NULL AND g.keep <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN g.keep <> p.page_id THEN g.keep END AS refers_to
        FROM p LEFT JOIN g ON p.h = g.h
    """,
    "op3_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS phrase
            FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
        places AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i + 1, i + k), ' ') AS phrase
            FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        hits AS (SELECT DISTINCT doc_id, p.k, i, item_id FROM places p JOIN windows USING (phrase)),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op4_chat_formatting": """
        WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        esc AS (SELECT *, replace(replace(text, '\\', '\\\\'), '<', '\\<') AS body FROM said)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(role) + length(body) + length('<turn >') + length('</turn>') + 2)::BIGINT AS formatted_chars
        FROM esc GROUP BY conv_id
    """,
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op13_band_join": f"""
        WITH lines AS (SELECT sale_id, line_no, item_id, quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) * 2 + quantity AS top FROM sale_lines
                WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND amount IS NOT NULL),
        l AS (SELECT sale_id, line_no, item_id, (top * sign(quantity)::BIGINT - ((top * sign(quantity)::BIGINT) % abs(2 * quantity) + abs(2 * quantity)) % abs(2 * quantity)) // abs(2 * quantity) AS u,
                {crc32_sql("sale_id || ',' || coalesce(line_no::VARCHAR, '') || ',' || item_id")} AS c FROM lines),
        i AS (SELECT row_number() OVER () AS k, item_id, p, greatest(10, CAST(floor(p / 500.0) AS BIGINT)) AS w FROM (SELECT item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items)),
        pairs AS (SELECT k, abs(u - p) AS gap, u, sale_id, line_no, l.item_id AS line_item_id, c FROM i JOIN l ON u BETWEEN p - w AND p + w WHERE l.item_id <> i.item_id),
        sums AS (SELECT k, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(c) AS lines_crc FROM pairs GROUP BY k),
        best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM pairs QUALIFY rank <= 5)
        SELECT item_id, coalesce(rank, 0)::INTEGER AS rank, gap::BIGINT AS gap, u::BIGINT AS u, sale_id, line_no::BIGINT AS line_no, line_item_id,
            coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(gap_sum, 0)::BIGINT AS gap_sum, coalesce(lines_crc, 0)::BIGINT AS lines_crc
        FROM i LEFT JOIN sums USING (k) LEFT JOIN best USING (k)
    """,
}
