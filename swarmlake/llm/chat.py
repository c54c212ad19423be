"""Chat formatting from an event log.

The log is dealt by conversation and block of turns, so that one long conversation spreads over
tasks, and sorted by turn and sequence. A streaming pass folds the deltas, edits and regenerations
of a turn into its final message; what an edit of an earlier turn makes void is found beforehand
from pre-aggregated sequence numbers. Messages are rendered with a loss mask, a row per block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events of a turn. `start` begins it with a role and `delta` appends text; `edit` replaces the text
#: and makes void what later turns said before it; `regenerate` drops the text, for new deltas.
EVENTS = ("start", "delta", "edit", "regenerate")
RENDERED = "conv_id long, block long, formatted string, loss array<struct<start:long,end:long>>, n_turns long"
BLOCK = 64


def escaped(text: str) -> str:
    """`\\` and `<` get a `\\` before them, so an unescaped `<` always begins a mark of the template."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escaped_role(role: str) -> str:
    return escaped(role).replace(">", "\\>")


_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str, trained: frozenset[str] = frozenset({"assistant"})) -> tuple[str, tuple[int, int] | None]:
    """A turn's marked text, and where in it the loss counts, if the role is trained."""
    head, body = f"<turn {escaped_role(role)}>\n", escaped(text)
    return f"{head}{body}</turn>\n", (len(head), len(head) + len(body)) if role in trained else None


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of the turns of a rendered block."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside a turn")
        at = m.end()
        yield unescaped(m[1]), unescaped(m[2])
    if at != len(formatted):
        raise ValueError("text outside a turn")


def fold(events: list[tuple[int, str, str | None, str | None]], void_before: int | None) -> tuple[str, str] | None:
    """The final role and text of one turn's events (seq, kind, role, text), or None if all are void."""
    role, parts, alive = "", [], False
    for seq, kind, who, text in events:
        if void_before is not None and seq < void_before:
            continue
        if kind == "start":
            role, parts, alive = who or "", [], True
        elif kind == "delta":
            parts.append(text or "")
            alive = True
        elif kind == "edit":
            parts, alive = [text or ""], True
        elif kind == "regenerate":
            parts = []
        elif kind is None:
            continue
        else:
            raise ValueError(f"unknown event {kind!r}")
        if who is not None:
            role = who
    return (role, "".join(parts)) if alive else None


def format_events(events: DataFrame, trained: tuple[str, ...] = ("assistant",), block: int = BLOCK) -> DataFrame:
    """Render a log (conv_id, turn, seq, kind, role, text): a row per conversation and block of turns.

    A column `sub`, if there is one, tells turns of one number apart.

    Blocks hold `block` numbers of turns; `formatted` of a conversation is that of its blocks in
    order, and `loss` are code points in the block's own text. Rows of one seq are taken in the
    order of kind, role and text. Null texts are empty, null roles the empty role, null turns and
    conversations a turn and a conversation of their own, before all others; a null seq stands before all
    others of its turn, and before every edit. Events of null kind are skipped; those of an unknown kind are an
    error. A very long text comes in
    many deltas; one turn's text must fit a worker. Without events there is no row. Extra columns are
    not read.
    """
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"),
        (F.col("sub").cast("long") if "sub" in events.columns else F.lit(0).cast("long")).alias("sub"),
        F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / block).cast("long"))
    # The latest edit of a block's earlier blocks, from a row per conversation and block.
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edits = rows.groupBy("conv_id", "block").agg(F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("_e")).select("conv_id", "block", F.max("_e").over(earlier).alias("void")).filter("void is not null")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.block") == F.col("b.block"))
    rows = rows.alias("a").join(edits.alias("b"), same, "left").select("a.*", "void")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "sub", "seq", "kind", "role", "text")
    roles = frozenset(trained)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span)), ("n_turns", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, void, turn, held = [], None, None, None, []
        parts, loss, size, count = [], [], 0, 0

        def end_turn() -> None:
            nonlocal held, void, size, count
            if held and (said := fold(held, void)):
                text, span = render(*said, roles)
                if span:
                    loss.append({"start": size + span[0], "end": size + span[1]})
                parts.append(text)
                size, count = size + len(text), count + 1
            for seq, kind, _, _ in held:
                if kind == "edit" and (void is None or seq > void):
                    void = seq
            held = []

        def end_block() -> None:
            nonlocal parts, loss, size, count
            if key is not None and parts:
                out.append({"conv_id": key[0], "block": key[1], "formatted": "".join(parts), "loss": loss, "n_turns": count})
            parts, loss, size, count = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return batch

        for batch in batches:
            cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("conv_id", "block", "turn", "sub", "seq", "kind", "role", "text", "void")]
            for conv, block_, number, sub, seq, kind, role, text, void_ in zip(*cols, strict=True):
                turn_ = (number, sub)
                if key != (conv, block_):
                    end_turn(), end_block()
                    key, void, turn = (conv, block_), void_, turn_
                elif turn != turn_:
                    end_turn()
                    turn = turn_
                held.append((seq, kind, role, text))
                if len(out) >= 500:
                    yield flush()
        end_turn(), end_block()
        yield flush()

    return rows.mapInArrow(run, RENDERED)


def message_events(messages: DataFrame, chunk: int = 4_000, restarts: bool = False) -> DataFrame:
    """The log of messages (conv_id, turn, role, text) as they were written: a start and its deltas.

    Each row is a turn of its own, also where rows repeat one turn number (`sub` counts them); such
    rows come in the order of role and text. With `restarts` the log is that of a busy session: of three turns in
    turn one is as said; one breaks off within a wrong answer (its pieces backwards) and is regenerated; one is said
    wrong and then edited, before anything of later turns is said.
    """
    per_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sub", F.row_number().over(per_turn).cast("long"))
    null = F.lit(None).cast("string")
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    last = F.floor(F.length("text") / chunk).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), last), lambda i: event("delta", null, F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))))
    start = F.array(event("start", F.col("role"), null))
    said = F.concat(start, deltas)
    if restarts:
        wrong = F.concat(F.array(event("delta", null, F.lit("Not so: "))), F.reverse(deltas))
        again = F.concat(start, F.slice(wrong, F.lit(1), (last / 2).cast("int") + 1), F.array(event("regenerate", null, null)), deltas)
        edited = F.concat(start, wrong, F.array(event("edit", null, F.col("text"))))
        way = F.pmod(F.coalesce(F.col("turn"), F.lit(0)) + F.col("sub"), F.lit(3))
        first = (F.col("sub") == 1) & (F.abs(F.col("turn")) < 1 << 30)  # so no edit comes after what a later turn says
        said = F.when(way == 0, again).when((way == 1) & first, edited).otherwise(said)
    log = rows.select("conv_id", "turn", "sub", F.posexplode(said).alias("seq", "e"))
    if not restarts:
        return log.select("conv_id", "turn", "sub", "seq", "e.*")
    # An edit makes void what later turns said before it, so the sequence goes on from turn to turn.
    turn = F.least(F.greatest(F.coalesce(F.col("turn"), F.lit(-(1 << 30))), F.lit(-(1 << 30))), F.lit(1 << 30))
    at = turn * F.lit(1 << 32) + F.least(F.col("sub"), F.lit(255)) * F.lit(1 << 24) + F.col("seq")
    return log.select("conv_id", "turn", "sub", at.alias("seq"), "e.*")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered blocks: counts and SHA-256 of turns and loss.

    A SHA-256 over a conversation is one sequence of steps, so its blocks, one row for many turns,
    stream through one task in order; nothing but the two hash states is held.
    """
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, state = [], None, None

        def end() -> None:
            if state:
                rows.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])
            rows.clear()
            return batch

        for batch in batches:
            cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("conv_id", "formatted", "loss")]
            for conv, text, loss in zip(*cols, strict=True):
                if key != (conv,):
                    end()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                if len(rows) >= 5000:
                    yield flush()
        end()
        yield flush()

    return ordered.mapInArrow(run, DIGESTS)
