"""Binary layouts: dump records, stored entries, sync frames, bencode and the messages in it."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from io import BufferedIOBase
from typing import Any

from ..schema import EPOCH_OFFSET, U48_MASK

Entry = dict[str, Any]  # infohash, name, size, discovered_at, files [(path, size)]


class Truncated(ValueError):
    """The bytes end inside a record."""


class Reader:
    """Big-endian fields from bytes or a stream."""

    def __init__(self, source: bytes | BufferedIOBase):
        self.data, self.at = (source, 0) if isinstance(source, bytes) else (None, source)

    def take(self, n: int) -> bytes:
        if self.data is None:
            got = self.at.read(n)
        else:
            got = self.data[self.at : self.at + n]
            self.at += len(got)
        if len(got) < n:
            raise Truncated(f"wanted {n} bytes, got {len(got)}")
        return got

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def text(self, n: int) -> str:
        return self.take(n).decode("utf-8", "replace")


def _u16(n: int) -> bytes:
    return min(n, 0xFFFF).to_bytes(2, "big")


def _files(files: list[tuple[str, int]]) -> bytes:
    """Count and records of files; counts and paths are cut at 65,535."""
    out = [_u16(len(files))]
    for path, size in files[:0xFFFF]:
        raw = path.encode("utf-8", "replace")[:0xFFFF]
        out += [(size & (1 << 64) - 1).to_bytes(8, "big"), _u16(len(raw)), raw]
    return b"".join(out)


def _read_files(r: Reader, whole: bool) -> list[tuple[str, int]]:
    """`whole`: a cut list is an error; else its complete beginning is kept."""
    files: list[tuple[str, int]] = []
    try:
        for _ in range(r.number(2)):
            size = r.number(8)
            files.append((r.text(r.number(2)), size))
    except Truncated:
        if whole:
            raise
    return files


def from_unix(seconds: int) -> int:
    return max(0, seconds - EPOCH_OFFSET) & 0xFFFFFFFF


def write_dump(e: Entry) -> bytes:
    name = e["name"].encode("utf-8", "replace")[:0xFFFF]
    return e["infohash"] + struct.pack(">QQH", e["discovered_at"] + EPOCH_OFFSET, e["size"], len(name)) + name + _files(e["files"])


def read_dump(stream: BufferedIOBase) -> Iterator[Entry]:
    """Entries of a dump. It may end inside a hash; an end later in a record raises Truncated."""
    r = Reader(stream)
    while True:
        infohash = stream.read(20)
        if len(infohash) < 20:
            return
        seconds, size = r.number(8), r.number(8)
        name = r.text(r.number(2))
        yield {"infohash": infohash, "name": name, "size": size & U48_MASK, "discovered_at": from_unix(seconds), "files": _read_files(r, True)}


def read_old_store(key: bytes, value: bytes) -> Entry | None:
    """An entry of the older key-value store: key T and hash; other keys and short values give None."""
    if len(key) != 21 or key[:1] != b"T" or len(value) < 21:
        return None
    r = Reader(value)
    seconds, size, _ = r.number(8), r.number(8), r.number(1)
    try:
        name = r.text(r.number(2))
    except Truncated:
        return None
    return {"infohash": key[1:], "name": name, "size": size, "discovered_at": from_unix(seconds), "files": _read_files(r, False)}


def encode_entry(e: Entry) -> bytes:
    import zstandard

    inner = struct.pack(">I", e["discovered_at"]) + (e["size"] & U48_MASK).to_bytes(6, "big") + e["name"].encode("utf-8", "replace")
    if e["files"]:
        inner += b"\0" + _files(e["files"])
    return b"\x01" + zstandard.ZstdCompressor(level=3).compress(inner)


def decode_entry(raw: bytes) -> Entry:
    """A stored entry, compressed or bare. The name ends at the first zero byte."""
    import zstandard

    if not raw:
        raise ValueError("empty entry")
    if raw[0] == 1:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw[1:])
    if len(raw) < 10:
        raise ValueError("short entry")
    name, mark, rest = raw[10:].partition(b"\0")
    files = _read_files(Reader(rest), False) if mark else []
    return {"name": name.decode("utf-8", "replace"), "size": int.from_bytes(raw[4:10], "big"), "discovered_at": int.from_bytes(raw[:4], "big"), "files": files}


def write_frame(e: Entry) -> bytes:
    """A sync frame; an entry without a name has none, as no name ends the stream."""
    name = e["name"].encode("utf-8", "replace")[:0xFFFF]
    if not name:
        return b""
    return _u16(len(name)) + e["infohash"] + struct.pack(">I", e["discovered_at"]) + (e["size"] & U48_MASK).to_bytes(6, "big") + name + _files(e["files"])


def read_frames(raw: bytes) -> Iterator[Entry]:
    r = Reader(raw)
    while r.at < len(raw) and (n := r.number(2)):
        infohash, at, size = r.take(20), r.number(4), r.number(6)
        yield {"infohash": infohash, "name": r.text(n), "size": size, "discovered_at": at, "files": _read_files(r, True)}


_U16, _FRAME, _FILE = struct.Struct(">H"), struct.Struct(">20sIHI"), struct.Struct(">QH")


def read_frame_columns(raw: bytes, rows: int) -> Iterator[tuple[list, ...]]:
    """As `read_frames`, but lists of `rows` entries at a time: infohash, name, size, discovered_at, where each one's files begin and the last one's end, path, file size."""
    at, end, more = 0, len(raw), True
    while more:
        hashes, names, sizes, times, starts, paths, lengths = [], [], [], [], [0], [], []
        try:
            while more := at < end and (n := _U16.unpack_from(raw, at)[0]) > 0:
                infohash, time, high, low = _FRAME.unpack_from(raw, at + 2)
                at += 32 + n
                names.append(raw[at - n : at].decode("utf-8", "replace"))
                (files,) = _U16.unpack_from(raw, at)
                at += 2
                for _ in range(files):
                    length, n = _FILE.unpack_from(raw, at)
                    at += 10 + n
                    paths.append(raw[at - n : at].decode("utf-8", "replace"))
                    lengths.append(length)
                if at > end:
                    raise Truncated(f"wanted {at - end} bytes more")
                hashes.append(infohash), times.append(time), sizes.append(high << 32 | low), starts.append(len(paths))
                if len(hashes) == rows:
                    break
        except struct.error:
            raise Truncated("the bytes end inside a frame") from None
        yield hashes, names, sizes, times, starts, paths, lengths


def write_header(values: tuple[int, int, int, int, int]) -> bytes:
    """db_size, total, mem_rss, disk_used, disk_total."""
    return struct.pack(">5Q", *values)


def read_header(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(">5Q", raw[:40])


def write_request(since: int) -> bytes:
    """What a sync client sends: the second from which on it wants rows."""
    return struct.pack(">I", since & 0xFFFFFFFF)


def read_request(raw: bytes) -> int:
    return struct.unpack(">I", raw[:4])[0]


_DIGITS = re.compile(rb"0|-?[1-9][0-9]*")


def _number(raw: bytes) -> int:
    if not _DIGITS.fullmatch(raw):
        raise ValueError("not a number of this notation")
    return int(raw)


def bdecode(raw: bytes, at: int = 0) -> tuple[Any, int]:
    """The value that begins at a place, and where it ends. Raises ValueError if malformed."""
    if at >= len(raw):
        raise ValueError("end of data")
    kind = raw[at : at + 1]
    if kind == b"i":
        end = raw.index(b"e", at)
        return _number(raw[at + 1 : end]), end + 1
    if kind in b"ld":
        items, at = [], at + 1
        while raw[at : at + 1] != b"e":
            item, at = bdecode(raw, at)
            items.append(item)
        if kind == b"l":
            return items, at + 1
        if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
            raise ValueError("dictionary keys are strings")
        return dict(zip(items[::2], items[1::2], strict=True)), at + 1
    colon = raw.index(b":", at)
    n = _number(raw[at:colon])
    if n < 0 or colon + 1 + n > len(raw):
        raise ValueError("string past the end")
    return raw[colon + 1 : colon + 1 + n], colon + 1 + n


def bencode(value: Any) -> bytes:
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return b"%d:" % len(raw) + raw
    if isinstance(value, list):
        return b"l" + b"".join(map(bencode, value)) + b"e"
    return b"d" + b"".join(bencode(k) + bencode(v) for k, v in sorted((k.encode() if isinstance(k, str) else k, v) for k, v in value.items())) + b"e"


def compact_nodes(raw: bytes) -> list[tuple[bytes, str, int]]:
    """(id, ip, port) of 26-byte records; a rest is dropped, and so are nodes of port 0."""
    cut = (raw[i : i + 26] for i in range(0, len(raw) - 25, 26))
    return [(x[:20], ".".join(map(str, x[20:24])), int.from_bytes(x[24:], "big")) for x in cut if x[24:] != b"\0\0"]


def compact_peer(raw: bytes) -> tuple[str, int] | None:
    return (".".join(map(str, raw[:4])), int.from_bytes(raw[4:], "big")) if len(raw) == 6 else None


def compact_hashes(raw: bytes) -> list[bytes]:
    return [raw[i : i + 20] for i in range(0, len(raw) - 19, 20)]


def parse_message(raw: bytes) -> dict[str, Any] | None:
    """A datagram's fields, or None if it can't be read. Parts without a 20-byte id are left out."""
    try:
        msg, _ = bdecode(raw)
    except (ValueError, RecursionError):
        return None
    if not isinstance(msg, dict) or not isinstance(msg.get(b"y"), bytes) or not isinstance(msg.get(b"t"), bytes):
        return None
    out: dict[str, Any] = {"kind": msg[b"y"].decode("utf-8", "replace"), "transaction": msg[b"t"], "method": None, "id": None, "target": None, "port": None, "nodes": [], "peers": [], "samples": [], "num": None, "interval": None, "error": None}
    if isinstance(msg.get(b"q"), bytes):
        out["method"] = msg[b"q"].decode("utf-8", "replace")
    part = msg.get(b"a") if isinstance(msg.get(b"a"), dict) else msg.get(b"r")
    if isinstance(part, dict) and isinstance(part.get(b"id"), bytes) and len(part[b"id"]) == 20:
        out["id"] = part[b"id"]
        for k in (b"target", b"info_hash"):
            if isinstance(part.get(k), bytes) and len(part[k]) == 20:
                out["target"] = part[k]
        out["port"] = part.get(b"port") if isinstance(part.get(b"port"), int) else None
        out["implied"] = part.get(b"implied_port") == 1
        for k, read, to in ((b"nodes", compact_nodes, "nodes"), (b"samples", compact_hashes, "samples")):
            if isinstance(part.get(k), bytes):
                out[to] = read(part[k])
        if isinstance(part.get(b"values"), list):
            out["peers"] = [p for v in part[b"values"] if isinstance(v, bytes) and (p := compact_peer(v))]
        out["interval"] = part.get(b"interval") if isinstance(part.get(b"interval"), int) else None
        out["num"] = part.get(b"num") if isinstance(part.get(b"num"), int) else None
    if isinstance(msg.get(b"e"), list) and msg[b"e"]:
        out["error"] = msg[b"e"][0] if isinstance(msg[b"e"][0], int) else None
    return out


def query(transaction: bytes, method: str, arguments: dict[str, Any]) -> bytes:
    return bencode({"t": transaction, "y": "q", "q": method, "a": arguments})


def response(transaction: bytes, values: dict[str, Any]) -> bytes:
    return bencode({"t": transaction, "y": "r", "r": values})


def error(transaction: bytes, code: int, text: str) -> bytes:
    return bencode({"t": transaction, "y": "e", "e": [code, text]})


# What each request must carry besides its id, and the code of an answer to a bad one.
REQUESTS = {"ping": None, "find_node": b"target", "get_peers": b"info_hash", "announce_peer": b"info_hash", "sample_infohashes": None}
SERVER_ERROR = 202


def dispatched(raw: bytes, me: bytes) -> tuple[str | None, bytes | None]:
    """The method of a request and the answer's beginning: a response with our id, or error 202 for what can't be served.

    Packets that can't be read, and those that are no request, get no answer.
    """
    msg = parse_message(raw)
    if msg is None or msg["kind"] != "q":
        return None, None
    need = REQUESTS.get(msg["method"], b"?")
    if msg["id"] is None or need == b"?" or need is not None and msg["target"] is None:
        return msg["method"], error(msg["transaction"], SERVER_ERROR, "Server Error")
    return msg["method"], response(msg["transaction"], {"id": me})


def announce_port(implied: bool, port: int | None, source_port: int) -> int:
    return source_port if implied or port is None else port


def info_dict(raw: bytes) -> Entry | None:
    """Name, size and files of a metadata dictionary. `length` wins over `files`; files without a path count in the size only."""
    try:
        info, _ = bdecode(raw)
    except (ValueError, RecursionError):
        return None
    if not isinstance(info, dict):
        return None
    text = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else ""
    whole = lambda x: x if isinstance(x, int) else 0
    name = text(info.get(b"name"))
    if isinstance(info.get(b"length"), int):
        return {"name": name, "size": info[b"length"], "files": [(name, info[b"length"])]}
    listed = [f for f in info.get(b"files", []) if isinstance(f, dict)] if isinstance(info.get(b"files"), list) else []
    paths = [("/".join(text(p) for p in f[b"path"]) if isinstance(f.get(b"path"), list) else "", whole(f.get(b"length"))) for f in listed]
    return {"name": name, "size": sum(n for _, n in paths), "files": [x for x in paths if x[0]]}


def verified(metadata: bytes, infohash: bytes) -> bool:
    return hashlib.sha1(metadata).digest() == infohash


# Fixed values of the peer protocol: its name, the size of a metadata piece, the largest metadata, message types.
PROTOCOL = b"\x13BitTorrent protocol"
PIECE, MAX_METADATA = 16_384, 10 << 20
REQUEST, DATA, REJECT = 0, 1, 2


def handshake(infohash: bytes, extended: bool = True, peer: bytes = b"-SL0000-000000000000") -> bytes:
    return PROTOCOL + bytes((0, 0, 0, 0, 0, 0x10 if extended else 0, 0, 0)) + infohash + peer


def handshake_error(raw: bytes, infohash: bytes) -> str | None:
    """What is wrong with a peer's handshake, or None."""
    if len(raw) < 68:
        return "short"
    if raw[:20] != PROTOCOL:
        return "protocol"
    if not raw[25] & 0x10:
        return "extension"
    return None if raw[28:48] == infohash else "infohash"


def extension_error(raw: bytes) -> str | None:
    """What is wrong with an extension handshake (type, number, dictionary), or None."""
    if len(raw) < 2:
        return "short"
    try:
        got, _ = bdecode(raw, 2)
    except (ValueError, RecursionError):
        return "bencode"
    number = got.get(b"m", {}).get(b"ut_metadata") if isinstance(got, dict) and isinstance(got.get(b"m"), dict) else None
    if not isinstance(number, int) or not 1 <= number <= 254:
        return "ut_metadata"
    size = got.get(b"metadata_size")
    return None if isinstance(size, int) and 0 < size <= MAX_METADATA else "size"


def piece_message(kind: int, piece: int, data: bytes = b"") -> bytes:
    return bencode({"msg_type": kind, "piece": piece}) + data


def assembled(messages: list[bytes], size: int) -> bytes | None:
    """Metadata put together from piece messages: a piece's bytes go to its number times PIECE.

    Messages that are no data are left out, a reject ends it, and it is whole once as many bytes as
    stated have come. A stated size of none is invalid.
    """
    if size <= 0:
        return None
    out, got = bytearray(size), 0
    for raw in messages:
        if got >= size:
            break
        try:
            head, end = bdecode(raw)
        except (ValueError, RecursionError):
            continue
        kind, piece = (head.get(b"msg_type"), head.get(b"piece")) if isinstance(head, dict) else (None, None)
        if kind == REJECT:
            return None
        at = piece * PIECE if isinstance(piece, int) and piece >= 0 else size
        if kind != DATA or at >= size:
            continue
        data = raw[end : end + size - at]
        out[at : at + len(data)] = data
        got += len(data)
    return bytes(out) if got >= size else None


class StableBloom:
    """The decaying filter of the ingest path, cell by cell; a test tool, as exact state replaces it."""

    # Cells per item, hashes, what a cell is set to, and the multiplier that spreads the decay.
    CELLS_PER_ITEM, HASHES, TOP, SPREAD = 2, 3, 3, 0x517CC1B727220A95

    def __init__(self, capacity: int):
        self.cells = bytearray(max(1024, capacity * self.CELLS_PER_ITEM))

    @classmethod
    def indices(cls, key: bytes, n: int) -> list[int]:
        """The cells of a key: its first two little-endian 64-bit numbers, the second added again and again."""
        h1, h2 = (int.from_bytes(key[i : i + 8], "little") for i in (0, 8))
        return [(h1 + i * h2 & (1 << 64) - 1) % n for i in range(cls.HASHES)]

    def test_and_add(self, key: bytes) -> bool:
        mask, n = (1 << 64) - 1, len(self.cells)
        h1 = int.from_bytes(key[:8], "little")
        for i in range(self.HASHES):
            cell = ((h1 + i & mask) * self.SPREAD & mask) % n
            self.cells[cell] = max(0, self.cells[cell] - 1)
        own = self.indices(key, n)
        seen = all(self.cells[c] for c in own)
        for c in own:
            self.cells[c] = self.TOP
        return seen
