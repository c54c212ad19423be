"""Values from the command line and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Rows at once by stage, and the digits of base58.
FAN_OUT = {"find_node": 10, "sample": 10, "get_peers": 20, "metadata": 40}
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def parse_key(text: str) -> bytes:
    """A 32-byte key from 64 hex digits or base58."""
    text = text.strip()
    if len(text) == 64 and all(c in "0123456789abcdefABCDEF" for c in text):
        return bytes.fromhex(text)
    n = 0
    for c in text:
        if c not in BASE58:
            raise ValueError("not hex and not base58")
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    raw = bytes(len(text) - len(text.lstrip("1"))) + raw
    if len(raw) != 32:
        raise ValueError("a key has 32 bytes")
    return raw


def expand_path(path: str, home: str | None = None) -> str:
    """Only a leading ~/ is expanded."""
    return os.path.join(home or os.path.expanduser("~"), path[2:]) if path.startswith("~/") else path


@dataclass
class Settings:
    """Job settings; SWARM_<NAME> overrides a default, and what can't be read leaves it.

    `batch_files` bounds the files of a micro-batch, `flush_seconds` is its trigger, and `scale`
    multiplies the rows a stage of the crawl takes at once.
    """

    catalog: str = "~/.swarmlake/catalog"
    batch_files: int = 16
    flush_seconds: int = 60
    scale: float = 10.0

    def fan_out(self) -> dict[str, int]:
        """Rows that the stages of a crawl take at once."""
        return {name: max(1, int(base * self.scale)) for name, base in FAN_OUT.items()}

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        out = cls()
        for f in fields(cls):
            raw = env.get(f"SWARM_{f.name.upper()}")
            if raw is not None:
                try:
                    setattr(out, f.name, type(getattr(out, f.name))(raw))
                except ValueError:
                    pass
        out.catalog = expand_path(out.catalog)
        return out


def sync_key(spark, path: str) -> bytes:
    """The node's 32-byte key: read from a file of any store that Spark writes to, made at the first call."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        out = fs.create(at, False)
        try:
            out.write(os.urandom(32))
        finally:
            out.close()
    found = fs.open(at)
    try:
        key = bytes(found.readAllBytes())
    finally:
        found.close()
    if len(key) != 32:
        raise ValueError("a key has 32 bytes")
    return key


def host_metrics(path: str = "/", status: str = "/proc/self/status") -> dict[str, int]:
    """Bytes of memory this process holds, and of the disk under a path: used and in all; 0 where the host does not tell."""
    rss = 0
    try:
        with open(status) as lines:
            rss = next((int(x.split()[1]) * 1024 for x in lines if x.startswith("VmRSS:")), 0)
    except OSError:
        pass
    try:
        fs = os.statvfs(path)
        total, free = fs.f_blocks * fs.f_frsize, fs.f_bfree * fs.f_frsize
    except OSError:
        total = free = 0
    return {"mem_rss": rss, "disk_used": total - free, "disk_total": total}


def progress(done: int, total: int, seconds: float) -> tuple[float, float]:
    """Rows a second and percent of a running job."""
    return done / seconds if seconds > 0 else 0.0, 100.0 * done / total if total else 100.0
