"""Which plan shape a job takes. The bytes of the result never depend on it."""

from __future__ import annotations

#: Names of the three plan shapes.
STRATEGIES = ("stream", "mmf", "shard")


def choose_strategy(name: str, size: int, chunk_bytes: int, threads: int) -> str:
    """``auto``: one partition for an input of one chunk, explicit shards for four chunks and threads or more, else a plain sort."""
    name = name.lower()
    if name in STRATEGIES:
        return name
    if name != "auto":
        raise ValueError(f"unknown strategy {name!r}; known: auto, {', '.join(STRATEGIES)}")
    if size <= chunk_bytes:
        return "mmf"
    return "shard" if size >= 4 * chunk_bytes and threads >= 4 else "stream"


def shard_count(threads: int, file_budget: int, runs: int, merge_width: int) -> int:
    """As many shards as threads, fewer if each would open too many runs (a fixed formula)."""
    return min(threads, max(1, file_budget // (min(runs, merge_width) + 1)))
