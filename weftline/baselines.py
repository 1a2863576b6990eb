"""Plain Python sorts of one machine, to measure the engine against and to hold its bytes against. They are no part of any job."""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterable, Iterator

Record = tuple[bytes, int]


def records(path: str) -> Iterator[Record]:
    """(text, number) of each line as the lenient parse has them; ValueError for a malformed line."""
    with open(path, "rb") as f:
        for i, line in enumerate(f):
            line = line.removesuffix(b"\n").removesuffix(b"\r")
            if not i:
                line = line.removeprefix(b"\xef\xbb\xbf")
            number, dot, text = line.partition(b".")
            if not dot or not text.startswith(b" ") or not number.removeprefix(b"-").removeprefix(b"+").isdigit():
                raise ValueError(f"Malformed line: {line[:80]!r}")
            yield text[1:].decode("utf-8", "replace").encode(), int(number)


def write(rows: Iterable[Record], path: str) -> None:
    with open(path, "wb") as f:
        f.writelines(b"%d. %b\n" % (number, text) for text, number in rows)


def sort_in_memory(source: str, target: str) -> None:
    """All records at once, sorted by one thread."""
    write(sorted(records(source)), target)


def sort_sequentially(source: str, target: str, run_records: int = 1_000_000, folder: str | None = None) -> int:
    """Sorted text runs of so many records on disk, one after the other, then one merge of all of them. Returns the number of runs."""
    with tempfile.TemporaryDirectory(dir=folder) as work:
        paths, held = [], []

        def flush() -> None:
            if held:
                paths.append(os.path.join(work, str(len(paths))))
                write(sorted(held), paths[-1])
                held.clear()

        for record in records(source):
            held.append(record)
            if len(held) == run_records:
                flush()
        flush()
        write(heapq.merge(*map(records, paths)), target)
        return len(paths)
