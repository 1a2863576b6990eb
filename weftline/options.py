"""Immutable settings of the sort and of the generator, and the size helpers of the command line."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def parse_size(text: str) -> int:
    """Bytes in ``10KB``, ``1.5 MB``, ``2GB`` or ``123``; units are powers of 1024.

    Raises ValueError for anything else (no thousands separators, no exponents, no bare ``B``).
    """
    s = text.strip().upper()
    for unit, factor in (("KB", KIB), ("MB", MIB), ("GB", GIB)):
        if s.endswith(unit):
            number = s[: -len(unit)].strip()
            if "E" in number or "_" in number:
                raise ValueError(f"not a size: {text!r}")
            try:
                return int(Decimal(number) * factor)
            except (InvalidOperation, OverflowError, ValueError):
                raise ValueError(f"not a size: {text!r}") from None
    if "_" in s:
        raise ValueError(f"not a size: {text!r}")
    return int(s)


def format_size(n: int) -> str:
    """Bytes for people: one decimal in GB, whole MB and KB (halves away from zero), else bytes."""
    if n >= GIB:
        tenths = (n * 10 * 2 + GIB) // (2 * GIB)
        return f"{tenths // 10}.{tenths % 10} GB"
    for unit, name in ((MIB, "MB"), (KIB, "KB")):
        if n >= unit:
            return f"{(2 * n + unit) // (2 * unit)} {name}"
    return f"{n} B"


def machine_memory() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")


def default_chunk_bytes(memory: int | None = None) -> int:
    """A quarter of the memory, under a ceiling that grows with the machine (the ceilings are fixed values)."""
    memory = machine_memory() if memory is None else memory
    ceiling = next(cap for least, cap in ((64 * GIB, 8 * GIB), (32 * GIB, 4 * GIB), (8 * GIB, 2 * GIB), (0, GIB)) if memory >= least)
    return min(memory // 4, ceiling)


@dataclass(frozen=True)
class SortOptions:
    """``blank_lines``: "error" or "skip"; ``on_error``: "fail" or "quarantine".

    ``chunk_bytes`` bounds what one scan task reads and, with ``threads``, chooses the plan's shape. ``merge_width`` is that of a merge of runs.
    ``temp_dir`` is where free disk is looked for; ``buffer_bytes``, ``workers`` and ``temp_dir`` are settings of the session that the command line
    makes (shuffle buffer, task slots, local folder), as a running session's are fixed. Results above ``single_bytes`` stay part files.
    """

    chunk_bytes: int = field(default_factory=default_chunk_bytes)
    threads: int = field(default_factory=lambda: os.cpu_count() or 1)
    strategy: str = "auto"
    partitions: int | None = None
    blank_lines: str = "error"
    on_error: str = "fail"
    strict: bool = False
    merge_width: int = 64
    buffer_bytes: int = 4 * MIB
    workers: int | None = None
    temp_dir: str | None = None
    single_bytes: int = 16 * GIB

    def __post_init__(self) -> None:
        if self.blank_lines not in ("error", "skip") or self.on_error not in ("fail", "quarantine"):
            raise ValueError("blank_lines is error or skip, on_error is fail or quarantine")
        if self.chunk_bytes < 1 or self.threads < 1 or self.merge_width < 2:
            raise ValueError("chunk_bytes and threads are 1 at least, merge_width 2")


@dataclass(frozen=True)
class GeneratorOptions:
    phrases: int = 500
    max_number: int = 100_000
    seed: int = 42

    def __post_init__(self) -> None:
        if self.phrases < 1 or self.max_number < 1:
            raise ValueError("phrases and max_number are 1 at least")


def hardware_report(options: SortOptions, parallelism: int, memory: int | None = None) -> list[str]:
    """What the machine has and what a job takes of it, a line each."""
    memory = machine_memory() if memory is None else memory
    return [
        f"cores {os.cpu_count() or 1}, memory {format_size(memory)}, parallelism {parallelism}",
        f"chunk {format_size(options.chunk_bytes)}, threads {options.threads}, workers {options.workers or options.threads}",
        f"merge width {options.merge_width}, buffer {format_size(options.buffer_bytes)}, temporary folder {options.temp_dir or 'default'}",
    ]
