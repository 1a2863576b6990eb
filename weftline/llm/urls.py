"""URL filters: domain and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton with boundary checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf

#: Fixed values: (action, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: One of these rejects a URL.
STRICT = ("porn", "xxx", "hentai", "casino", "viagra", "cialis", "escort", "phishing", "warez", "malware")
#: So many different ones of these together reject it.
SOFT = ("adult", "ads", "bet", "bets", "betting", "cheap", "pills", "pharmacy", "win", "winner", "spam", "farm", "free", "track", "tracker", "poker", "slots", "loan", "loans", "sex", "nude", "dating", "crack", "keygen", "replica", "click", "popup", "bonus", "jackpot", "x")
SOFT_HITS = 2


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: what stands between ``://`` and the first of ``/?#``, with A-Z lower-cased, and then up to ``?`` or ``#``. Both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, path[:stop]


@dataclass(frozen=True)
class UrlFilter:
    """Rules win over the vocabulary; of rules that fit, the longest as written wins (of equals the first)."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_hits: int = SOFT_HITS

    def by_host(self) -> dict[str, list[tuple[str, str, str]]]:
        """host: (path, rule, action), the longest path first."""
        out: dict[str, list[tuple[str, str, str]]] = {}
        for action, host, path in self.rules:
            out.setdefault(host, []).append((path, host + path, action))
        return {h: sorted(r, key=lambda x: -len(x[0])) for h, r in out.items()}

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term in self.soft:
            a.add_word(term, (term, False))
        for term in self.strict:
            a.add_word(term, (term, True))
        a.make_automaton()
        return a

    def rule(self, host: str, path: str, by_host: dict) -> tuple[str, str] | None:
        """The longest rule of the host and the domains above it whose path begins the URL's."""
        best = None
        at = 0
        while True:
            for own, rule, action in by_host.get(host[at:], ()):
                if path.startswith(own) and (best is None or len(rule) > len(best[0])):
                    best = (rule, action)
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1

    def counts(self, url: str, automaton: ahocorasick.Automaton) -> tuple[int, int]:
        """Strict hits and different soft terms in a URL, each between characters that are neither letters nor digits."""
        low, strict, soft = url.lower(), 0, set()
        for end, (term, hard) in automaton.iter(low):
            start = end - len(term) + 1
            if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                continue
            if hard:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)


JUDGED = "struct<host: string, path: string, rule: string, verdict: string, strict_hits: int, soft_terms: int>"


def judged(url: Column, filters: UrlFilter) -> Column:
    kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int32()), ("soft_terms", pa.int32())])

    @arrow_udf(JUDGED)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_host, automaton = filters.by_host(), filters.automaton()
        for batch in batches:
            rows = []
            for url in batch.to_pylist():
                host, path = split_url(url)
                strict, soft = filters.counts(url, automaton) if url else (0, 0)
                rule = filters.rule(host, path, by_host) if host else None
                verdict = rule[1] if rule else "block" if strict or soft >= filters.soft_hits else "allow"
                rows.append((host, path, rule[0] if rule else None, verdict, strict, soft))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    return judge(url)


def judge_urls(pages: DataFrame, filters: UrlFilter | None = None, *, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``strict_hits``, ``soft_terms``.

    Null URLs and those without ``://`` have an empty host and path and no rule; a null URL is allowed. Repeated rows and null ids stay; other columns play no part.
    """
    j = pages.select(F.col(id_col).alias("id"), judged(F.col(url), filters or UrlFilter()).alias("j"))
    return j.select(F.col("id").alias(id_col), "j.*")
