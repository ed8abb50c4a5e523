"""URL verdicts: host and path rules first, then pattern rules looked up by their rarest literal token.

A pattern rule is a regular expression with the literal tokens (runs of a-z and 0-9 in the lower-cased url) that
every url it fits must have. It is filed under that one of its tokens which the fewest urls of the table have,
counted over all of them. A url's tokens fetch the rules filed under them, and only those expressions run; the
first rule in the list that fits decides. A rule without a literal token can't be filed and is an error.

Host and path: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; the
path what follows up to ``?``, ``#`` or the end; without ``://`` both are empty. A host rule (host, path) fits its
host and subdomains if the path starts with the rule's; the longest rule (host, then path) wins. Only urls that
no host rule decides reach the pattern rules; what neither decides is allowed.

Every row gives one result. A null url has an empty host and path and is allowed. Extra columns don't matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes

# The contract's host rules.
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


@dataclass(frozen=True)
class Pattern:
    verdict: str
    tokens: tuple[str, ...]  #: literal tokens that every fitting url has
    expression: str  #: searched in the url, A-Z folded; letters are ASCII ones, and $ is the end of the url alone


PATTERNS = (
    Pattern("allow", ("spam", "report"), r"/spam-report(/|$|[?#])"),
    Pattern("block", ("spam", "farm"), r"\bspam-farm\b"),
    Pattern("block", ("cheap", "pills"), r"\bcheap-pills\b"),
    Pattern("block", ("casino",), r"\bcasino\b"),
    Pattern("block", ("free", "download"), r"\bfree-([a-z0-9]+-)*download\b"),
    Pattern("block", ("adult",), r"://([a-z0-9-]+\.)*adult(-[a-z0-9-]+)?\."),
    Pattern("block", ("redirect", "url"), r"/redirect\?(.*&)?url=http"),
    Pattern("block", ("utm", "source", "ref", "affiliate"), r"[?&]utm_source=[^&#]*&ref=affiliate\b"),
    Pattern("block", ("exe",), r"\.exe([?#]|$)"),
    Pattern("block", ("wp", "login", "php"), r"/wp-login\.php\b"),
)

_TOKEN = re.compile("[a-z0-9]+")
_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _AUTHORITY.search(url or "")
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


def tokens(url: str | None) -> set[str]:
    return set(_TOKEN.findall((url or "").translate(_FOLD)))


def token_counts(pages: DataFrame, wanted: set[str]) -> dict[str, int]:
    """In how many urls each token of the rules stands, over all rows. As many numbers as the rules have tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(sorted(wanted), 0)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for token in tokens(url) & wanted:
                    counts[token] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = pages.select(F.col("url").cast("string").alias("url")).mapInArrow(_bytes.frugal(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


class Rules:
    def __init__(self, hosts, patterns: tuple[Pattern, ...], counts: dict[str, int]) -> None:
        self.hosts = {}
        for verdict, host, path in hosts:
            self.hosts.setdefault(host, []).append((len(host) + len(path), path, verdict, host + path))
        self.filed: dict[str, list[tuple[int, re.Pattern, str]]] = {}
        for k, p in enumerate(patterns):
            if not p.tokens:
                raise ValueError(f"{p.expression} has no literal token")
            rarest = min(p.tokens, key=lambda t: (counts.get(t, 0), t))
            self.filed.setdefault(rarest, []).append((k, re.compile(p.expression.replace("$", r"\Z"), re.A), p.verdict))

    def by_host(self, host: str, path: str) -> tuple[str, str] | None:
        found, at = [], 0
        while host:
            found += [r for r in self.hosts.get(host[at:], ()) if path.startswith(r[1])]
            at = host.find(".", at) + 1
            if not at:
                break
        return max(found)[3:1:-1] if found else None

    def by_pattern(self, url: str | None) -> str:
        low = (url or "").translate(_FOLD)
        near = sorted((r for t in tokens(low) & self.filed.keys() for r in self.filed[t]), key=lambda r: r[0])
        return next((verdict for _, expression, verdict in near if expression.search(low)), "allow")


def judged(pages: DataFrame, hosts=HOST_RULES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row. The rules are a parameter, so all tasks may hold them."""
    counts = token_counts(pages, {t for p in patterns for t in p.tokens})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(hosts, patterns, counts)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                decided = rules.by_host(host, path)
                rows.append((host, path, *(decided or (None, rules.by_pattern(url)))))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return narrow.mapInArrow(_bytes.frugal(run), "page_id long, host string, path string, rule string, verdict string")
