"""URL filter: host and path rules first, then a weighted vocabulary found by one Aho-Corasick pass.

A strict term weighs as much as the rejecting weight, a soft term weighs one and counts once however
often it appears, so one strict term or ``reject_at`` different soft terms reject.  A term counts only
where neither neighbour is an ASCII letter or digit.  Rules decide before the vocabulary does.

Defined results: a null or malformed url has empty host and path, fits no rule, and is allowed unless
its text (if any) holds the terms; repeated rows are judged alike; an empty table gives an empty table;
extra columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "adserver", "bet", "bets", "bonus", "cheap", "click", "coupon", "dating", "deal", "discount", "free", "jackpot",
    "loan", "loans", "lottery", "pill", "pills", "poker", "popup", "promo", "replica", "slots", "track", "tracker", "win",
)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
RESULT = "host string, path string, rule string, strict_hits int, soft_hits int, weight int, verdict string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = [p for p in map(rest.find, "?#") if p >= 0]
    rest = rest[: min(cut)] if cut else rest
    host, slash, path = rest.partition("/")
    return host.translate(FOLD), slash + path


@dataclass(frozen=True)
class UrlFilter:
    """``rules`` are (verdict, host, path); a rule fits its host and all subdomains below its path."""

    rules: Sequence[tuple[str, str, str]] = RULES
    strict: Sequence[str] = STRICT
    soft: Sequence[str] = SOFT
    reject_at: int = 2

    def by_host(self) -> Mapping[str, list[tuple[str, str, str]]]:
        table: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in self.rules:
            table.setdefault(host, []).append((path, host + path, verdict))
        return table

    def automaton(self) -> ahocorasick.Automaton:
        words = ahocorasick.Automaton()
        for term, strict in [(t, False) for t in self.soft] + [(t, True) for t in self.strict]:
            words.add_word(term, (term, strict))
        words.make_automaton()
        return words


def rule_for(table: Mapping, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule (as text) among those of the host and of every domain above it."""
    best: tuple[int, int, str, str] | None = None
    labels = host.split(".") if host else []
    for k in range(len(labels)):
        for start, name, verdict in table.get(".".join(labels[k:]), ()):
            if path.startswith(start) and (best is None or (len(name), -k) > best[:2]):
                best = (len(name), -k, name, verdict)
    return (best[2], best[3]) if best else (None, None)


def term_hits(words: ahocorasick.Automaton, text: str) -> tuple[int, int]:
    """Strict occurrences and different soft terms of an already folded text."""
    strict, soft = 0, set()
    for end, (term, hard) in words.iter(text):
        begin = end + 1 - len(term)
        if (begin and text[begin - 1] in INSIDE) or (end + 1 < len(text) and text[end + 1] in INSIDE):
            continue
        if hard:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def judge_urls(pages: DataFrame, url: str = "url", using: UrlFilter | None = None) -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits, weight and verdict (allow or block) to every row."""
    using = using or UrlFilter()
    state: list = []

    @F.arrow_udf(RESULT)
    def judge(urls: pa.Array) -> pa.Array:
        if not state:
            state.extend((using.by_host(), using.automaton()))
        table, words = state
        out = []
        for value in urls.to_pylist():
            host, path = split_url(value)
            rule, verdict = rule_for(table, host, path)
            strict, soft = term_hits(words, value.translate(FOLD)) if value else (0, 0)
            weight = strict * using.reject_at + soft
            out.append({
                "host": host, "path": path, "rule": rule, "strict_hits": strict, "soft_hits": soft, "weight": weight,
                "verdict": verdict or ("block" if weight >= using.reject_at else "allow"),
            })
        return pa.array(out, pa.struct([
            ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("strict_hits", pa.int32()),
            ("soft_hits", pa.int32()), ("weight", pa.int32()), ("verdict", pa.string()),
        ]))

    names = [part.split()[0] for part in RESULT.split(", ")]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    judged = pages.select(*kept, judge.asNondeterministic()(F.col(f"`{url}`")).alias("__judged"))
    return judged.select("*", *[F.col(f"__judged.{n}").alias(n) for n in names]).drop("__judged")
