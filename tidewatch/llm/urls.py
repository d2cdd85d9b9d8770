"""URL filters: a weighted vocabulary found by one Aho-Corasick automaton, under rules for hosts.

Strict terms reject a URL at once; soft terms reject it when enough different ones are found. A term
counts only between boundaries: the characters next to it are no ASCII letters or digits. Rules of
host and path come first: the longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices

STRICT = ("adult", "bestiality", "camgirls", "casino", "escorts", "hentai", "malware", "phishing", "porn", "porno",
          "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "betting", "bonus", "cams", "cheap", "clicks", "coupon", "crack", "dating", "discount",
        "free", "gambling", "girls", "hot", "jackpot", "keygen", "loans", "lottery", "nude", "pharmacy", "pills",
        "poker", "popup", "prize", "replica", "slots", "track", "tracker", "win", "winner")
SOFT_NEEDED = 2

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(_LOWER + "0123456789")
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[set[str], set[str]]:
    """The different strict and soft terms that stand between boundaries."""
    text = url.translate(_ASCII_LOWER)
    found: tuple[set[str], set[str]] = (set(), set())
    for last, (term, is_strict) in _automaton(strict, soft).iter(text):
        first = last - len(term) + 1
        if (first == 0 or text[first - 1] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
            found[not is_strict].add(term)
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z in lower case, and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule for a host, or its subdomains, whose path starts the path: text and verdict."""
    text = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        text, verdict = F.when(fits, own + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
               soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits and soft_hits (sorted terms) of every row.

    A null URL, and one without ``://``, has an empty host and path, so no rule; its terms count (null
    has none, so it is allowed). Repeated rows are all kept; no rows give none; columns other than
    ``page_id`` and ``url`` are not read.
    """
    strict, soft = tuple(strict), tuple(soft)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [hits(u or "", strict, soft) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([sorted(x[k]) for x in found], pa.list_(pa.string())) for k in (0, 1))],
                [*batch.schema.names, "strict_hits", "soft_hits"])

    link = F.col(url).cast("string")
    host, path = host_and_path(link)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), link.alias("url"), host.alias("host"),
                        path.alias("path"))
    scanned = rows.mapInArrow(scan, "page_id long, url string, host string, path string, "
                                    "strict_hits array<string>, soft_hits array<string>")
    rejected = (F.size("strict_hits") > 0) | (F.size("soft_hits") >= soft_needed)
    own = F.when(rejected, "block").otherwise("allow")
    return scanned.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                          "strict_hits", "soft_hits")


def judge_urls_sql() -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict over ``pages``."""
    def count(terms):
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::int" for t in terms)

    cases = " ".join(
        f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}') THEN '{own}{start}'"
        for _, own, start in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    verdicts = " ".join(f"WHEN '{own}{start}' THEN '{kind}'" for kind, own, start in RULES)
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, u, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
named AS (
  SELECT page_id, u, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
ruled AS (SELECT *, CASE {cases} END AS rule FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END
            WHEN {count(STRICT)} >= 1 OR {count(SOFT)} >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
