"""Quality rules on documents, and on the hosts that documents come from.

Counts are taken per document. Each rule turns them into failed or passed. Failures are then summed
up per domain, and the rate of each rule in a domain is shrunk towards the rate of all domains: the
prior is a beta distribution whose mean and spread are those of the domains' own rates (method of
moments). A domain of two bad documents thus counts less than one of two thousand. A domain fails if a
shrunken rate exceeds ``max_rate``, and so do all of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, windows, word_hashes
from tidewatch.session import staged

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def covered(hashes: np.ndarray, n: int) -> int:
    """Positions in windows of ``n`` that occur at least twice, first occurrences included."""
    found = windows(hashes, n)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(found), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, np.int64)
    marks[:len(found)] += again
    marks[n:n + len(found)] -= again
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


def counts_of(text: str, window: int = 5) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        covered(word_hashes.of(words), window),
    )


def document_counts(docs: DataFrame, domain: str = "source", window: int = 5) -> DataFrame:
    """doc_id, domain and ``COUNTS`` of every whole text; a null text is an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [counts_of(text or "", window) for text in batch.column(2).to_pylist()]
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns],
                                             ["doc_id", "domain", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(domain).cast("string").alias("domain"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, domain string, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(count, schema)


def rules() -> dict[str, Column]:
    """Which documents fail which rule; the first two are base rules, for documents on their own."""
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": F.col("n_symbols") > n / F.lit(10),
        "duplicate_lines": F.col("n_dup_lines") >= 10,
        "word_length": (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n),
    }


BASE_RULES = ["few_words", "repeated_words"]


def beta_priors(domains: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(a, b) of each rule's beta prior from the domains' rates; one row reaches the driver.

    Without spread between domains the prior is as heavy as a thousand documents; it never weighs less than two.
    """
    rate = {name: F.col(name) / F.col("docs") for name in names}
    row = domains.agg(*[F.avg(rate[n]).alias(f"mean_{n}") for n in names],
                      *[F.var_samp(rate[n]).alias(f"var_{n}") for n in names]).first()
    priors = {}
    for name in names:
        mean, spread = row[f"mean_{name}"] or 0.0, row[f"var_{name}"] or 0.0
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else 1000.0
        weight = min(max(weight, 2.0), 1000.0)
        priors[name] = (mean * weight, (1 - mean) * weight)
    return priors


def domain_verdicts(counted: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """domain, docs, failures per rule, shrunken ``rate_`` per rule, and domain_kept."""
    tests = rules()
    domains = staged(counted.groupBy("domain").agg(
        F.count("*").alias("docs"),
        *[F.sum(F.coalesce(test, F.lit(False)).cast("long")).alias(name) for name, test in tests.items()]))
    priors = beta_priors(domains, list(tests))
    rates = {f"rate_{n}": (F.col(n) + a) / (F.col("docs") + (a + b)) for n, (a, b) in priors.items()}
    found = domains.withColumns(rates)
    return found.withColumn("domain_kept", ~F.greatest(*[F.col(r) for r in rates]).__gt__(max_rate))


def quality_rules(docs: DataFrame, domain: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Documents with their counts, base_failed, the rates of their domain, and kept.

    A null text counts as an empty one and fails for having few words; a null domain is a domain of
    its own; repeated rows and ids each count and stay; no rows give none. Only ``doc_id``, ``text`` and
    the domain's column are read.
    """
    counted = staged(document_counts(docs, domain))
    tests = rules()
    failed = tests[BASE_RULES[0]]
    for name in BASE_RULES[1:]:
        failed = failed | tests[name]
    verdicts = domain_verdicts(counted, max_rate).withColumnRenamed("domain", "judged")
    verdicts = verdicts.drop("docs", *tests)
    joined = counted.withColumn("base_failed", failed).join(
        verdicts, F.col("domain").eqNullSafe(F.col("judged")), "left").drop("judged")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("domain_kept"))
