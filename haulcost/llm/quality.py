"""Quality rules: a learned decision list over text statistics.

Sequential covering grows conjunctions of thresholds that describe labelled bad
documents, prunes each on rows it was not grown on, and stops when the next one
would not hold there. The list becomes one ordered Spark conditional expression.

Defined cases: a NULL or empty text has no words and fails the base rules; a row
without usable labels takes no part in fitting; without enough labels the list is
empty and the base rules decide alone; repeated rows are judged alike; labels that
contradict each other for a document count one each. Only named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from haulcost.llm.words import take

#: Characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Fixed values of the base rules: too few words, too large a share of repeated words.
BASE_WORDS = 50
BASE_REPEATED = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The measures that rules test, as SQL over the counts.
MEASURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
}

#: Labelled rows that the list is fitted on: the first so many by a hash of doc_id.
SAMPLE_ROWS = 20_000


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of one text, named in ``COUNTS``."""
    if not text:
        return 0, 0, 0, 0, 0
    found = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(found)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(found, found[1:], found[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0  # words before this place are counted
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return (
        n,
        len(text) - sum(text.count(x) for x in WHITE),
        sum(text.count(x) for x in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
    )


def _columns(texts: pa.Array) -> list[pa.Array]:
    """The counts of many texts, a column each."""
    found = [text_counts(x.as_py()) for x in texts]
    columns = list(zip(*found, strict=True)) or [()] * len(COUNTS)
    return [pa.array(c, pa.int64()) for c in columns]


def counted(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of every document; nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column("doc_id"), *_columns(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS])

    docs = take(documents, doc_id="doc_id", text="text")
    counts = [StructField(name, LongType()) for name in COUNTS]
    return docs.mapInArrow(count, StructType([docs.schema["doc_id"], *counts]))


def base_failed() -> Column:
    return F.expr(f"n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEATED} * n_words")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.measure]
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        measure = F.expr(MEASURES[self.measure])
        return measure >= self.threshold if self.above else measure <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that describes bad documents."""

    conditions: tuple[Condition, ...]

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.covers(values) for c in self.conditions])

    def column(self) -> Column:
        both = self.conditions[0].column()
        for c in self.conditions[1:]:
            both = both & c.column()
        return both


def _thresholds(x: np.ndarray, bad: np.ndarray, steps: int) -> np.ndarray:
    # Midpoints between neighbouring values, at evenly spaced ranks of the bad rows and of all.
    levels = np.unique(
        np.concatenate([np.quantile(part, np.linspace(0, 1, steps)) for part in (x, x[bad])])
    )
    return (levels[1:] + levels[:-1]) / 2


def _gain(good: np.ndarray, bad: np.ndarray, was_good: int, was_bad: int) -> np.ndarray:
    """Bad rows kept times the bits by which the rule's share of bad rows improves."""
    share = np.where(bad > 0, bad / np.maximum(good + bad, 1), 1e-12)
    return np.where(bad > 0, bad * (np.log2(share) - np.log2(was_bad / (was_good + was_bad))), -1)


def grow(values: dict[str, np.ndarray], bad: np.ndarray, steps: int, longest: int) -> list[Condition]:
    """Add the condition with the best gain until the rule covers bad rows only."""
    inside = np.ones(len(bad), bool)
    conditions: list[Condition] = []
    while len(conditions) < longest and (inside & ~bad).any():
        was_bad, was_good = int((inside & bad).sum()), int((inside & ~bad).sum())
        best = (1e-9, None)
        for measure, all_x in values.items():
            x, is_bad = all_x[inside], bad[inside]
            cuts = _thresholds(x, is_bad, steps)
            if not len(cuts):
                continue
            sorted_bad, sorted_good = np.sort(x[is_bad]), np.sort(x[~is_bad])
            low_bad = np.searchsorted(sorted_bad, cuts, "right")
            low_good = np.searchsorted(sorted_good, cuts, "right")
            for above in (True, False):
                b, g = (was_bad - low_bad, was_good - low_good) if above else (low_bad, low_good)
                gains = _gain(g, b, was_good, was_bad)
                at = int(np.argmax(gains))
                if gains[at] > best[0]:
                    best = (float(gains[at]), Condition(measure, above, float(cuts[at])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= best[1].covers(values)
    return conditions


def _worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = rule.covers(values)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return (p - n) / max(p + n, 1) if p + n else -1.0


def fit(
    values: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.97,
    least: int = 5,
    most_rules: int = 12,
    longest: int = 4,
    steps: int = 33,
) -> list[Rule]:
    """The list, from measures and labels of the same rows.

    Every third row is held out for pruning: conditions go from the end of a rule
    while that does not worsen its worth there. A rule joins the list if it covers
    ``least`` held-out rows and at least ``precision`` of those it covers are bad;
    the first that does not ends the list, since good documents matter more.
    """
    prune = np.arange(len(bad)) % 3 == 2
    cut = lambda mask: ({k: v[mask] for k, v in values.items()}, bad[mask])
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        growing, growing_bad = cut(left & ~prune)
        pruning, pruning_bad = cut(left & prune)
        if growing_bad.sum() < least or pruning_bad.sum() < least:
            break
        conditions = grow(growing, growing_bad, steps, longest)
        if not conditions:
            break
        rule = max(
            (Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)),
            key=lambda r: (_worth(r, pruning, pruning_bad), -len(r.conditions)),
        )
        covered = rule.covers(pruning)
        if covered.sum() < least or pruning_bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~rule.covers(values)
    return rules


def labelled(counts: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Measures and badness of labelled rows that pass the base rules, on the driver.

    ``counts`` covers the labelled sample only, at most ``SAMPLE_ROWS`` ids.
    """
    rows = (
        counts.join(labels, "doc_id")
        .filter(~base_failed())
        .select("doc_id", "quality", *[F.expr(text).alias(name) for name, text in MEASURES.items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .toPandas()
    )
    return (
        {name: rows[name].to_numpy("float64") for name in MEASURES},
        rows["quality"].to_numpy() == 0,
    )


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **how) -> list[Rule]:
    """Fit the list on at most ``sample_rows`` labelled rows.

    The ids are few, so the texts are reduced to them before anything is counted.
    """
    sample = (
        take(labels, doc_id="doc_id", quality="quality")
        .filter("doc_id is not null and quality in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    ids = F.broadcast(sample.select("doc_id").distinct())
    counts = counted(documents.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    values, bad = labelled(counts, sample)
    return fit(values, bad, **how) if len(bad) else []


def verdict(rules: list[Rule]) -> Column:
    """False for rows that fail the base rules or meet a rule of the list, else true."""
    decision = F.when(base_failed(), F.lit(False))
    for rule in rules:
        decision = decision.when(rule.column(), F.lit(False))
    return decision.otherwise(F.lit(True))


def judged(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    return counted(documents).select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("kept")
    )


def kept_documents(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the base rules and the list keep, as they are.

    Only texts go to the Python workers and only counts return; the rows wait in Spark.
    """
    counts = StructType([StructField(name, LongType()) for name in COUNTS])

    @F.arrow_udf(counts)
    def count(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_columns(texts), names=list(COUNTS))

    rows = documents.select(F.struct("*").alias("row"), count("text").alias("counts"))
    return rows.select("row", "counts.*").filter(verdict(rules)).select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents, judged by a list learned from the labels."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(documents, learn(documents, labels))
