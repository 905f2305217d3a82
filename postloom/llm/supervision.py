"""Document quality by weak supervision.

Rules vote good, bad or abstain on counts taken from the whole text. How reliable each vote is, given
the hidden class, is estimated by expectation-maximisation over all documents; a document's verdict is
its posterior probability of being good. Nothing is rejected for failing one rule.

Votes are counted over the corpus first: the table of vote patterns has at most 3 ^ rules rows, so the
estimation runs on that small table whatever the number of documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import cut_lineage

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: A word of letters with one stop or comma after it at most.
PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff'-]+[.,;:?!]?(?!\S)")
#: What a line of prose ends in.
CLOSED = (b".", b"?", b"!", b":", b";", b'"')

#: Counts taken from each text, all long.
FACTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_closed", "n_distinct", "n_echo", "n_plain", "n_upper", "n_letters", "n_marks",
]


def repeat_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    keys = np.zeros(n, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    for i in range(width):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + n] + np.uint64(1)
    order = np.argsort(keys, kind="stable")
    alike = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    if not len(alike):
        return 0
    # equal hashes are settled on the words themselves
    suspects = np.unique(np.concatenate((order[alike], order[alike + 1])))
    seen = Counter(ids[p : p + width].tobytes() for p in suspects)
    starts = np.array([p for p in suspects if seen[ids[p : p + width].tobytes()] > 1], dtype=np.int64)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def facts(text: str | None) -> tuple[int, ...]:
    """The counts of ``FACTS`` for one text; all zero for null."""
    if not text:
        return (0,) * len(FACTS)
    data = text.encode()
    words = data.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    lines, seen = [line for line in data.split(b"\n") if line.split(None, 1)], set()
    dup = 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    raw = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    # code points that are not blank: bytes that start one, less the blanks
    points = int(counts[:0x80].sum() + counts[0xC0:].sum() - counts[0x20] - counts[0x09:0x0E].sum())
    upper = int(counts[0x41:0x5B].sum())
    return (
        len(words),
        points,
        int(sum(counts[ord(c)] for c in SYMBOLS)),
        dup,
        repeat_words(ids),
        len(lines),
        sum(line.rstrip().endswith(CLOSED) for line in lines),
        len(numbers),
        int((ids[1:] == ids[:-1]).sum()),
        len(PLAIN.findall(data)),
        upper,
        upper + int(counts[0x61:0x7B].sum()),
        int(counts[0x21]),
    )


def _facts_of(texts: pd.Series) -> pd.DataFrame:
    found = [facts(t) for t in texts]
    return pd.DataFrame(np.array(found, dtype=np.int64).reshape(len(found), len(FACTS)), columns=FACTS)


def with_facts(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``facts`` of the counts of each text."""
    count = F.pandas_udf(_facts_of, ", ".join(f"{name} long" for name in FACTS))
    return docs.withColumn("facts", count("text"))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), -1).otherwise(0).cast("int")


#: Shares are compared as products, so texts without words divide by nothing. The values hold for whole texts in any
#: language that puts blanks between words. Each rule looks at another side of a text: votes that merely repeat
#: each other would be counted as agreement.
RULES = [
    Rule("length", "n_words >= 100", "n_words < 20"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("plain", "10 * n_plain >= 9 * n_words AND n_words > 0", "10 * n_plain < 7 * n_words"),
    Rule("shouting", "5 * n_upper <= n_letters AND 50 * n_marks <= n_words", "2 * n_upper > n_letters OR 10 * n_marks > n_words"),
    Rule("repetition", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words OR 5 * n_echo > n_words OR 3 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("closed_lines", "10 * n_closed >= 7 * n_lines", "10 * n_closed < 2 * n_lines"),
]

BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Model:
    """Log odds of the prior, and for each rule the log odds that a vote of -1, 0 or 1 adds."""

    prior: float
    votes: list[tuple[float, float, float]]


#: Where estimation starts: shares of votes -1, 0, 1 on good and on bad texts, and the share of good texts. A bad
#: text breaks few of the rules, a good one hardly any; this also decides which class is the good one.
START_GOOD, START_BAD, START_SHARE = (0.01, 0.09, 0.90), (0.30, 0.10, 0.60), 0.8


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 200) -> Model:
    """Expectation-maximisation for two hidden classes and votes that are independent within a class.

    Counts are smoothed by one vote each way, so that a vote never seen in a class stays possible.
    """
    keys = sorted(patterns)
    first = [tuple(math.log(g / b) for g, b in zip(START_GOOD, START_BAD, strict=True))] * rules
    model = Model(math.log(START_SHARE / (1 - START_SHARE)), first)
    if not keys:
        return model
    weight = np.array([patterns[k] for k in keys], dtype=float)
    seen = np.array([[[k[j] == v for v in (-1, 0, 1)] for j in range(rules)] for k in keys], dtype=float)
    score = model.prior + np.einsum("pjv,jv->p", seen, np.array(first))
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        one, two = weight * good, weight * (1 - good)
        like_good = (np.einsum("p,pjv->jv", one, seen) + 1) / (one.sum() + 3)
        like_bad = (np.einsum("p,pjv->jv", two, seen) + 1) / (two.sum() + 3)
        gain = np.log(like_good) - np.log(like_bad)
        # a vote for good never counts against it, nor one for bad against bad
        gain[:, 2], gain[:, 0] = np.maximum(gain[:, 2], 0), np.minimum(gain[:, 0], 0)
        start = math.log((one.sum() + 1) / (two.sum() + 1))
        before, score = score, start + np.einsum("pjv,jv->p", seen, gain)
        model = Model(float(start), [tuple(map(float, g)) for g in gain])
        if np.abs(score - before).max() < 1e-9:
            break
    return model


def posterior(model: Model, votes: list[Column]) -> Column:
    """Probability that a row with these votes is good."""
    score = F.lit(model.prior)
    for vote, (bad, none, good) in zip(votes, model.votes, strict=True):
        score = score + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
    return 1 / (1 + F.exp(-score))


def _fit(voted: DataFrame, names: list[str]) -> Model:
    # at most 3 ^ rules rows come to the driver
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate({tuple(row[n] for n in names): row["n"] for row in counted}, len(names))


def label(docs: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``vote_<rule>``, ``quality`` (the posterior), ``base_failed``, ``kept``.

    ``kept`` takes a base that has not failed and a posterior at the threshold or above. A null or empty
    text has counts of zero and takes part (its base fails). Repeated rows count each; an empty table
    gives no rows; null ids pass through; other columns of ``docs`` are ignored.
    """
    names = [f"vote_{r.name}" for r in rules]
    counted = with_facts(docs.select(docs["doc_id"].cast("long"), "text")).select("doc_id", "facts.*")
    voted = cut_lineage(counted.select("*", *[r.vote().alias(n) for r, n in zip(rules, names, strict=True)]), "votes")
    quality = posterior(_fit(voted, names), [F.col(n) for n in names])
    return (
        voted.withColumn("quality", quality)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """The documents that ``label`` keeps, with all their columns.

    The corpus is read twice, once for the votes and once to judge, so texts are never moved and every
    row is judged on its own text whatever its id.
    """
    names = [f"vote_{r.name}" for r in rules]
    votes = [r.vote().alias(n) for r, n in zip(rules, names, strict=True)]
    voted = cut_lineage(with_facts(docs.select("text")).select("facts.*").select(*votes), "votes")
    model = _fit(voted, names)
    judged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text")
    judged = with_facts(judged).select("doc", "facts.*").select("doc", F.expr(BASE_FAILED).alias("failed"), *votes)
    good = ~F.col("failed") & (posterior(model, [F.col(n) for n in names]) >= threshold)
    return judged.where(good).select("doc.*")
