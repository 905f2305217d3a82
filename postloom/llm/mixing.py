"""Mixing documents to target weights of domains, with soft membership.

A classifier learned from labelled rows gives each document its posterior over domains; a document's
tokens count to the domains in those shares. Nonnegative rates for the documents are then fitted by
projected-gradient least squares, so that the expected tokens of every domain meet their target.

Only built-in functions. What a step brings to the driver is one number for each domain.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import cut_lineage

#: Feature that every text has: it carries what the model adds whatever the words are.
ALWAYS = "\x00always"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Settings:
    """Bounds and parameters. ``labelled`` bounds the model; every document is scored and fitted."""

    labelled: int = 20_000
    least_texts: int = 3
    #: Least likelihood-ratio statistic of a feature, so that words which differ by chance stay out.
    least_told: float = 30.0
    #: Least log ratio of a feature's share in a domain to its share overall; smaller ones are left out, as many of
    #: them add up in long texts.
    least_weight: float = 0.7
    #: Least share of a domain that a mark must be in for its absence to count.
    least_cover: float = 0.02
    #: Weight of staying at rate 1, against meeting the targets.
    stay: float = 1e-4
    #: Largest rate; None sets no bound.
    most: float | None = None
    #: The fit ends when no domain misses its target by more than this share of its supply, or when a step changes the
    #: misses by less than a twentieth of it; at the latest after so many steps. Misses are returned.
    steps: int = 100
    tolerance: float = 1e-4
    #: Steps between two writings of the rates.
    piece: int = 12
    #: Rates this near a whole number are that number. It is for rounding error only: were small rates taken for none,
    #: a domain whose documents all have one would have no tokens left.
    snap: float = 1e-6


def features(text: Column) -> Column:
    """Distinct lower-case words of a text, and marks of its form; empty for a text without words."""
    words = F.array_remove(F.split(F.lower(text), r"[\s.,;:!?]+"), "")
    distinct = F.array_distinct(words)
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    marks = F.length(text) - F.length(F.translate(text, "!", ""))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    n = F.size(words)

    def band(name: str, top: Column, bottom: Column) -> Column:
        return F.concat(F.lit(f"\x00{name} "), F.floor(10 * top / F.greatest(bottom, F.lit(1))).cast("string"))

    form = F.array(
        band("variety", F.size(distinct), n),
        band("symbols", F.least(symbols, n), n),
        band("marks", F.least(marks, n), n),
        band("capitals", capitals, F.length(text)),
    )
    return F.concat(distinct, form)


def _featured(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``text_key``, ``tokens`` and one row for each ``feature`` (a hash) of a text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("long").alias("tokens"),
        F.concat(F.array(F.lit(ALWAYS)), features(text)).alias("words"),
    )
    # no array is empty; the plain explode would filter by its size, working the words out once more and, below a
    # join, for every document
    exploded = rows.select("row", "doc_id", "text_key", "tokens", F.explode_outer("words").alias("word"))
    return exploded.select("row", "doc_id", "text_key", "tokens", F.xxhash64("word").alias("feature"))


def sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled ids (``doc_id``, ``domain``), those of the smallest hashes; one domain for an id."""
    one = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Weights of a naive Bayes model: ``feature`` and ``w0``, ``w1``, ... for the domains.

    Learned from the labelled sample, whose size is bounded; keeps all features that tell about the
    domain beyond chance. The absence of a feature counts only against a domain that it marks: the
    absence of ordinary words would count against short texts. The row of ``ALWAYS`` holds the prior and
    the absence of all marks, which a mark's own weight takes back. A feature needs several of the labelled texts
    to be beyond chance, so the model is bounded by the words of ``settings.labelled`` texts.
    """
    # bounded by settings.labelled rows of an id and a name
    known = F.broadcast(sample(labels, settings.labelled))
    seen = _featured(docs.join(known, "doc_id")).join(known, "doc_id")
    held = [F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]
    counts = cut_lineage(seen.groupBy("feature").agg(*held), "features")
    always = F.xxhash64(F.lit(ALWAYS))
    totals = counts.where(F.col("feature") == always).first()
    n = [float(totals[f"c{k}"]) if totals else 0.0 for k in range(len(domains))]
    whole = sum(n)

    rate = [(F.col(f"c{k}") + 0.5) / (n[k] + 1) for k in range(len(domains))]
    held_by = sum((F.col(f"c{k}") for k in range(len(domains))), F.lit(0))
    mean = (held_by + 0.5) / (whole + 1)
    share = [(x + 1) / (whole + len(domains)) for x in n]
    told = sum(
        (s * (r * F.log(r / mean) + (1 - r) * F.log((1 - r) / (1 - mean))) for s, r in zip(share, rate, strict=True)),
        F.lit(0.0),
    )
    ratio = [F.log(r / mean) for r in rate]
    marks = [(x >= settings.least_weight) & (r >= settings.least_cover) for x, r in zip(ratio, rate, strict=True)]
    absent = [F.when(m, F.log((1 - r) / (1 - mean))).otherwise(0.0) for m, r in zip(marks, rate, strict=True)]
    apart = [
        (F.when(F.abs(x) >= settings.least_weight, x).otherwise(0.0) - a).alias(f"w{k}")
        for k, (x, a) in enumerate(zip(ratio, absent, strict=True))
    ]
    apart += [a.alias(f"a{k}") for k, a in enumerate(absent)]
    chosen = (
        counts.where((F.col("feature") != always) & (held_by >= settings.least_texts))
        .select("feature", told.alias("told"), *apart)
        .where(2 * whole * F.col("told") >= settings.least_told)
        # a feature whose weights are all left out would only lengthen the model
        .where(F.greatest(*[F.abs(x) for x in ratio], F.lit(0.0)) >= settings.least_weight)
    )
    chosen = cut_lineage(chosen, "model")
    weights = [f"w{k}" for k in range(len(domains))]
    base = chosen.agg(
        *[(F.coalesce(F.sum(f"a{k}"), F.lit(0.0)) + math.log(x)).alias(w) for k, (x, w) in enumerate(zip(share, weights, strict=True))]
    )
    return cut_lineage(chosen.select("feature", *weights).unionByName(base.withColumn("feature", always)), "model")


def _constant(values: list, kind: str) -> Column:
    """An array as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _perfect(features: list[int]) -> tuple[list[int], list[int | None]]:
    """Shifts and slots of a hash table without clashes: feature f is in slot (f >> 20) ^ shift of its low bits."""
    groups, size = 1 << len(features).bit_length(), 1 << (4 * len(features) + 1).bit_length()
    while True:
        held: dict[int, list[int]] = {}
        for number, feature in enumerate(features):
            held.setdefault(feature & (groups - 1), []).append(number)
        shifts, slots = [0] * groups, [None] * size
        for group, numbers in sorted(held.items(), key=lambda g: -len(g[1])):
            places = [(features[n] % (1 << 64) >> 20) & (size - 1) for n in numbers]
            shift = next((s for s in range(size) if all(slots[p ^ s] is None for p in places)), None)
            if shift is None or len(set(places)) < len(places):
                break
            shifts[group] = shift
            for n, p in zip(numbers, places, strict=True):
                slots[p ^ shift] = n
        else:
            return shifts, slots
        size *= 2


def _lookup(model: DataFrame, keys: range):
    """How a feature is looked up: its slot, whether it is what stands there, and the weights by slot.

    The features are a hash table that is a constant of the plan.
    """
    rows = sorted(tuple(r) for r in model.select("feature", *[f"w{k}" for k in keys]).collect())
    shifts, slots = _perfect([r[0] for r in rows])
    shift, table = _constant(shifts, "int"), _constant([None if n is None else rows[n][0] for n in slots], "bigint")
    numbers, weights = _constant(slots, "int"), [_constant([r[1 + k] for r in rows], "double") for k in keys]

    def slot(feature: Column) -> Column:
        own = F.shiftrightunsigned(feature, 20).bitwiseAND(F.lit(len(slots) - 1)).cast("int")
        return own.bitwiseXOR(F.get(shift, feature.bitwiseAND(F.lit(len(shifts) - 1)).cast("int")))

    def there(feature: Column, at: Column) -> Column:
        return F.get(table, at) == feature

    return slot, there, [lambda at, w=w: F.get(w, F.get(numbers, at)) for w in weights]


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """``doc_id``, ``text_key``, ``tokens`` and the posterior ``p0``, ``p1``, ... of every row.

    The words of a text are looked up in the model where they lie; what leaves a task is a row of sums for each text.
    """
    keys = range(len(domains))
    slot, there, weights = _lookup(model, keys)
    placed = _featured(docs).withColumn("slot", slot(F.col("feature")))
    met = placed.where(there(F.col("feature"), F.col("slot")))
    scored = met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"),
        F.first("tokens").alias("tokens"),
        *[F.sum(w(F.col("slot"))).alias(f"s{k}") for k, w in zip(keys, weights, strict=True)],
    )
    best = F.greatest(*[F.col(f"s{k}") for k in keys]) if len(domains) > 1 else F.col("s0")
    raised = scored.select("doc_id", "text_key", "tokens", *[F.exp(F.col(f"s{k}") - best).alias(f"e{k}") for k in keys])
    whole = sum((F.col(f"e{k}") for k in keys), F.lit(0.0))
    return raised.select("doc_id", "text_key", "tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in keys])


def fit_rates(soft: DataFrame, targets: list[float], settings: Settings = Settings()) -> tuple[DataFrame, list[float]]:  # noqa: B008
    """``soft`` with ``rate``: rates from 0 to ``settings.most`` whose expected domain tokens come nearest to ``targets``.

    Minimises the squared misses, each over the domain's supply, plus ``settings.stay`` times the squared
    distance from rate 1, weighted by tokens, by projected gradients with momentum (Nesterov). In that scale the
    curvature is at most 1 + stay, which sets the step. Each step sums the domains' expected tokens in one pass; rates are
    written every few steps. Returned with the misses that are left, each as a share of the domain's supply: targets
    that the bounds put out of reach are missed by the least squares.
    """
    keys, base = range(len(targets)), soft.columns
    step = 1 / (1 + settings.stay)
    rows = soft.withColumns({"rate": F.lit(1.0), "last": F.lit(1.0)})
    supply = _expected(rows, F.col("rate"), keys)
    scale = [max(x, 1e-9 * sum(supply), 1e-300) for x in supply]

    def misses(column: Column) -> list[float]:
        return [(x - t) / s for x, t, s in zip(_expected(rows, column, keys), targets, scale, strict=True)]

    miss = [math.inf for _ in keys]
    for done in range(settings.steps):
        rows = rows.select(*base, "rate", (F.col("rate") + (F.col("rate") - F.col("last")) * (done / (done + 3))).alias("ahead"))
        before, miss = miss, misses(F.col("ahead"))
        moved = max(abs(m - b) for m, b in zip(miss, before, strict=True))
        if max(map(abs, miss)) < settings.tolerance or moved < settings.tolerance / 20:
            break
        pull = sum((F.col(f"p{k}") * (step * m) for k, m in zip(keys, miss, strict=True)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.col("ahead") * (1 - step * settings.stay) + step * settings.stay - pull)
        if settings.most is not None:
            rate = F.least(F.lit(settings.most), rate)
        rows = rows.select(*base, rate.alias("next"), F.col("rate").alias("last")).withColumnRenamed("next", "rate")
        if done % settings.piece == settings.piece - 1:
            rows = cut_lineage(rows, "rates")
    return rows.select(*base, "rate"), misses(F.col("rate"))


def _expected(rows: DataFrame, rate: Column, keys: range) -> list[float]:
    sums = rows.agg(*[F.coalesce(F.sum(rate * F.col("tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in keys]).first()
    return [float(x) for x in sums]


def copies(rate: Column, doc_id: Column, near: float = 0.05) -> Column:
    """Whole number of copies for a rate: its fraction is the chance of one more, drawn by a hash of the id.

    A rate within ``near`` of a whole number is that number.
    """
    low = F.floor(rate)
    part = rate - low
    draw = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    more = F.when(part <= near, 0).when(part >= 1 - near, 1).otherwise((draw < part).cast("int"))
    return (low + more).cast("int")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    anchor: str,
    settings: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``tokens``, ``p_<domain>``, ``rate``, ``copies``, ``missed``.

    ``labels`` has ``doc_id`` and ``domain``; ``weights`` the wanted share of tokens of each domain. The
    total is chosen so that the domain ``anchor`` keeps the tokens it has. Null and empty texts have no
    tokens and the prior for a posterior; without labels every posterior is even. Labels that are null
    or of other domains say nothing, an id labelled twice counts once. Repeated rows are fitted each; a
    null ``doc_id`` passes through; an empty table gives no rows; other columns are ignored. ``missed`` is the
    largest share of a domain's tokens by which the rates miss its target, the same in all rows.
    """
    domains = sorted(weights)
    known = labels.where(F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(plain, known, domains, settings)
    soft = cut_lineage(posteriors(plain, model, domains), "soft")
    supply = _expected(soft, F.lit(1.0), range(len(domains)))
    total = supply[domains.index(anchor)] / weights[anchor]
    fitted, misses = fit_rates(soft, [total * weights[d] for d in domains], settings)
    named = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    return fitted.select(
        "doc_id", "text_key", "tokens", *named, "rate", copies(F.col("rate"), F.col("doc_id"), settings.snap).alias("copies"),
        F.lit(max(map(abs, misses), default=0.0)).alias("missed"),
    )


def mixed(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as ``rates`` has copies for it, with their columns.

    Rows are told apart by ``doc_id`` and text, null or not; of repeated rows each is written as often. Columns of
    any name are carried. An empty table gives no rows.
    """
    wanted = rates.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.max("copies").alias("_copies")
    )
    # rows are carried whole, so that no column of theirs meets a name used here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("key"))
    held = rows.join(wanted.where("_copies > 0"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return held.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def domain_of(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` (toxic, junk or clean) from ``quality`` and ``toxic``; null where both are."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id"), domain.alias("domain"))
