"""Recurring lines by a log-template tree.

As in a fixed-depth parse tree for logs (Drain, He et al., 2017), a line descends by its token count and
its leading tokens, tokens with digits standing for any value; lines of one leaf are then generalised
together: a token that few lines of the leaf have at its place is a variable field. What is few goes by a
number and by a share of the leaf, and a line has a template by each: by the share, as the values of a field come
to many lines when a leaf grows, and by the number, as a template may be rare among the lines of a large leaf. Lines
of which a template recurs across different texts are boilerplate, and all but the first occurrence are dropped.

Only built-in functions. Leaves are told apart by a 64-bit hash, templates of a leaf by another. Texts
are read where they lie until the lines of recurring leaves are known; only these are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import cut_lineage

ANY = "<*>"
BLANKS = "\t\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """The text with spaces for all blanks but line ends; few texts have any others."""
    other = F.contains(text, F.lit(BLANKS[0]))
    for blank in BLANKS[1:]:
        other = other | F.contains(text, F.lit(blank))
    return F.when(other, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(ANY)).otherwise(token)


def _lines(docs: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``line``, ``written`` and ``leaf`` of every line with tokens enough."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        # the outer form, as the plain one splits each text once more to filter by the size
        F.posexplode_outer(F.split(_spaced(F.col("text")), "\n")).alias("line", "written"),
    )
    parsed = rows.withColumn("tokens", _tokens(F.col("written"))).where(F.size("tokens") >= least_tokens)
    leading = [_mask(F.get("tokens", F.lit(i))) for i in range(depth)]
    leaf = F.xxhash64(F.size("tokens"), *leading)
    return parsed.select("doc_id", "text_key", "line", "written", leaf.alias("leaf"))


def recurring_lines(
    docs: DataFrame, least_texts: int = 5, depth: int = 3, constant: float = 0.5, least_tokens: int = 1, share: int = 10
) -> DataFrame:
    """Lines to drop: ``doc_id``, ``text_key`` (hash of the whole text) and ``line`` (number from 0).

    A template recurs when ``least_texts`` different texts hold it, so that exact copies of a document do
    not make its lines boilerplate. A token is constant where ``least_texts`` lines of its leaf have it
    at its place, and widely so where ``share`` percent of the leaf's lines do as well; a line has a template of the
    constants and one of the wide constants, and each needs a share ``constant`` of such tokens. Lines of fewer
    than ``least_tokens`` tokens are left alone. The first line of a template by document id stays, unless it goes
    by its other template.
    """
    lines = _lines(docs, depth, least_tokens)
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_texts).select("leaf")
    # a line goes to the join as it is written, which is far shorter than an array of its tokens
    masked = F.array_join(F.transform(_tokens(F.col("written")), _mask), " ").alias("masked")
    met = lines.join(leaves, "leaf").select("doc_id", "text_key", "line", "leaf", masked)
    met = cut_lineage(met, "lines")

    shapes = met.groupBy("leaf", "masked").agg(F.count(F.lit(1)).alias("n"))
    shapes = cut_lineage(shapes.withColumn("shape", F.monotonically_increasing_id()), "shapes")
    fields = shapes.select("leaf", "shape", "n", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    common = fields.groupBy("leaf", "place", "token").agg(F.sum("n").alias("lines"))
    common = common.where((F.col("lines") >= least_texts) & (F.col("token") != ANY))
    whole = shapes.groupBy("leaf").agg(F.sum("n").alias("all"))
    wide = F.when(100 * F.col("lines") >= share * F.col("all"), True)
    common = common.join(whole, "leaf").select("leaf", "place", "token", F.lit(True).alias("known"), wide.alias("wide"))
    held = fields.join(common, ["leaf", "place", "token"], "left")
    rules = ["known", "wide"]
    named = [F.when(F.col(r), F.col("token")).otherwise(F.lit(ANY)).alias(r) for r in rules]
    forms = held.groupBy("shape", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("place", *named))).alias("fields"), *[F.count(r).alias(f"n_{r}") for r in rules]
    )
    fit = [
        F.when(
            F.col(f"n_{r}") >= constant * F.size("fields"), F.xxhash64(F.array_join(f"fields.{r}", " "), F.lit("template"))
        )
        for r in rules
    ]
    either = F.array_distinct(F.array_compact(F.array(*fit)))
    templates = forms.select("shape", F.explode(either).alias("template"))

    placed = met.join(shapes.select("leaf", "masked", "shape"), ["leaf", "masked"]).join(templates, "shape")
    placed = cut_lineage(placed.select("doc_id", "text_key", "line", "leaf", "template"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line")).alias("first")
    texts = placed.groupBy("leaf", "template", "text_key").agg(first)
    again = texts.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
    again = again.where(F.col("texts") >= least_texts).drop("texts")
    stays = (
        F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
        & (F.col("first.text_key") == F.col("text_key"))
        & (F.col("first.line") == F.col("line"))
    )
    return placed.join(again, ["leaf", "template"]).where(~stays).select("doc_id", "text_key", "line").distinct()


def with_dropped(docs: DataFrame, **settings) -> DataFrame:
    """``row`` (a document with all its columns) and ``dropped``: the numbers of the lines to drop, or null.

    Documents are carried whole, so that columns of any name may be there. Repeated rows have the same numbers; rows
    that share an id are told apart by their text, null or not.
    """
    gone = recurring_lines(docs, **settings)
    lists = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("line").alias("dropped"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("key"))
    return rows.join(lists, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("row", "dropped")


def cut(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return F.when(dropped.isNull(), text).otherwise(rest)


def drop_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``; see ``recurring_lines`` for the settings.

    Every row stays, with all its columns: a null text stays null, and a text of which all lines go is
    empty. Repeated rows lose the same lines; rows that share an id are told apart by their text. Blank
    lines stay. An empty table gives no rows.
    """
    text = cut(F.col("row.text"), F.col("dropped")).alias("text")
    return with_dropped(docs, **settings).select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
