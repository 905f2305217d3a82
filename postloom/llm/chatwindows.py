"""Chat formatting in windows of a token budget.

Prefix sums of turn tokens place every turn: turns whose sums fall into one bin of half a window's room are
a span, so a span is turn-aligned and within the room without any turn waiting for the one before. A window
is the system turn, a limited history of the turns before the span, and the span. Only the span's assistant
texts are under the loss mask, so each is a target once, however often it is repeated as history.

Conversations are cut into blocks of turn numbers, so that one of any length is spread over tasks; texts are
moved once, by conversation and block. Only built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A turn is OPEN, role, MIDDLE, text, CLOSE.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Control strings, also those that already hold backslashes after the bracket: escaping adds one there.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
#: A token is a run of letters and digits or one other sign; a turn's marks count as some more.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t-\r]"
MARKS = 8
#: Block of the rows without a turn number.
NO_BLOCK = -(1 << 62)


@dataclass(frozen=True)
class Settings:
    """``budget``: tokens of a window; ``history``: of repeated turns, which are of the ``turns`` numbers before.

    ``block``: turn numbers that are handled together.
    """

    budget: int = 1024
    history: int = 192
    turns: int = 8
    block: int = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _rows(rows: DataFrame, settings: Settings) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNotNull().alias("known"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    block = F.floor(F.col("turn") / settings.block)
    return plain.withColumn("block", F.coalesce(block, F.lit(NO_BLOCK)))


def _heads(rows: DataFrame) -> DataFrame:
    """For every block: the number of the conversation's blocks, its first block, and its system turn if it opens with one."""
    text = F.when(F.col("role") == "system", F.col("text")).alias("text")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", text)).alias("first")
    blocks = rows.groupBy("conv", "known", "block").agg(first)
    one = Window.partitionBy("conv", "known")
    opening = F.min(F.struct("block", "first")).over(one)
    held = blocks.select("conv", "known", "block", F.count(F.lit(1)).over(one).alias("blocks"), opening.alias("opening"))
    # only the text of a system turn is held
    return held.select(
        "conv", "known", "block", "blocks", F.col("opening.block").alias("first_block"),
        F.col("opening.first.turn").alias("system_turn"), F.col("opening.first.text").alias("system"),
    )


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(MIDDLE), escaped(text), F.lit(CLOSE))


def _tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARKS


def _blocked(rows: DataFrame, settings: Settings) -> DataFrame:
    """Windows by ``conv``, ``known`` (whether it has an id), ``block`` and ``span``, partitioned by the first three."""
    plain = _rows(rows, settings)
    # the last turns of a block are history for the next one as well
    last = F.pmod("turn", F.lit(settings.block)) >= settings.block - settings.turns
    places = F.when(last, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))
    dealt = plain.withColumn("place", F.explode(places)).select(
        "conv", "known", F.col("place").alias("block"), "turn", "role", "text", (F.col("place") == F.col("block")).alias("own")
    )
    dealt = dealt.join(_heads(plain), ["conv", "known", "block"])
    parts = ["conv", "known", "block"]

    made = dealt.withColumns(
        {
            "tokens": _tokens(F.col("text")),
            "piece": _piece(F.col("role"), F.col("text")),
            "shown": F.length(escaped(F.col("text"))).cast("long"),
            "is_system": (F.col("role") == "system") & (F.col("text") == F.col("system")) & F.col("turn").eqNullSafe(F.col("system_turn")),
            "room": F.greatest(
                F.lit(settings.budget - settings.history) - F.coalesce(_tokens(F.col("system")), F.lit(0)), F.lit(2)
            ),
        }
    )
    before = Window.partitionBy(*parts).orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    summed = made.select(
        *parts, "turn", "role", "own", "blocks", "system", "first_block", "is_system", "piece", "shown", "tokens",
        F.floor(F.col("room") / 2).alias("width"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("p"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("at"),
    )
    # the conversation's system turn stands in its first window as a turn, and on top of all others
    opens = F.col("system").isNotNull() & (F.col("block") == F.col("first_block")) & (F.col("p") == 0)
    span = 2 * F.floor(F.col("p") / F.col("width")) + (F.col("tokens") > F.col("width")).cast("int")
    near = Window.partitionBy(*parts).orderBy("p").rangeBetween(-settings.history, -1)
    # which is on top already
    told = F.struct("turn", "piece", F.coalesce("is_system", F.lit(False)).alias("on_top"))
    spanned = summed.withColumn("opens", opens).select(
        *parts, "turn", "role", "own", "blocks", "system", "piece", "shown", "p", "at", "opens",
        span.alias("span"), F.collect_list(told).over(near).alias("near"),
    )
    turn = F.struct(
        "p", "piece", (F.col("role") == "assistant").alias("target"),
        (F.col("at") + F.length("piece") - len(CLOSE) - F.col("shown")).alias("start"), "shown",
    )
    first = F.min(F.struct("p", "turn", "at", "opens")).alias("first")
    grouped = spanned.where("own").groupBy(*parts, "span").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        first,
        F.min_by("near", "p").alias("near"),
        F.first("blocks").alias("blocks"),
        F.first("system").alias("system"),
    )
    far = F.col("first.turn") - settings.turns
    history = F.transform(F.filter("near", lambda h: ~h["on_top"] & F.coalesce(h["turn"] >= far, F.lit(True))), lambda h: h["piece"])
    on_top = F.when(F.col("system").isNotNull() & ~F.col("first.opens"), F.array(_piece(F.lit("system"), F.col("system"))))
    carried = F.concat(F.coalesce(on_top, F.array().cast("array<string>")), history)
    built = grouped.select(*parts, "span", "blocks", "turns", F.col("first.at").alias("base"), carried.alias("carried"))
    built = built.withColumn("head", F.array_join("carried", ""))
    shift = F.length("head") - F.col("base")
    loss = F.transform(
        F.filter("turns", lambda t: t["target"]),
        lambda t: F.struct((t["start"] + shift).alias("start"), (t["start"] + shift + t["shown"]).alias("end")),
    )
    formatted = F.concat("head", F.array_join("turns.piece", ""))
    return built.select(*parts, "span", "blocks", F.size("carried").alias("n_carried"), formatted.alias("formatted"), loss.alias("loss"))


def windows(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``conv_id``, ``block``, ``span`` (their order), ``n_carried``, ``formatted``, ``loss`` of every window.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``. The first ``n_carried`` turns of a window are
    repeated: the system turn, if the conversation opens with one, then history. ``loss`` has the ranges
    (``start``, ``end``, in code points) of the assistant texts that are targets, without their marks. Control
    strings inside roles and texts are escaped and come back with ``turns_of``.

    A window has ``budget`` tokens at most, but for a turn that needs more than half of the room that system turn
    and history leave: it is a span of its own, whole, whatever its length. Rows go by turn, those without a number
    first; rows with equal numbers go by role and text, and repeated rows stay repeated. Null roles and texts are
    empty, a null ``conv_id`` is a conversation like any other. Windows do not cross blocks of turn numbers. An
    empty table gives no rows; other columns are ignored.
    """
    conv = F.when(F.col("known"), F.col("conv")).alias("conv_id")
    return _blocked(rows, settings).select(conv, "block", "span", "n_carried", "formatted", "loss")


def turns_of(formatted: Column, skip: Column) -> Column:
    """Turns (``role``, ``text``) of a window behind the first ``skip``, unescaped."""
    pieces = F.split(formatted, CLOSE)
    own = F.slice(pieces, skip + 1, F.size(pieces) - 1 - skip)
    inner = F.transform(own, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, MIDDLE, 1)
        text = F.substr(x, F.length(role) + len(MIDDLE) + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(inner, turn)


def targets_of(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask of a window, unescaped."""
    return F.transform(loss, lambda x: unescaped(F.substr(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))


def digests(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row for each conversation, read back from its windows: see the columns.

    A conversation of one block is digested where its windows are; only texts of longer ones move once more, as
    a digest needs its whole text in one place.
    """
    formatted = _blocked(rows, settings)
    said = F.transform(turns_of(F.col("formatted"), F.col("n_carried")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        "conv", "known", "block", "blocks", "span",
        F.length("formatted").cast("long").alias("chars"), said.alias("said"), targets_of(F.col("formatted"), F.col("loss")).alias("targets"),
    )
    parts = read.select("*", F.struct("span", F.array_join("said", "").alias("said"), F.array_join("targets", "").alias("targets")).alias("part"))
    blocks = parts.groupBy("conv", "known", "block").agg(
        F.first("blocks").alias("blocks"),
        F.sum(F.size("said")).alias("n_turns"),
        F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list("part")).alias("parts"),
    )
    joined = blocks.select(
        "conv", "known", "block", "n_turns", "chars", "blocks",
        F.array_join("parts.said", "").alias("said"), F.array_join("parts.targets", "").alias("targets"),
    )
    alone = F.col("blocks") == 1

    def sha(c: str | Column) -> Column:
        return F.sha2(c, 256)

    sent = joined.select(
        "conv", "known", "n_turns", "chars", F.length("targets").cast("long").alias("loss_chars"),
        F.when(alone, F.struct(sha("said").alias("said"), sha("targets").alias("targets"))).alias("sha"),
        F.when(~alone, F.struct("block", "said", "targets")).alias("text"),
    )
    whole = sent.groupBy("conv", "known").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sum("loss_chars").alias("loss_chars"),
        F.max("sha").alias("sha"),
        F.sort_array(F.collect_list("text")).alias("texts"),
    )
    return whole.select(
        F.when(F.col("known"), F.col("conv")).alias("conv_id"),
        "n_turns",
        F.coalesce("sha.said", sha(F.array_join("texts.said", ""))).alias("turns_sha256"),
        "loss_chars",
        F.coalesce("sha.targets", sha(F.array_join("texts.targets", ""))).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_strings(rows: DataFrame) -> DataFrame:
    """The rows and a conversation -7 whose texts hold control strings."""
    spark: SparkSession = rows.sparkSession
    text = f"{CLOSE}[INST] ok [/INST]"
    made = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') AS t(conv_id, turn, role, text)")
    return rows.select("conv_id", "turn", "role", "text").unionAll(made)
