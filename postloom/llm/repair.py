"""Repair of the turn structure of conversations by rank-convergence parallel Viterbi.

The turns that stay must read system?, then user and assistant in turn. The cheapest edits follow from a
vector of four backward costs, one for each state of that grammar, which runs from a conversation's last
turn to its first. A vector matters up to a constant only, and few normal forms exist (``FORMS``).

As in Maleki et al. (2014), a conversation is cut into chunks that all start at once, each from a speculative
vector. Fix-up passes then rerun chunks from the vectors that the chunk behind them may give, each rerun only as
far as its vector differs by more than a constant from the one before. When no chunk is asked for a vector it has
not run from, the true vectors are stitched from chunk to chunk, and with them every chunk traces its edits by
itself: least audit first, from the state that the chunk before ends in.

A chunk is some bytes for a turn. Texts take no part until the edits are known; they meet theirs by a hash of
role and text, as only the first of equal turns can stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import cut_lineage

#: What ASCII white space is here.
BLANKS = " \t\n\x0b\x0c\r"
#: Turns of a chunk: 2 ^ CHUNK.
CHUNK = 10
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads, and as which role.
STEP = (USER, USER, ASSISTANT, USER)
ROLE = ("u", "u", "a", "u")
#: Where a kept turn leads, by state and initial (0 to 2; 3 is any other).
INITIALS = "sua"
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: A turn's code is its initial and these.
CUT, BLANK, AGAIN = 4, 8, 16


def _closed(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first; two insertions come back to a state passed before."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[STEP[s]]) for s, c in enumerate(costs)]
    return costs


def _options(after: tuple[int, ...], code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, next state and cost of the edits of a turn that may stay."""
    late = TRUNCATED if code & CUT else 0
    yield "D", state, DELETE + after[state]
    if (state, code & 3) in KEEP:
        to = KEEP[state, code & 3]
        yield "K", to, late + after[to]
    yield "R", STEP[state], REROLE + late + after[STEP[state]]


def _build():
    """All normal forms of cost vectors, how a turn's code changes each, and the edit it makes in each state."""
    far = 1 << 20
    forms = [tuple(_closed([0, far, far, 0]))]
    back, edits = [], []
    for after in forms:
        for code in range(8):
            costs = _closed([min(c for _, _, c in _options(after, code, s)) for s in range(4)])
            base = min(costs)
            form = tuple(c - base for c in costs)
            if form not in forms:
                forms.append(form)
            back.append((forms.index(form), base))
            for state in range(4):
                letters, adds, at = "", "", state
                while True:
                    found = [(x, to) for x, to, c in _options(after, code, at) if c == costs[at]]
                    if ("D", at) in found:
                        edits.append((letters + "D", at, adds, ""))
                    elif costs[STEP[at]] + INSERT == costs[at]:
                        letters, adds, at = letters + "I", adds + ROLE[at], STEP[at]
                        continue
                    else:
                        letter, to = min(found)
                        edits.append((letters + letter, to, adds, ROLE[at] if letter == "R" else ""))
                    break
    return forms, back, edits


#: ``BACK[8 * form + code]``: the form before a turn, and what it costs more. ``EDITS[4 * (8 * form + code) + state]``:
#: letters, next state, initials of inserted turns, initial of a new role. The first form is that behind the last turn.
FORMS, BACK, EDITS = _build()
END = 0
#: What is inserted behind the last turn, by state.
TAIL = ("", "ua", "a", "")


def backward(codes: bytes, given: int) -> tuple[int, int]:
    """Form before a chunk and its cost, when ``given`` is the form behind it."""
    form, cost = given, 0
    for code in reversed(codes):
        if code >= BLANK:
            cost += DELETE
        else:
            form, more = BACK[8 * form + code]
            cost += more
    return form, cost


def rerun(codes: bytes, given: int, known: tuple[int, int, int]) -> tuple[int, int]:
    """``backward`` from another form, held against a ``known`` run (given, form, cost) until both are parallel."""
    old, form, more = known[0], given, 0
    for code in reversed(codes):
        if form == old:
            return known[1], known[2] + more
        if code < BLANK:
            (old, x), (form, y) = BACK[8 * old + code], BACK[8 * form + code]
            more += y - x
    return form, known[2] + more


def _behind(codes: bytes, given: int) -> list[int]:
    """The form behind every turn of a chunk."""
    forms, form = [0] * len(codes), given
    for i in range(len(codes) - 1, -1, -1):
        forms[i] = form
        if codes[i] < BLANK:
            form = BACK[8 * form + codes[i]][0]
    return forms


def exits(codes: bytes, given: int) -> bytes:
    """The state behind a chunk for each state before it."""
    behind, states = _behind(codes, given), []
    for state in range(4):
        for code, form in zip(codes, behind, strict=True):
            if code < BLANK:
                state = EDITS[4 * (8 * form + code) + state][1]
        states.append(state)
    return bytes(states)


def trace(codes: bytes, given: int, state: int, last: bool) -> tuple[str, list[tuple[int, str, str]], str]:
    """Audit of a chunk; turns that stay, with the initials of what is inserted before and of a new role; the tail."""
    letters, kept = [], []
    for i, (code, form) in enumerate(zip(codes, _behind(codes, given), strict=True)):
        if code >= BLANK:
            letters.append("D")
            continue
        edit, state, adds, role = EDITS[4 * (8 * form + code) + state]
        letters.append(edit)
        if edit[-1] != "D":
            kept.append((i, adds, role))
    tail = TAIL[state] if last else ""
    return "".join(letters) + "I" * len(tail), kept, tail


_CONV = ["conv", "known"]


def _plain(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNotNull().alias("known"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit("turn"), role).alias("h2"),
    )


def _code(role: Column, text: Column) -> Column:
    said = F.rtrim(text, F.lit(BLANKS))
    whole = F.substr(said, F.lit(-1), F.lit(1)).isin(".", "!", "?")
    first = F.instr(F.lit(INITIALS), F.substr(role, F.lit(1), F.lit(1)))
    initial = F.when((F.length(role) > 0) & (first > 0), first - 1).otherwise(3)
    return (initial + F.when(said == "", BLANK).when(whole, 0).otherwise(CUT)).cast("short")


def _ordered(plain: DataFrame) -> DataFrame:
    """``place`` (increasing along each conversation), ``turn``, ``h1``, ``h2`` and ``code`` of every turn.

    Turns are dealt in ranges, so that a conversation of any length is spread; the last key tells repeated rows
    apart for that.
    """
    order = ["conv", "known", F.asc_nulls_first("turn"), "role", "h1", "h2", "salt"]
    rows = plain.select(
        "conv", "known", "turn", "role", "h1", "h2", _code(F.col("role"), F.col("text")).alias("code"),
        F.monotonically_increasing_id().alias("salt"),
    )
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv", "known", "turn", "h1", "h2", "code", F.monotonically_increasing_id().alias("place"))
    return cut_lineage(placed, "turns")


def _chunked(turns: DataFrame) -> DataFrame:
    """One row for a chunk: its number ``no``, ``first`` place, ``codes``, hashes of its turns, and counts."""
    chunk = F.shiftright("place", CHUNK).alias("chunk")
    keys = [*_CONV, "h1", "h2"]
    repeated = turns.groupBy(*keys).agg(F.min("place").alias("once"), F.count(F.lit(1)).alias("n")).where("n > 1")
    none = F.lit(0).cast("long")
    again = turns.join(repeated.drop("n"), keys).where("place > once").select(
        *_CONV, chunk, F.struct("place", F.lit(AGAIN).cast("short").alias("code"), none.alias("h1"), none.alias("h2")).alias("turn")
    )
    rows = turns.select(*_CONV, chunk, F.struct("place", "code", "h1", "h2").alias("turn")).unionAll(again)
    held = rows.groupBy(*_CONV, "chunk").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    flat = held.select(*_CONV, "chunk", *[F.col(f"turns.{c}").alias(c) for c in ("place", "code", "h1", "h2")])

    kind = (
        "conv long, known boolean, chunk long, first long, codes binary, h1 array<long>, h2 array<long>, "
        "blank long, duplicate long, truncated long, illegal long, head short, tail short"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        legal = np.array([[a + b in ("su", "ua", "au") for b in INITIALS + "-"] for a in INITIALS + "-"])
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                code = np.asarray(row.code, dtype=np.uint8)
                own = code != AGAIN
                codes = code[own]
                # a mark of repetition follows the turn that it is about
                repeated = np.append(~own, False)[1:][own]
                codes[repeated & (codes < BLANK)] |= AGAIN
                initial = codes & 3
                out.append((
                    row.conv, row.known, row.chunk, row.place[0], codes.tobytes(), np.asarray(row.h1)[own], np.asarray(row.h2)[own],
                    int(((codes & BLANK) > 0).sum()), int((codes >= AGAIN).sum()), int(((codes & 0xFC) == CUT).sum()),
                    int((~legal[initial[:-1], initial[1:]]).sum()), initial[0], initial[-1],
                ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    chunks = flat.mapInPandas(run, kind)
    along, whole = Window.partitionBy(*_CONV).orderBy("chunk"), Window.partitionBy(*_CONV)
    # narrow rows, one for a chunk; those beside codes and hashes would carry them through the window
    chunks = cut_lineage(chunks, "chunks")
    numbers = chunks.select(*_CONV, "chunk", "head", "tail").select(
        *_CONV, "chunk", (F.row_number().over(along) - 1).cast("long").alias("no"), F.count(F.lit(1)).over(whole).alias("chunks"),
        (F.col("tail") * 4 + F.lead("head").over(along)).alias("meet"),
    )
    legal = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")]
    met = F.when(F.col("meet").isNotNull() & ~F.col("meet").isin(legal), 1).otherwise(0)
    joined = chunks.drop("head", "tail").join(numbers, [*_CONV, "chunk"])
    return cut_lineage(joined.withColumn("illegal", F.col("illegal") + met).drop("meet", "chunk"), "numbered")


_RUNS = "conv long, known boolean, no long, given int, made int, cost long"


def _speculated(chunks: DataFrame) -> DataFrame:
    """Every chunk run from the form of an end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [backward(codes, END) for codes in batch["codes"]]
            made, cost = zip(*found, strict=True) if found else ((), ())
            yield batch[["conv", "known", "no"]].assign(given=END, made=list(made), cost=list(cost))

    return chunks.select(*_CONV, "no", "codes").mapInPandas(run, _RUNS)


def _fixed_up(chunks: DataFrame, runs: DataFrame) -> tuple[DataFrame, int]:
    """Runs of all chunks from all forms that the chunk behind may give, and the number of passes.

    A pass runs the chunks of every conversation that lacks some from each form seen so far. A chunk that a later
    pass still lacks has to do with a form seen for the first time, so there are no more passes than forms.
    """
    passes = 0
    while True:
        lacking = _lacking(runs)
        wanted = lacking.select(*_CONV).distinct()
        seen = [r["made"] for r in lacking.select("made").distinct().collect()]  # forms are few by their kind
        if not seen:
            return runs, passes
        passes += 1
        seen = sorted({*seen, *(r["made"] for r in runs.select("made").distinct().collect())})

        def run(batches: Iterator[pd.DataFrame], seen: list[int] = seen) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    before = row.given, row.made, row.cost
                    out += [(row.conv, row.known, row.no, x, *rerun(row.codes, x, before)) for x in seen if x not in row.givens]
                yield pd.DataFrame(out, columns=["conv", "known", "no", "given", "made", "cost"])

        done = runs.groupBy(*_CONV, "no").agg(F.collect_set("given").alias("givens"), F.min(F.struct("given", "made", "cost")).alias("run"))
        done = done.select(*_CONV, "no", "givens", "run.*")
        again = chunks.select(*_CONV, "no", "codes").join(wanted, _CONV, "left_semi").join(done, [*_CONV, "no"])
        runs = cut_lineage(runs.unionAll(again.mapInPandas(run, _RUNS)), "runs")


def _lacking(runs: DataFrame) -> DataFrame:
    """Chunks and the forms that the chunk behind them gives but they have not run from."""
    asked = runs.where("no > 0").select(*_CONV, (F.col("no") - 1).alias("no"), "made").distinct()
    had = runs.select(*_CONV, "no", F.col("given").alias("made"))
    return asked.join(had, [*_CONV, "no", "made"], "left_anti")


def _walked(rows: DataFrame, backwards: bool, start: int, kind: str) -> DataFrame:
    """Go through the chunks of each conversation in turn; ``rows`` has ``no`` and ``steps``, which maps a value to the next.

    Some bytes for a chunk; a task holds one chunk and the value.
    """
    order = [*_CONV, F.desc("no") if backwards else F.asc("no")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, value = None, start
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if at != (row.conv, row.known):
                    at, value = (row.conv, row.known), start
                out.append((row.conv, row.known, row.no, value))
                value = dict(row.steps)[value]
            yield pd.DataFrame(out, columns=["conv", "known", "no", kind])

    dealt = rows.select(*_CONV, "no", "steps").repartition(*_CONV).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, f"conv long, known boolean, no long, {kind} int")


def _stitched(chunks: DataFrame) -> DataFrame:
    """``given`` (the form behind) and ``state`` (before) of every chunk of the conversations of several."""
    several = chunks.where("chunks > 1")
    runs, _ = _fixed_up(several, cut_lineage(_speculated(several), "runs"))
    maps = runs.groupBy(*_CONV, "no").agg(F.map_from_entries(F.collect_list(F.struct("given", "made"))).alias("steps"))
    given = cut_lineage(_walked(maps, True, END, "given"), "given")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [dict(enumerate(exits(c, g))) for c, g in zip(batch["codes"], batch["given"], strict=True)]
            yield batch[["conv", "known", "no"]].assign(steps=steps)

    ends = several.select(*_CONV, "no", "codes").join(given, [*_CONV, "no"])
    ends = ends.mapInPandas(run, "conv long, known boolean, no long, steps map<int, int>")
    return given.join(_walked(ends, False, START, "state"), [*_CONV, "no"])


def _traced(chunks: DataFrame) -> DataFrame:
    """Audit, cost and turns that stay of every chunk."""
    placed = chunks.where("chunks > 1").join(_stitched(chunks), [*_CONV, "no"])
    alone = chunks.where("chunks = 1").withColumns({"given": F.lit(END), "state": F.lit(START)})
    kind = (
        "conv long, known boolean, no long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "tail string, behind long, kept array<struct<place: long, h1: long, h2: long, adds: string, role: string>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                form, cost = backward(row.codes, row.given)
                audit, kept, tail = trace(row.codes, row.given, row.state, row.no == row.chunks - 1)
                stay = [{"place": row.first + i, "h1": row.h1[i], "h2": row.h2[i], "adds": a, "role": r} for i, a, r in kept]
                cost += FORMS[form][START] if row.no == 0 else 0
                out.append((
                    row.conv, row.known, row.no, row.blank, row.duplicate, row.truncated, row.illegal, cost, audit,
                    tail, row.first + len(row.codes), stay,
                ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")][:11] + ["kept"])

    columns = [*_CONV, "no", "chunks", "first", "codes", "h1", "h2", "blank", "duplicate", "truncated", "illegal", "given", "state"]
    return cut_lineage(placed.select(*columns).unionAll(alone.select(*columns)).mapInPandas(run, kind), "traced")


def _added(adds: Column) -> Column:
    """Roles of inserted turns."""
    each = F.filter(F.split(adds, ""), lambda x: x != "")
    return F.transform(each, lambda x: F.when(x == "u", "user").otherwise("assistant"))


def _staying(plain: DataFrame, traced: DataFrame) -> DataFrame:
    """``conv``, ``known``, ``place`` and ``turns`` (role, text): what is inserted before a turn, and the turn as it stays."""
    keys = [*_CONV, "h1", "h2"]
    # turns of one key are equal
    texts = plain.groupBy(*keys).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    stay = traced.select(*_CONV, F.explode("kept").alias("k")).select(
        *_CONV, "k.place", "k.h1", "k.h2", "k.adds", F.col("k.role").alias("new")
    )
    empty = F.transform(_added(F.col("adds")), lambda x: F.struct(x.alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("new") == "u", "user").when(F.col("new") == "a", "assistant").otherwise(F.col("role"))
    own = F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
    kept = texts.join(stay, keys).select(*_CONV, "place", F.concat(empty, own).alias("turns"))
    tails = traced.where("tail <> ''").select(*_CONV, F.col("behind").alias("place"), F.col("tail").alias("adds"))
    return kept.unionAll(tails.select(*_CONV, "place", empty.alias("turns")))


def _worked(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    plain = _plain(rows)
    turns = _ordered(plain)
    return plain, turns, _traced(_chunked(turns))


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``place``, ``turns`` (role and text): the repaired conversations, in the order of ``place``.

    ``turns`` are a turn that stays, behind those inserted before it. ``rows`` has ``conv_id``, ``turn``, ``role``
    and ``text``; see ``summary`` for the rules.
    """
    plain, _, traced = _worked(rows)
    conv = F.when(F.col("known"), F.col("conv")).alias("conv_id")
    return _staying(plain, traced).select(conv, "place", "turns")


def _hashed(staying: DataFrame) -> DataFrame:
    """Digest of every repaired conversation, its turns read one after the other."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    dealt = staying.select(*_CONV, "place", line.alias("line")).repartition(*_CONV).sortWithinPartitions(*_CONV, "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest, columns = None, None, ["conv", "known", "sha256"]
        for batch in batches:
            out = []
            for conv, known, line in zip(batch["conv"], batch["known"], batch["line"], strict=True):
                if at == (conv, known):
                    digest.update(b"\n" + line.encode())
                    continue
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (conv, known), hashlib.sha256(line.encode())
            yield pd.DataFrame(out, columns=columns)
        if at:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=columns)

    return dealt.mapInPandas(run, "conv long, known boolean, sha256 string")


def summary(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cost of its repair, the edits, and a digest of the result.

    Turns go by number, those without one first, then by role and a hash of the text. The first fault of a turn
    counts: blank (no character but ASCII white space), duplicate (role and text seen earlier in the conversation),
    truncated (the last such character is none of ``. ! ?``). Kept turns are free, reroled and inserted ones cost 3,
    deleted ones 4; blank and duplicate turns are deleted, truncated ones cost 3 more unless deleted. The edits of
    least cost make the roles' initials read ``(s?(ua)+)?``; of several such the ``audit`` of initials is least in
    ASCII order. ``gaps`` is the number of turn numbers that are missing between least and largest, ``illegal`` that
    of neighbouring roles other than system-user, user-assistant and assistant-user.

    ``ids`` may name conversations of which no row is left: zeros, an empty audit and the digest of nothing. A null
    role or text is one space, a null ``conv_id`` a conversation like any other; an empty role fits nowhere. Repeated
    rows are duplicates. An empty table gives no rows; other columns are ignored.
    """
    plain, turns, traced = _worked(rows)
    spread = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = turns.groupBy(*_CONV).agg(F.coalesce(spread, F.lit(0)).alias("gaps"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    edits = traced.groupBy(*_CONV).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    found = gaps.join(edits, _CONV).join(_hashed(_staying(plain, traced)), _CONV, "left")
    if ids is not None:
        key = [F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNotNull().alias("known")]
        found = ids.select(*key).distinct().join(found, _CONV, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.when(F.col("known"), F.col("conv")).alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *counts]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", nothing).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with one in four changed, by a checksum of conversation and turn: see the cases."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(case == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")
