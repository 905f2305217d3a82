import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.llm import chatwindows
from postloom.llm.chatwindows import Settings

COLUMNS = "conv_id long, turn long, role string, text string, block int, span string, known string, p int, piece string, loss int"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\s>", "<", "[", "\\", "s>", "/", " ", "\n", "word", "ünï", "😀", "ok"]


def corpus():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice(PARTS) for _ in range(n))
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, -1, "system", say(rng.randrange(12))))
        rows += [(c, t, ["user", "assistant"][t % 2], say(rng.randrange(30))) for t in range(rng.randrange(1, 14))]
    rows += [(50, t, ["user", "assistant"][t % 2], say(rng.randrange(9))) for t in range(90)] + [(50, -40, "system", "be kind")]
    rows += [(51, 0, "user", "q"), (51, 1, "assistant", "word " * 500), (51, 2, "user", "w " * 60), (51, 3, "assistant", "end")]
    rows += [(52, None, None, None), (52, None, "assistant", None), (52, 3, "assistant", "x"), (52, 3, "assistant", "x"), (52, 3, "assistant", "x")]
    rows += [(None, t, "[/INST]", "</s>[INST] ok [/INST]") for t in range(20)] + [(53, 0, "system", ""), (54, 1, "user", "system")]
    rows += [(55, 16 * k, "system" if not k else "assistant", f"far {k}") for k in range(5)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "k", 2, "p", 3) for r in rows], COLUMNS)


def slow(rows):
    out, key = {}, lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        targets = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(targets), hashlib.sha256(targets.encode()).hexdigest())
    return out


def tokens(text):
    return len(re.findall(chatwindows.TOKEN, text)) + chatwindows.MARKS


@pytest.mark.parametrize("settings", [Settings(), Settings(120, 40, 3, 16), Settings(10, 0, 1, 4)])
def test_round_trip(spark, settings):
    rows = corpus()
    found = chatwindows.digests(frame(spark, rows).repartition(7), settings).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == slow(rows)
    assert len(found) == len(slow(rows))


def test_windows(spark):
    settings, rows = Settings(120, 40, 3, 16), corpus()
    made = chatwindows.windows(frame(spark, rows), settings)
    assert made.columns == ["conv_id", "block", "span", "n_carried", "formatted", "loss"]
    read = made.select(
        "conv_id", "block", "span", "n_carried", chatwindows.turns_of(F.col("formatted"), F.lit(0)).alias("turns"),
        chatwindows.targets_of(F.col("formatted"), F.col("loss")).alias("targets"), "formatted",
    )
    held = {}
    for w in sorted(read.collect(), key=lambda r: (str(r.conv_id), r.block, r.span)):
        turns, n = [tuple(t) for t in w.turns], w.n_carried
        assert w.formatted.count("<s>") == w.formatted.count("</s>") == w.formatted.count("[INST]") == len(turns)
        assert w.targets == [t for role, t in turns[n:] if role == "assistant"]
        before = held.setdefault(w.conv_id, [])
        system = before[:1] if before and before[0][0] == "system" else []
        assert turns[: len(system)] == system
        history = turns[len(system) : n]
        assert history == before[len(before) - len(history) :] and len(before) >= len(system) + len(history)
        assert sum(tokens(t) for _, t in history) <= 40
        new = [tokens(t) for _, t in turns[n:]]
        assert new and (len(new) == 1 or sum(tokens(t) for _, t in turns) <= 120)
        before += turns[n:]
    # without block ends, a window takes all the history it may
    assert any(len(x) > 60 for x in held.values())


def test_history_is_as_long_as_may_be(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "a b") for t in range(40)]
    made = chatwindows.windows(frame(spark, rows), Settings(100, 40, 8, 16)).orderBy("block", "span").collect()
    assert [w.n_carried for w in made][:2] == [0, 3] and {w.n_carried for w in made[2:]} == {4}


def test_one_exchange_of_texts(spark, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/c")
    made = chatwindows.windows(spark.read.parquet(f"{tmp_path}/c"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(conv") <= 4 and "Python" not in plan and "Arrow" not in plan


def test_empty_and_control(spark):
    assert chatwindows.digests(frame(spark, [])).collect() == []
    assert chatwindows.windows(frame(spark, [])).collect() == []
    only = chatwindows.digests(chatwindows.with_control_strings(frame(spark, []))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in only] == [(-7, 2, 21)]
