import hashlib
import random
import zlib

import pytest

from postloom.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string, conv int, known string, place int, h1 string, codes int, kept int"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least cost, then least audit, over all edits, state by state from the first turn; rows are (role, text, fault)."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for x in "ua":
                    if to := NEXT.get((state, x)):
                        best[to] = min(best.get(to, (1 << 30, "", ())), (cost + 3, audit + "I", (*out, (ROLES[x], ""))))
        return best

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, out) in insert(best).items():
            ways = [(state, cost + 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                ways += [(NEXT.get((state, role[:1])), cost + late, "K", ((role, text),))]
                ways += [(NEXT.get((state, x)), cost + 3 + late, "R", ((ROLES[x], text),)) for x in "ua"]
            for to, c, letter, more in ways:
                if to is not None:
                    after[to] = min(after.get(to, (1 << 30, "", ())), (c, audit + letter, out + more))
        best = after
    ends = insert(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def slow(rows, ids=()):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in own:
            said = text.rstrip(BLANKS)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, kept = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def corpus(convs=120, seed=6):
    rng = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "u", "", None, "User"]
    texts = ["fine.", "so? ", "no end", "", " \n\t", None, "\xa0", "ok!\r\n", "a\x0b", "Ü.", "x" * 3000]
    rows = []
    for c in range(convs):
        n = rng.choice([1, 2, 3, 5, 9, 30])
        if c % 2:  # nearly right
            turns = [(t, ["user", "assistant"][t % 2], f"{c} says {t}.") for t in range(n)]
            turns = [(t, rng.choice(roles), x) if rng.random() < 0.2 else (t, r, x) for t, r, x in turns if rng.random() > 0.1]
        else:
            turns = [(t, rng.choice(roles), rng.choice(texts)) for t in range(n)]
        if c % 5 == 0:
            turns = [(-4, "system", "be kind.")] + turns
        rows += [(c, None if c % 11 == 0 and t == 1 else 3 * t, r, x) for t, r, x in turns]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "h", 3, 4) for r in rows], COLUMNS)


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = {r[0]: tuple(r[1:]) for r in df.collect()}
    return out


@pytest.mark.parametrize("chunk", [10, 2, 0])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = corpus() + [(None, t, "user", f"q {t}") for t in range(12)]
    assert found(repair.summary(frame(spark, rows).repartition(5))) == slow(rows)


def test_long_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 4)
    rng = random.Random(8)
    # spans of one role, of a role that fits nowhere and of copies keep vectors apart for long
    rows, t = [], 0
    for kind in ["user", "tool", "assistant", "mix", "user", "copy", "tool", "mix"]:
        for _ in range(rng.randrange(90, 140)):
            role = rng.choice(["user", "assistant"]) if kind == "mix" else "user" if kind == "copy" else kind
            rows.append((1, t, role, "same." if kind == "copy" else f"turn {t}."))
            t += 1
    rows += [(2, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(300)]
    assert found(repair.summary(frame(spark, rows).repartition(7))) == slow(rows)


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 1)
    rows = [(1, 0, "user", "q."), (1, 1, "user", "again?"), (1, 2, "assistant", "a."), (1, 3, "assistant", "a."), (1, 4, "user", "last.")]
    made = sorted(repair.repaired(frame(spark, rows)).collect(), key=lambda r: r.place)
    turns = [tuple(t) for r in made for t in r.turns]
    assert "\n".join(f"{r}:{x}" for r, x in turns) == "user:q.\nassistant:again?\nassistant:a." or len(turns) % 2 == 0
    assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest() == slow(rows)[1][-1]


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c} {t}?") for c in range(40) for t in range(5)] + [(None, None, None, None), (7, None, "user", "x")]
    expected = []
    for c, t, r, x in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if case == 1 else x.replace(".", "").replace("!", "").replace("?", "") if case == 2 else x
        expected += [(c, t, "user" if case == 4 else r, x)] * (0 if case == 0 else 2 if case == 3 else 1)
    changed = repair.damaged(frame(spark, rows))
    assert sorted(map(tuple, changed.collect()), key=str) == sorted(expected, key=str)
    assert found(repair.summary(changed, frame(spark, rows))) == slow(expected, {r[0] for r in rows})


def test_fix_up_passes(spark):
    """Chunks of one conversation, joined by hand, equal one run over all of it."""
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 8, 17]) for _ in range(rng.randrange(1, 60)))
        cut = rng.randrange(len(codes) + 1)
        whole = repair.backward(codes, repair.END)
        form, cost = repair.backward(codes[cut:], repair.END)
        known = (repair.END, *repair.backward(codes[:cut], repair.END))
        first, more = repair.rerun(codes[:cut], form, known)
        assert (first, cost + more) == whole == (repair.backward(codes[:cut], form)[0], cost + repair.backward(codes[:cut], form)[1])
    assert len(repair.FORMS) < 64


def test_passes_are_few(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 3)
    rows = frame(spark, [(1, t, "user", f"{t}.") for t in range(999)])
    chunks = repair._chunked(repair._ordered(repair._plain(rows)))
    runs, passes = repair._fixed_up(chunks, repair._speculated(chunks))
    assert chunks.count() > 100 and passes <= len(repair.FORMS)


def test_empty(spark):
    assert repair.summary(frame(spark, [])).collect() == []
    assert repair.repaired(frame(spark, [])).collect() == []
    only = repair.summary(frame(spark, []), frame(spark, [(5, 0, "user", "x"), (None, 1, "user", "y")]))
    assert found(only) == slow([], {5, None})
