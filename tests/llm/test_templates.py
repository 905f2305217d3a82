import random
import re
from collections import Counter, defaultdict

import oracle

from postloom.llm import templates


def slow(rows, least=5, depth=3, constant=0.5, least_tokens=1, share=10):
    lines = []
    for row, (doc, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            tokens = [templates.ANY if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09\x0B-\x0D]+", line)]
            if len(tokens) >= least_tokens:
                lines.append((row, n, (len(tokens), *tokens[:depth]), tokens))
    seen = Counter((leaf, i, t) for _, _, leaf, tokens in lines for i, t in enumerate(tokens) if t != templates.ANY)
    sizes = Counter(leaf for _, _, leaf, _ in lines)
    groups = defaultdict(set)
    for row, n, leaf, tokens in lines:
        for floor in (0, share * sizes[leaf]):
            fields = tuple(t if seen[leaf, i, t] >= least and 100 * seen[leaf, i, t] >= floor else templates.ANY for i, t in enumerate(tokens))
            if sum(f != templates.ANY for f in fields) >= constant * len(fields):
                groups[leaf, fields].add((row, n))
    gone = defaultdict(set)
    for members in groups.values():
        if len({rows[r][1] for r, _ in members}) >= least:
            first = min((rows[r][0] is None, rows[r][0] or 0, n) for r, n in members)
            for r, n in members:
                if (rows[r][0] is None, rows[r][0] or 0, n) != first:
                    gone[r].add(n)
    out = []
    for row, (doc, text) in enumerate(rows):
        left = None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone[row])
        out.append((doc, left))
    return sorted(out, key=str)


def test_equals_brute_force(docs):
    rng = random.Random(11)
    names = ["Ann", "Bob", "Cy", "Dee", "Eve", "Flo", "Gus", "Hal", "Ida"]
    rows = []
    for i in range(60):
        lines = [
            f"Copyright {1990 + i} by {rng.choice(names)}{chr(97 + i % 26)}{chr(97 + i // 26)} all rights reserved",
            "Share this page with friends",
            " ".join(rng.choice(names) for _ in range(rng.randrange(1, 9))),
            f"Posted at {i}:00\tby the  author",
            "one two", "", f"unique line é {chr(97 + i % 26)} {chr(97 + i // 26)} x y z",
        ]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines[: rng.randrange(1, 8)])))
    rows += [(500 + i, rows[3][1]) for i in range(9)]
    rows += [(600, None), (601, ""), (602, " \n\t\n"), (None, rows[5][1]), (603, "Share this page with friends")]
    rows += [(3, "Share this page with friends\nother text of the same id")]
    rows += [(604, " ".join(rng.choice(names) for _ in range(30_000)))]
    got = templates.drop_lines(docs(rows))
    assert got.columns == docs([]).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == slow(rows)


def test_copies_alone_are_no_boilerplate(docs):
    rows = [(i, "the same text in all copies\nand a second line of it") for i in range(50)]
    assert {r.text for r in templates.drop_lines(docs(rows)).collect()} == {rows[0][1]}


def test_empty_table(docs):
    assert templates.drop_lines(docs([])).collect() == []


def test_query_equals_sql(spark, folder):
    assert oracle.difference(spark, oracle.connect(folder), "op6_log_templates", folder) is None


def test_boilerplate_goes_alike_however_often_it_stands(docs):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    left = {}
    for n in (100, 1000, 10_000):
        rng = random.Random(n)
        rows = [(i, f"This page was posted by {rng.choice(names)} in p{rng.choice(names)[:2]} near t{rng.choice(names)[0]}\ntext {names[i % 200]}{names[i // 200]}") for i in range(n)]
        kept = templates.drop_lines(docs(rows)).collect()
        left[n] = sum("posted" in r.text for r in kept)
    assert all(1 <= n <= 4 for n in left.values())


def test_a_rarer_line_of_a_large_leaf_goes_too(docs):
    rng = random.Random(2)
    rest = "all rights of this work stay with those who made it and lent it to us".split()
    rows = [(i, "Now and then " + " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{i % 7 * 'x'}" for _ in rest)) for i in range(900)]
    rows += [(1000 + i, "Now and then " + " ".join(rest) + f"\n{chr(97 + i)} tail") for i in range(20)]
    kept = templates.drop_lines(docs(rows)).collect()
    assert sum("all rights" in r.text for r in kept) == 1


def test_short_lines_go_too(docs):
    rows = [(i, f"Read more\nHome\n{i}\n{chr(97 + i // 26)}{chr(97 + i % 26)} own") for i in range(50)]
    kept = {r.doc_id: r.text.split("\n") for r in templates.drop_lines(docs(rows)).collect()}
    assert [i for i, t in kept.items() if "Read more" in t] == [i for i, t in kept.items() if "Home" in t] == [0]
    # a number alone is no template
    assert all(str(i) in t for i, t in kept.items())


def test_columns_of_any_name_are_carried(spark):
    names = ["_dropped", "dropped", "row", "id", "key", "_id", "_key", "line", "leaf"]
    rows = [(i, f"The same line here\nown {chr(97 + i)}", *range(len(names))) for i in range(8)] + [(None, None, *range(len(names)))]
    given = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = templates.drop_lines(given)
    assert out.columns == given.columns
    kept = sorted(map(tuple, out.collect()), key=str)
    assert [k[2:] for k in kept] == [tuple(range(len(names)))] * 9 and sum("same" in (k[1] or "") for k in kept) == 1
