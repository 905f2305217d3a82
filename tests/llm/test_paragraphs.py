import itertools
import random
import re

import numpy as np
import pytest

from postloom.llm import paragraphs


def slow(rows, least_words=8, width=5, threshold=0.8):
    found = []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(words) >= least_words:
                found.append((doc, n, words))
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for _, _, w in found]
    group = list(range(len(found)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(found)), 2):
        if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            group[root(i)] = root(j)
    out = []
    for i, (doc, n, words) in enumerate(found):
        mates = [j for j in range(len(found)) if root(j) == root(i)]
        first = min(((found[j][0] is None, found[j][0] or 0, found[j][1]) for j in mates))
        first = (None if first[0] else first[1], first[2])
        if len(mates) > 1:
            out.append((doc, n, len(words), len(mates), *first, first == (doc, n)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_equals_brute_force(docs, monkeypatch, chunk):
    monkeypatch.setattr(paragraphs, "CHUNK", chunk)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["é", "日本"]
    base = [[rng.choice(words) for _ in range(rng.choice([8, 30, 60]))] for _ in range(12)]
    lines = []
    for b in base:
        for _ in range(rng.choice([1, 3, 9])):
            w = list(b)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 2)]
    rows += [(900, None), (901, ""), (902, "\n\n \t"), (903, "short line"), (None, lines[0]), (None, lines[1] + "\n" + lines[1])]
    rows += [(904, rows[0][1]), (904, rows[0][1]), (905, " ".join(rng.choice(words) for _ in range(40_000)))]
    got = paragraphs.repeats(docs(rows), least_words=8)
    assert got.columns == ["doc_id", "paragraph", "n_words", "n_occurrences", "first_doc_id", "first_paragraph", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)
    cut = paragraphs.without_repeats(docs([r for r in rows if r[0] not in (None, 904)]), paragraphs.repeats(docs([r for r in rows if r[0] not in (None, 904)]), least_words=8))
    left = [(r.doc_id, r.text) for r in cut.collect()]
    assert slow(left) == []


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng = np.random.default_rng(3)
    met = []
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, size=100, dtype=np.uint64)
        a, b = paragraphs.band_keys(pool[:90], bands, rows), paragraphs.band_keys(pool[10:], bands, rows)
        met.append(bool((a == b).any()))
    assert np.mean(met) > 0.985


def test_empty_table(docs):
    assert paragraphs.repeats(docs([])).collect() == []


def test_passages_are_found_wherever_lines_break(docs):
    rng = random.Random(13)
    stock = [f"v{i}" for i in range(2000)]

    def prose(n):
        return [rng.choice(stock) for _ in range(n)]

    def wrapped(words, size):
        return "\n".join(" ".join(words[i : i + size]) for i in range(0, len(words), size))

    texts = {}
    for k in range(25):
        passage = prose(50 + k)
        texts[4 * k] = wrapped([*prose(30), *passage, *prose(9)], 7)
        texts[4 * k + 1] = " ".join(prose(200)) + " " + " ".join(passage) + " " + " ".join(prose(300))
        texts[4 * k + 2] = " ".join([*prose(45), *passage[:20]]) + "\n\n" + " ".join([*passage[20:], *prose(60)])
        texts[4 * k + 3] = wrapped(prose(300), 50)
    rows = [*texts.items(), (900, None), (901, ""), (902, "\n"), (903, "too short"), (None, texts[0]), (904, "again " * 300)]
    found = paragraphs.passages(docs(rows)).collect()
    told = {(r.doc_id, r.word) for r in found}
    words = {i: (t or "").split() for i, t in rows}
    seen = {}
    for i, w in words.items():
        for at in range(len(w) - 49):
            seen.setdefault(tuple(w[at : at + 50]), []).append((i, at))
    shared = [p for places in seen.values() if len(places) > 1 for p in places]
    assert len({i for i, _ in shared}) == 77
    assert all(any((i, at + d) in told for d in range(11)) for i, at in shared)
    assert not {i for i, _ in told} & {4 * k + 3 for k in range(25)}
    for r in found:
        assert words[r.doc_id][r.word : r.word + 40] == words[r.first_doc_id][r.first_word : r.first_word + 40]
        assert r.kept == ((r.doc_id, r.word) == (r.first_doc_id, r.first_word)) and r.n_words == 40 and r.n_occurrences > 1
        line = dict(rows)[r.doc_id].split("\n")
        assert sum(len(x.split()) for x in line[: r.paragraph]) <= r.word < sum(len(x.split()) for x in line[: r.paragraph + 1])
    assert paragraphs.passages(docs([])).collect() == []


def test_texts_are_hashed_once_for_lines_and_passages(docs, monkeypatch):
    rng = random.Random(12)
    line = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(60)) for _ in range(4)]
    rows = [(1, f"{line[0]}\n{line[1]}"), (2, f"short\n{line[0]}\n{line[2]}"), (3, line[3]), (3, line[3]), (None, None), (5, "")]
    apart = [sorted(map(str, f(docs(rows)).collect())) for f in (paragraphs.repeats, paragraphs.passages)]
    read, cut = [], paragraphs.cut_lineage

    def noted(df, name="rows"):
        text = df._jdf.queryExecution().analyzed().toString()
        read.extend([name] if "MapInArrow" in text else [])
        return cut(df, name)

    monkeypatch.setattr(paragraphs, "cut_lineage", noted)
    found = paragraphs.repeats_and_passages(docs(rows))
    assert [sorted(map(str, f.collect())) for f in found] == apart
    assert len(apart[0]) == 4 and len(apart[1]) > 4
    assert read == ["sketches"]


def test_anchors_are_the_first_least_of_some_window():
    rng = np.random.default_rng(4)
    for size, window in itertools.product((0, 1, 5, 11, 12, 40, 300), (1, 2, 3, 8, 11)):
        hashes = rng.integers(0, 20, size, dtype=np.uint64)
        expected = {at + int(hashes[at : at + window].argmin()) for at in range(size - window + 1)}
        assert paragraphs.anchors(hashes, window).tolist() == sorted(expected)


def test_only_what_may_recur_is_sent(docs, monkeypatch):
    rng = random.Random(17)
    prose = [[rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(60)] for _ in range(200)]
    near = [[*words[:-1], "other"] for words in prose[:5]]
    rows = [*enumerate(" ".join(words) for words in [*prose, *near]), (None, " ".join(prose[0])), (7, " ".join(prose[7])), (7, None)]
    written, plans, cut = {}, {}, paragraphs.cut_lineage

    def noted(df, name="rows"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        written[name] = cut(df, name)
        return written[name]

    monkeypatch.setattr(paragraphs, "cut_lineage", noted)
    monkeypatch.setattr(paragraphs, "components", lambda edges, found=paragraphs.components: found(noted(edges, "links")))
    whole, pieces = (f.collect() for f in paragraphs.repeats_and_passages(docs(rows)))
    assert {(r.doc_id, r.n_occurrences) for r in whole} == {(0, 3), (200, 3), (None, 3), (7, 2), *((d, 2) for k in range(1, 5) for d in (k, 200 + k))}
    assert {r.doc_id for r in pieces} == {None, 7, *range(5), *range(200, 205)}
    # all that goes to the joins: bands that two nodes share, pieces that recur but for few, the ten lines that met
    bands, _ = paragraphs.tune(0.8, 0.999)
    assert 0 < written["banded"].count() <= 10 * bands
    assert len(pieces) <= written["met"].count() <= len(pieces) + 200
    assert written["wanted"].count() == 10
    # texts are read where they lie
    at = max(k for k, line in enumerate(plans["links"]) if "MapInPandas" in line and "shingles" in line)
    depth = plans["links"][at].index("MapIn")
    below = list(itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-")) > depth, plans["links"][at + 1 :]))
    assert below and not any("Join" in line for line in below)
