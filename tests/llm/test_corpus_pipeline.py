import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import test_mixing
import test_templates
import tiktoken
from pyspark.sql import functions as F

from postloom.llm import mixing, piecebpe, supervision
from postloom.session import cut_lineage

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    stock = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}ord" for i in range(400)]
    rows = []
    for i in range(150):
        body = [" ".join(rng.choice(stock) for _ in range(rng.randrange(8, 30))) + "." for _ in range(rng.randrange(4, 9))]
        body.insert(rng.randrange(3), f"Copyright {1990 + i % 30} all rights reserved here.")
        rows.append((i, "\n".join(body)))
    rows += [(200 + i, rows[i % 5][1]) for i in range(20)]
    rows += [(300 + i, rows[7][1].replace("word", "wird", i % 2)) for i in range(6)]
    rows += [(400 + i, " ".join("%%%" + rng.choice(stock) for _ in range(80))) for i in range(8)]
    rows += [(410, None), (411, ""), (412, "too short"), (413, "again and again " * 60)]
    return rows


def one_of_each(rows):
    """The first document of each group that links of Jaccard 0.8 on five-word shingles reach, by comparing all pairs."""
    grams = []
    for _, text in rows:
        words = (text or "").lower().split()
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(grams):
        for j in range(i):
            if 10 * len(one & grams[j]) >= 8 * len(one | grams[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [rows[i] for i in range(len(rows)) if top(i) == i]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 10 != 3), 0) for i, _ in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, given, held = docs.columns, rows, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "tokens":
            break
        assert docs.columns == columns
        held.append(name)
        found = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality":
            kept = {r.doc_id for r in supervision.label(before).where("kept").collect()}
            assert sorted(found) == sorted((i, t) for i, t in given if i in kept)
            assert kept.isdisjoint(range(400, 414)) and len(kept) >= 170
        elif name == "lines":
            assert sorted(found, key=str) == test_templates.slow(sorted(given), least=5)
            assert sum("Copyright" in t for _, t in found) < 20
        elif name == "near_copies":
            assert sorted(found) == one_of_each(sorted(given))
            assert len(found) < len(given) - 15
        elif name == "mixture":
            known = {i: "junk" if q == 0 else "clean" for i, q, _ in labels if i in dict(given)}
            expected, _ = test_mixing.slow_posteriors(given, known, sorted(corpus_pipeline.WEIGHTS))
            rates = mixing.mix(before, mixing.domain_of(spark.read.parquet(f"{tmp_path}/labels.parquet")), corpus_pipeline.WEIGHTS, "clean", corpus_pipeline.ONCE)
            copies = {}
            for r in rates.collect():
                assert [r.p_clean, r.p_junk, r.p_toxic] == pytest.approx(expected[r.doc_id], abs=1e-9)
                copies[r.doc_id] = r.copies
            assert set(copies.values()) <= {0, 1}
            assert sorted(found) == sorted((i, t) for i, t in given if copies[i])
        given = found

    ranks = piecebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in given:
        ids = theirs.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert held == ["quality", "lines", "near_copies", "mixture"]
    assert sorted(map(tuple, docs.collect())) == sorted(expected)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(expected)


def test_extra_columns_stay(spark, tmp_path):
    """All stages but the last return the columns that they get, whatever their names; null ids and texts pass or go."""
    names = ["row", "id", "key", "_copies", "_dropped", "_text_key", "doc", "facts"]
    rows = [(i, t, *range(len(names))) for i, t in corpus()] + [(None, corpus()[3][1] + " and more words of its own here", *range(len(names)))]
    full = spark.createDataFrame(rows, ["doc_id", "text", *names]).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, full, str(tmp_path))
        assert out.columns == full.columns, name
        full = cut_lineage(out, name)
        assert full.select(*names).distinct().collect() == [tuple(range(len(names)))]
    assert full.count() > 100 and full.where("doc_id IS NULL").count() <= 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
