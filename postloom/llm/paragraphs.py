"""Repeated paragraphs by MinHash banding.

``repeats`` takes lines for paragraphs. Distinct paragraphs get a MinHash signature of their word shingles, cut into
bands tuned for a wanted recall at the threshold; paragraphs that collide in a band are verified by the
exact Jaccard similarity of their shingles, verified links give components, and all but the first
occurrence of a component are removals.

Equal paragraphs are one from the start. Bands that hold the same members as another band are compared
once, so that the shingles of a pair are sent once and not for every band it shares.

``passages`` takes pieces of whole texts, which run over line breaks and lie in lines of any length. A piece starts
where the text itself says (the least shingle hash of a window, as in winnowing; Schleimer et al., 2003), so that a
passage is cut alike wherever it stands. Pieces overlap and are told apart by their words: were pieces that are only
alike linked, neighbours within one text would be repeats of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.groups import by_run, cells, components, forest
from postloom.llm.prefixfree import bitmap
from postloom.session import cut_lineage

SEED = 20000717
#: Distinct paragraphs of a band that are compared in one piece; a cell has two pieces at most.
CHUNK = 1024
#: Shingles whose permuted hashes are held at a time.
PIECE = 1 << 13


def tune(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows of a band: the most rows (fewest false candidates) that keep the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands is None:
            break
        best = (bands, rows)
    return best


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; fewer words than the width make one shingle."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(joined, SEED)], dtype=np.uint64)
    starts, ends = _edges(words)
    return np.unique(_hashes(joined, starts[: 1 - width], ends[width - 1 :]))


def _edges(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where words that are joined by a blank start and end."""
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    return np.concatenate(([0], ends[:-1] + 1)), ends


def _hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of a text."""
    digest = xxhash.xxh3_64_digest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, count))
    odd = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, size=count, dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of the MinHash signature."""
    odd, shift = _permutations(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(31))
    for at in range(0, len(mixed), PIECE):
        permuted = mixed[at : at + PIECE, None] * odd
        permuted += shift
        least = np.minimum(least, permuted.min(axis=0))
    # the high half of the product is what the multiplication mixes, and it is what decides the least
    least ^= least >> np.uint64(32)
    raw, size = least.tobytes(), 8 * rows
    keys = [xxhash.xxh3_64_intdigest(raw[band * size : (band + 1) * size], band) for band in range(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def identity(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _place(doc_id, paragraph):
    """A number for the place of a paragraph, the same of columns and of arrays; places may share one."""
    return doc_id ^ (paragraph * 1000003) if isinstance(paragraph, np.ndarray) else doc_id.bitwiseXOR(paragraph.cast("long") * 1000003)


def _shingles_of(docs: DataFrame, wanted: DataFrame, least_words: int, width: int) -> DataFrame:
    """``cid`` and ``shingles`` of the wanted paragraphs (``doc_id``, ``paragraph``, ``cid``, ``p1``, ``p2``).

    Texts stay where they lie: a bitmap of the wanted places says which lines may be meant, and only their shingles
    go on to the join that decides.
    """
    wanted = cut_lineage(wanted, "wanted")
    place = _place(F.coalesce("doc_id", F.lit(0)), F.col("paragraph")).alias("place")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place), "place"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_numpy(), batch["text"], strict=True):
                lines = (text or "").encode().split(b"\n")
                for k in np.flatnonzero(held.value.holds(_place(doc_id, np.arange(len(lines))))).tolist():
                    words = lines[k].split()
                    if len(words) >= least_words:
                        out.append((*identity(words), shingles(words, width).view(np.int64)))
            if out:
                yield pd.DataFrame(out, columns=["p1", "p2", "shingles"])

    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("doc_id"), "text")
    # each once, should rows share an id
    found = texts.mapInPandas(run, "p1 long, p2 long, shingles array<long>").dropDuplicates(["p1", "p2"])
    return found.join(wanted.select("p1", "p2", "cid"), ["p1", "p2"]).select("cid", "shingles")


def _recur(keys: DataFrame, key: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The values of a column that stand in ``n`` rows, two or more, written; and which ones of a list may be among them.

    Values are counted by themselves. Where few recur, the bitmap behind the second spares the rest of a row the way to
    a join that decides.
    """
    counts = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    again = cut_lineage(counts.where("n > 1"), "again")
    held = keys.sparkSession.sparkContext.broadcast(bitmap(again, key))

    @F.pandas_udf("array<boolean>")
    def may(lists: pd.Series) -> pd.Series:
        return lists.map(lambda values: held.value.holds(values))

    return again, may


def _verify(threshold: float):
    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        run = run.drop_duplicates("cid")
        ids, sets = run["cid"].to_numpy(), [np.asarray(s) for s in run["shingles"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(ids)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            mine = np.sort(sets[i])
            low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            spans = [owner[a:b] for a, b in zip(low, high, strict=True)]
            common = np.bincount(np.concatenate(spans), minlength=len(ids))[rest]
            return common + 1e-9 >= threshold * (sizes[i] + sizes[rest] - common)

        heads, tails = forest(len(ids), near)
        return pd.DataFrame({"a": ids[heads], "b": ids[tails]}) if len(heads) else None

    return work


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are the first least one of some ``window`` neighbouring hashes."""
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    at, size = np.arange(len(hashes)), 1
    while size < window:
        # the least of a window is that of its first and its last part, which may overlap
        step = min(size, window - size)
        less = hashes[step:] < hashes[:-step]
        at = np.where(less, at[step:], at[:-step])
        hashes = np.where(less, hashes[step:], hashes[:-step])
        size += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


@dataclass(frozen=True)
class Lines:
    """Which lines are sketched, and how."""

    least_words: int
    bands: int
    rows: int


@dataclass(frozen=True)
class Pieces:
    """Least words of a passage, and words of a piece."""

    least: int
    length: int


def sketch(text: str | None, width: int, lines: Lines | None, pieces: Pieces | None) -> tuple[list[tuple], list[np.ndarray]]:
    """The long lines of a text (number, words, identity, band keys) and its pieces, from one run over its shingles.

    Pieces are arrays: line and number of the first word, and the identity in two longs.
    """
    cut = [line.split() for line in (text or "").encode().split(b"\n")]
    counts = [len(words) for words in cut]
    wanted = [k for k, n in enumerate(counts) if n >= lines.least_words] if lines is not None else []
    whole = pieces is not None and sum(counts) >= pieces.least
    none = np.empty(0, dtype=np.int64)
    if not wanted and not whole:
        return [], [none, none, none, none]
    words = [w for line in cut for w in line]
    joined, (starts, ends), last = b" ".join(words), _edges(words), np.cumsum(counts)
    hashes = _hashes(joined, starts[: max(0, len(words) - width + 1)], ends[width - 1 :])
    digest = xxhash.xxh3_128_digest

    found = []
    for k in wanted:
        b, n = int(last[k]), counts[k]
        line = joined[starts[b - n] : ends[b - 1]]
        # the shingles that lie in the line; what is repeated among them does not matter to the least
        inside = hashes[b - n : b - width + 1] if n > width else shingles(cut[k], width)
        found.append((k, n, *np.frombuffer(digest(line), dtype="<i8").tolist(), band_keys(inside, lines.bands, lines.rows)))

    at, same = none, none.reshape(0, 2)
    if whole:
        # every window that lies with its pieces in a passage of the least size gives one
        at = anchors(hashes[: len(words) - pieces.length + 1], pieces.least - pieces.length + 1)
        spans = zip(starts[at].tolist(), ends[at + pieces.length - 1].tolist(), strict=True)
        same = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), dtype="<i8").reshape(-1, 2)
    return found, [np.searchsorted(last, at, side="right"), at, same[:, 0], same[:, 1]]


_LINE = "paragraph: int, n_words: int, p1: long, p2: long, bands: array<long>"
_PIECE = "paragraph: int, word: int, p1: long, p2: long"


def _lists(counts: list[int], columns: dict[str, pa.Array]) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns))
    )


def _sketches(docs: DataFrame, width: int, lines: Lines | None, pieces: Pieces | None) -> DataFrame:
    """``doc_id``, ``lines`` and ``pieces`` of every text that has any, written: texts are read once for both."""
    bands = lines.bands if lines is not None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [sketch(t, width, lines, pieces) for t in part.column("text").to_pylist()]
                held = [k for k, (of_lines, of_pieces) in enumerate(found) if of_lines or len(of_pieces[0])]
                if not held:
                    continue
                found = [found[k] for k in held]
                rows = [row for of_lines, _ in found for row in of_lines]
                number, words, p1, p2, keys = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                flat = pa.array(np.concatenate(keys) if keys else [], pa.int64())
                edges = pa.array(np.arange(len(keys) + 1) * bands, pa.int32())
                first, word, same, same2 = (np.concatenate(c) for c in zip(*(of_pieces for _, of_pieces in found), strict=True))
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(pa.array(held)),
                    "lines": _lists([len(of_lines) for of_lines, _ in found], {
                        "paragraph": pa.array(number, pa.int32()), "n_words": pa.array(words, pa.int32()),
                        "p1": pa.array(p1, pa.int64()), "p2": pa.array(p2, pa.int64()),
                        "bands": pa.ListArray.from_arrays(edges, flat),
                    }),
                    "pieces": _lists([len(of_pieces[0]) for _, of_pieces in found], {
                        "paragraph": pa.array(first, pa.int32()), "word": pa.array(word, pa.int32()),
                        "p1": pa.array(same, pa.int64()), "p2": pa.array(same2, pa.int64()),
                    }),
                })

    schema = f"doc_id long, lines array<struct<{_LINE}>>, pieces array<struct<{_PIECE}>>"
    return cut_lineage(docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema), "sketches")


def passages(docs: DataFrame, least: int = 50, length: int = 40, width: int = 5) -> DataFrame:
    """Every occurrence of a piece of ``length`` words that has another occurrence, in whole texts.

    Every passage of ``least`` words or more that stands in two places has one of its pieces reported in both,
    however it is broken into lines; a longer one has pieces, which overlap, from its first to its last ten words
    (``least`` - ``length``). Columns are those of ``repeats`` with ``word`` and ``first_word``, the numbers of the
    first word in the text, from 0; ``paragraph`` is the line of that word. Words are parted by ASCII blanks. Null
    and empty texts have no pieces; repeated rows and repeats within a document count as occurrences; a null
    ``doc_id`` comes last in the order. An empty table gives no rows; other columns are ignored.
    """
    return _recurring(_sketches(docs, width, None, Pieces(least, length)), length)


def _recurring(sketches: DataFrame, length: int) -> DataFrame:
    # half of the identity finds what may recur, so that little goes on to be told apart by the whole of it
    _, may = _recur(sketches.select(F.explode("pieces.p1").alias("p1")), "p1")
    marked = sketches.select("doc_id", "pieces", may(F.col("pieces.p1")).alias("may"))
    met = cut_lineage(marked.select("doc_id", F.inline(F.filter("pieces", lambda _, k: F.get("may", k)))), "met")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "word", "paragraph")
    groups = met.groupBy("p1", "p2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_occurrences"))
    return met.join(groups.where("n_occurrences > 1"), ["p1", "p2"]).select(
        "doc_id",
        "paragraph",
        "word",
        F.lit(length).alias("n_words"),
        "n_occurrences",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.paragraph").alias("first_paragraph"),
        F.col("first.word").alias("first_word"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.word") == F.col("word"))).alias("kept"),
    )


def _banded(nodes: DataFrame) -> DataFrame:
    """``bucket`` and ``cid`` of the bands that two nodes or more share, written."""
    again, may = _recur(nodes.select(F.explode("bands").alias("bucket")), "bucket")
    marked = nodes.select("cid", "bands", may("bands").alias("may"))
    banded = marked.select("cid", F.explode(F.filter("bands", lambda _, k: F.get("may", k))).alias("bucket"))
    return cut_lineage(banded.join(again, "bucket", "left_semi"), "banded")


def alike(
    nodes: DataFrame, shingled: Callable[[DataFrame], DataFrame], threshold: float, chunk: int | None = None
) -> DataFrame:
    """``node`` and ``root`` of the nodes (``cid``, ``bands``) that links of Jaccard ``threshold`` or more reach.

    ``shingled`` gets the ``cid`` of the nodes that meet in a band, and returns them with their ``shingles``.
    """
    return components(linked(_banded(nodes), shingled, threshold, chunk))


def linked(
    banded: DataFrame, shingled: Callable[[DataFrame], DataFrame], threshold: float, chunk: int | None = None
) -> DataFrame:
    """Links (``a``, ``b``) that connect what links of Jaccard ``threshold`` or more in buckets (``bucket``, ``cid``: written) do."""
    sizes = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("cid")).alias("mark"),
        F.bit_xor(F.xxhash64("cid", F.lit("again"))).alias("mark2"),
    )
    once = sizes.groupBy("members", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
    dealt = cells(banded.join(once.select("bucket"), "bucket"), ["bucket"], F.col("cid"), chunk or CHUNK)
    met = cut_lineage(dealt, "bands")
    runs = met.select("bucket", "cell_a", "cell_b", "cid").join(shingled(met.select("cid").distinct()), "cid")
    return by_run(runs, ["bucket", "cell_a", "cell_b"], _verify(threshold), "a long, b long")


def repeats(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 40, recall: float = 0.999
) -> DataFrame:
    """Every occurrence of a paragraph that has another occurrence like it.

    Columns: ``doc_id``, ``paragraph`` (number of the line, from 0), ``n_words``, ``n_occurrences`` of its
    component (the paragraphs that links of Jaccard ``threshold`` or more on shingles of ``width`` words
    reach), ``first_doc_id`` and ``first_paragraph`` (the first occurrence, which names the component),
    ``kept`` (true for that one only).

    Words are parted by ASCII blanks; paragraphs of fewer than ``least_words`` words are left to line
    dedup, so clean documents have no row. Null and empty texts have no paragraphs; repeated rows and
    repeats within a document count as occurrences; a null ``doc_id`` comes last in the order. An empty
    table gives no rows; other columns are ignored.
    """
    lines = Lines(least_words, *tune(threshold, recall))
    return _linked(docs, _sketches(docs, width, lines, None), threshold, width, least_words)


def repeats_and_passages(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 40, recall: float = 0.999, least: int = 50, length: int = 40
) -> tuple[DataFrame, DataFrame]:
    """``repeats`` and ``passages`` of the same texts, which are read and hashed once for both."""
    sketches = _sketches(docs, width, Lines(least_words, *tune(threshold, recall)), Pieces(least, length))
    return _linked(docs, sketches, threshold, width, least_words), _recurring(sketches, length)


def _linked(docs: DataFrame, sketches: DataFrame, threshold: float, width: int, least_words: int) -> DataFrame:
    seen = sketches.select("doc_id", F.inline("lines"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "paragraph")
    classes = seen.groupBy("p1", "p2").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")
    )
    nodes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def shingled(met: DataFrame) -> DataFrame:
        wanted = nodes.join(met, "cid", "left_semi").select("first.doc_id", "first.paragraph", "cid", "p1", "p2")
        return _shingles_of(docs, wanted, least_words, width)

    roots = alike(nodes, shingled, threshold)

    known = nodes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid")
    )
    groups = known.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n_occurrences"))
    named = known.select("p1", "p2", "root").join(groups.where("n_occurrences > 1"), "root")
    return seen.drop("bands").join(named, ["p1", "p2"]).select(
        "doc_id",
        "paragraph",
        "n_words",
        "n_occurrences",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.paragraph").alias("first_paragraph"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.paragraph") == F.col("paragraph"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the paragraphs of ``found`` that are not kept cut out of ``text``; ``doc_id`` must be unique."""
    gone = found.where("NOT kept").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("paragraph").alias("_gone"))
    lines = F.split("text", "\n")
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.transform(F.array_except(numbers, "_gone"), lambda i: F.element_at(lines, i + 1))
    cut = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left").withColumn("text", cut).select(*docs.columns)
