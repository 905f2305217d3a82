"""Collocations by a multikey quicksort of suffix pointers.

Every word of a text starts a suffix of at most four words, which ends with its piece. Suffixes are routed
to buckets by their leading words and each bucket sorts pointers to its suffixes by multikey three-way
quicksort (Bentley and Sedgewick, 1997): the pointers that equal a pivot at every word so far are all
occurrences of one phrase, so the size of an equal partition is a count, and a partition too small to hold a
frequent phrase is abandoned unsorted.

What keeps buckets even and small:

* suffixes end before a word that is itself infrequent, as no frequent phrase holds one;
* equal suffixes of a slice of texts are one row with a count, so a passage that a third of all texts
  share costs one row a slice;
* suffixes that begin with two very common words are routed by three words, or four where the third is
  common as well; the counts of their beginnings then come from several buckets and are added up;
* the number of buckets follows the number of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.prefixfree import Bitmap, bitmap
from postloom.session import cut_lineage

#: Words of the longest phrase.
DEPTH = 4
BETWEEN_WORDS, BETWEEN_PIECES = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text hashed in one piece, and words whose suffixes are sorted and sent together.
PIECE, SLICE = 1 << 18, 1 << 20
#: Suffixes of one bucket, and the pointers below which a partition is sorted at once.
BUCKET, SMALL = 1 << 19, 1 << 13
#: A word is very common from this share of all words on, so there are at most so many of them.
COMMON = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[list(BETWEEN_WORDS)] = 1
_KIND[list(BETWEEN_PIECES)] = 0
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of the base and of its inverse modulo 2^64."""
    numbers = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        powers.append(np.cumprod(factors, dtype=np.uint64))
    return numbers, *powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(raw: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end after a byte between words."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and _KIND[raw[end - 1]] == 2:
            step = np.flatnonzero(_KIND[raw[end : end + size]] != 2)
            end = min(len(raw), end + (int(step[0]) + 1 if len(step) else size))
        yield at, end
        at = end


def words(data: bytes, lang: str, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Id, piece number, start and end of every word of ``data``, and the lower-case bytes.

    The id is a 64-bit hash of language and word, never zero. It is taken for all words at once, from prefix
    sums of the text's polynomial.
    """
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    tongue = np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed))
    ids, pieces, starts, ends, before = [], [], [], [], 0
    for a, b in _cuts(raw, PIECE):
        part = raw[a:b]
        numbers, powers, inverse = _tables(seed, 1 << max(PIECE.bit_length(), len(part).bit_length()))
        kind = _KIND[part]
        edges = np.flatnonzero(np.diff((kind == 2).view(np.int8), prepend=0, append=0))
        s, e = edges[0::2], edges[1::2]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(numbers[part] * powers[: len(part)], out=sums[1:])
        found = _mix((sums[e] - sums[s]) * inverse[s] ^ tongue)
        found[found == 0] = 1
        stops = np.cumsum(kind == 0)
        ids.append(found)
        pieces.append(stops[s] + before)
        starts.append(s + a)
        ends.append(e + a)
        before += int(stops[-1])
    if not ids:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, raw
    return *(np.concatenate(x) for x in (ids, pieces, starts, ends)), raw


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, joined by a piece's end, up to a bounded size or one text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        data = text.encode()
        if size.get(lang, 0) + len(data) > 8 * SLICE and held.get(lang):
            yield lang, b"\n".join(held.pop(lang))
            size[lang] = 0
        held.setdefault(lang, []).append(data)
        size[lang] = size.get(lang, 0) + len(data) + 1
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """``id``, ``lang``, ``word`` and ``n`` of every distinct word of a language."""
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in _slices(batch):
                ids, _, starts, ends, raw = words(data, lang, seed)
                if not len(ids):
                    continue
                coded = pa.array(ids.view(np.int64)).dictionary_encode()
                codes = coded.indices.to_numpy()
                first = np.empty(len(coded.dictionary), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                plain = raw.tobytes()
                spelled = [plain[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.record_batch(
                    [coded.dictionary, pa.array([lang] * len(first), pa.string()), pa.array(spelled, pa.string()), pa.array(np.bincount(codes))],
                    schema=schema,
                )

    parts = _plain(docs).mapInArrow(run, "id long, lang string, word string, n long")
    return parts.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def _checked_vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The vocabulary under the first seed that gives no two words one id."""
    seed = 0
    while True:
        found = cut_lineage(_vocabulary(docs, seed), "vocabulary")
        if found.groupBy("id").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
            return found, seed
        seed += 1


def suffixes(ids: np.ndarray, pieces: np.ndarray, known: np.ndarray, common: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """Suffixes of two words or more that are all ``known``, by the number of words (2, 3, 4) that route them.

    Those that start at the first ``SLICE`` words; columns are the ids of their words, zero behind the end.
    """
    if len(ids) < 2:
        return []
    pairs = known[:-1] & known[1:] & (pieces[:-1] == pieces[1:])
    threes = np.append(pairs[:-1] & pairs[1:], False)
    fours = np.append(threes[:-1] & threes[1:], False)
    at = np.flatnonzero(pairs[:SLICE])
    padded = np.concatenate((ids, np.zeros(2, dtype=np.uint64)))
    none = np.uint64(0)
    columns = [ids[at], ids[at + 1], np.where(threes[at], padded[at + 2], none), np.where(fours[at], padded[at + 3], none)]
    both = common[at] & common[at + 1]
    third = np.append(common, [False])[at + 2] & threes[at]
    routed = 2 + both + (both & third)
    return [(d, [c[routed == d] for c in columns]) for d in (2, 3, 4) if (routed == d).any()]


def _routes(columns: list[np.ndarray], depth: int) -> np.ndarray:
    key = _mix(columns[0])
    for column in columns[1:depth]:
        key = _mix(key ^ column)
    return key


def _routed(docs: DataFrame, seed: int, known: Bitmap, common: np.ndarray, buckets: int) -> DataFrame:
    """``bucket``, ``routed`` and ``data``: suffixes of one bucket with their counts, packed."""
    held = docs.sparkSession.sparkContext.broadcast((known, common))
    schema = pa.schema([("bucket", pa.int32()), ("routed", pa.int32()), ("data", pa.binary())])

    def packed(ids: np.ndarray, pieces: np.ndarray, known: Bitmap, common: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        frequent = known.holds(ids.view(np.int64))
        at = np.minimum(np.searchsorted(common, ids), max(len(common) - 1, 0))
        usual = common[at] == ids if len(common) else np.zeros(len(ids), dtype=bool)
        for depth, columns in suffixes(ids, pieces, frequent, usual):
            key = _routes(columns, depth)
            order = np.lexsort((_mix(columns[2] ^ _mix(columns[3])), key))
            columns, key = [c[order] for c in columns], key[order]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order))).astype(np.uint32)
            columns = [c[first] for c in columns]
            bucket = ((key[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *edges], [*edges, len(first)], strict=True):
                plain = b"".join([*(c[a:b].tobytes() for c in columns), times[a:b].tobytes()])
                yield int(bucket[a]), depth, zlib.compress(plain, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, usual = held.value
        for batch in batches:
            for lang, data in _slices(batch):
                ids, pieces, *_ = words(data, lang, seed)
                for a in range(0, len(ids), SLICE):
                    # the words after a slice end the suffixes that start in it
                    b = a + SLICE + DEPTH - 1
                    rows = list(packed(ids[a:b], pieces[a:b], wanted, usual))
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _plain(docs).mapInArrow(run, "bucket int, routed int, data binary")


def frequent(columns: list[np.ndarray], times: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointer to one suffix, number of words and count of every phrase that occurs ``least[words]`` times.

    Multikey three-way quicksort: a partition shares its first ``depth`` words and is split at the next one into
    smaller, equal and larger. The equal part goes on one word deeper, and its summed ``times`` are the count of
    the phrase. Partitions that can hold no phrase of the counts asked for are abandoned; those of at most ``SMALL``
    pointers are put in order at once.
    """
    floor = {d: min(least[k] for k in range(max(d, 2), DEPTH + 1)) for d in range(1, DEPTH + 1)}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_parts = [(np.arange(len(times)), 0)]
    while open_parts:
        part, depth = open_parts.pop()
        if times[part].sum() < floor[depth + 1]:
            continue
        if len(part) <= SMALL:
            found.extend(_ordered(columns, times, part, depth, least))
            continue
        key = columns[depth][part]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        open_parts += [(part[key < pivot], depth), (part[key > pivot], depth)]
        equal, deeper = part[key == pivot], depth + 1
        count = times[equal].sum()
        if pivot and count >= floor[deeper]:
            if deeper >= 2 and count >= least[deeper]:
                found.append((equal[:1], np.array([deeper]), np.array([count])))
            if deeper < DEPTH:
                open_parts.append((equal, deeper))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ordered(columns, times, part, depth: int, least: dict[int, int]):
    """The phrases of a small partition, from its pointers in order."""
    part = part[np.lexsort([columns[d][part] for d in range(DEPTH - 1, depth - 1, -1)])]
    new = np.zeros(len(part), dtype=bool)
    new[:1] = True
    for d in range(depth, DEPTH):
        key = columns[d][part]
        new[1:] |= key[1:] != key[:-1]
        if d < 1:
            continue
        first = np.flatnonzero(new)
        counts = np.add.reduceat(times[part], first)
        held = (counts >= least[d + 1]) & (key[first] != 0)
        if held.any():
            yield part[first[held]], np.full(held.sum(), d + 1), counts[held]


def _counted(routed: DataFrame, least: int) -> DataFrame:
    """``h1`` to ``h4`` (zero behind the end), ``size`` and ``a`` of the phrases with ``least`` occurrences."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        depth = int(rows["routed"].iloc[0])
        # phrases shorter than what their suffixes were routed by have occurrences in other buckets
        wanted = {k: 1 if k < depth else least for k in range(2, DEPTH + 1)}
        blocks = [np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in rows["data"]]
        sizes = [len(x) // 36 for x in blocks]
        columns = [np.concatenate([x[8 * n * k : 8 * n * (k + 1)] for x, n in zip(blocks, sizes, strict=True)]).view(np.uint64) for k in range(DEPTH)]
        times = np.concatenate([x[32 * n :] for x, n in zip(blocks, sizes, strict=True)]).view(np.uint32).astype(np.int64)
        at, size, count = frequent(columns, times, wanted)
        out = {f"h{k + 1}": np.where(size > k, columns[k][at], np.uint64(0)).view(np.int64) for k in range(DEPTH)}
        return pd.DataFrame({**out, "size": size.astype(np.int32), "a": count})

    keys = [f"h{k + 1}" for k in range(DEPTH)]
    found = routed.groupBy("bucket", "routed").applyInPandas(work, "h1 long, h2 long, h3 long, h4 long, size int, a long")
    return found.groupBy(*keys, "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _part(first: int | Column, size: int) -> Column:
    """The ids of ``size`` words from place ``first`` on, as an array of four."""
    return F.array(*[F.col(f"h{first + k + 1}") if k < size else F.lit(0).cast("long") for k in range(DEPTH)])


def _sub_phrases(phrases: DataFrame, size: int) -> Column:
    """All shorter phrases of two words or more inside one of ``size`` words."""
    return F.array(*[_part(i, k) for k in range(2, size) for i in range(size - k + 1)])


def collocations(docs: DataFrame, least: int = 30, keep: int = 2000, share: int = 80, common: int = COMMON, bucket: int = BUCKET) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of every language.

    Texts are lower-cased in A-Z and split at ``. , ; : ! ?`` and line ends into pieces, these at blanks and
    tabs into words. A phrase of 2 to 4 words with ``a >= least`` occurrences inside pieces is a candidate. Cut
    after its first words, with ``l`` and ``r`` occurrences of its parts, it scores floor(2000000 a / (l + r)); the
    cut of the lowest score counts, of several the first. A candidate goes if a longer one, gone or not, holds its
    words and has ``share`` percent of its occurrences. ``n`` is the number of words of the language; the first
    ``keep`` by score, occurrences and phrase are returned.

    A null language is ``und``, a null text empty; empty texts and tables give no rows. Repeated rows count each
    time. Ties end at the phrase in byte order, which is unique in a language. Other columns are ignored. Two words
    never share an id: the hash is drawn anew until the vocabulary has no clash.
    """
    vocabulary, seed = _checked_vocabulary(docs)
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = vocabulary.where(F.col("n") >= least)
    # at most so many words have that share of all words
    usual = [r["id"] for r in vocabulary.where(F.col("n") * common >= total).select("id").collect()]
    usual = np.sort(np.array(usual, dtype=np.int64).view(np.uint64))
    routed = _routed(docs, seed, bitmap(known, "id"), usual, total // bucket + 1)
    phrases = cut_lineage(_counted(routed, least), "phrases")

    none = F.lit(0).cast("long")
    singles = known.select(F.array(F.col("id"), none, none, none).alias("key"), F.col("n").alias("f"))
    counts = singles.unionAll(phrases.select(F.array("h1", "h2", "h3", "h4").alias("key"), F.col("a").alias("f")))
    cuts = [
        F.array(*[F.struct(F.lit(k).alias("k"), _part(0, k).alias("left"), _part(k, size - k).alias("right")) for k in range(1, size)])
        for size in range(2, DEPTH + 1)
    ]
    keys = ["h1", "h2", "h3", "h4"]
    by_size = F.coalesce(*[F.when(F.col("size") == s, c) for s, c in enumerate(cuts, 2)])
    cut = phrases.select(*keys, "size", "a", F.explode(by_size).alias("cut")).select(*keys, "size", "a", "cut.*")
    cut = cut.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
    cut = cut.join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) DIV CAST(l + r AS DECIMAL(38, 0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cut.groupBy(*keys, "size", "a").agg(lowest).select(*keys, "size", "a", "cut.score", "cut.l", "cut.r")

    inside = F.coalesce(*[F.when(F.col("size") == s, _sub_phrases(phrases, s)) for s in range(3, DEPTH + 1)])
    longer = phrases.where("size > 2").select(F.explode(inside).alias("key"), F.col("a").alias("f"))
    longer = longer.groupBy("key").agg(F.max("f").alias("f"))
    left = scored.withColumn("key", F.array(*keys)).join(longer, "key", "left")
    left = left.where(F.col("f").isNull() | (100 * F.col("f") < share * F.col("a")))

    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    spelled = known.select("id", "lang", "word")
    named = left.select(*keys, "a", "l", "r", "score")
    for k, key in enumerate(keys):
        word = spelled.select(F.col("id").alias(key), F.col("word").alias(f"word{k}"), *(["lang"] if k == 0 else []))
        named = named.join(word, key, "inner" if k < 2 else "left")
    phrase = F.concat_ws(" ", *[f"word{k}" for k in range(DEPTH)]).alias("phrase")
    named = named.select("lang", phrase, "a", "l", "r", "score").join(sizes, "lang")
    return _best(named, keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _best(rows: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)
