"""Removal of long repeated byte strings by prefix-free parsing.

A hash rolled over the text puts a phrase boundary wherever it hits (Boucher et al., 2019), so equal
text is cut alike wherever it stands. A suffix is then ordered by the rest of its phrase and by the
phrases after it, and since only the first ``length`` bytes matter here, the order is needed to that
depth only: the starts in a phrase and the bytes that follow them make one *context*. The dictionary is
the table of distinct contexts with their counts, the parse is the table of their occurrences.

* A context that occurs twice repeats every string that starts in its phrase.
* Strings of two different contexts can be equal only if the contexts share a core around the boundary.
  Contexts of one core get their suffixes sorted, and neighbours in that order that agree over the
  whole length are repeats.

Most text is unique and leaves at the first count of cores, of which nothing but a hash is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.groups import by_run, cells
from postloom.session import cut_lineage

#: Bytes that the rolling hash looks at.
WINDOW = 8
#: A boundary about every 2 ^ RARE bytes; strings without one use boundaries about every 2 ^ DENSE bytes.
RARE, DENSE = 6, 3
FACTORS = {RARE: 0x9E3779B97F4A7C15, DENSE: 0xC2B2AE3D27D4EB4F}
#: Bases of the polynomials that cores and contexts are hashed by.
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
#: Bytes of texts that are parsed together.
PART = 1 << 18
#: Starts of a context lie within this many bytes, so its strings share a core of the length less this.
STEP = 100
#: Contexts of a core that are sorted in one piece; a cell has two pieces at most.
CHUNK = 2048
#: Size limit of the bitmaps that spare rows the way to a join; beyond it they let more rows through.
MOST_BITS = 1 << 28


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A number for each byte, and for both polynomials the powers of their bases and of the inverses modulo 2^64."""
    numbers = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)

    def powers(base: int) -> np.ndarray:
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return numbers, [(powers(b), powers(pow(b, -1, 1 << 64))) for b in BASES]


class _Sums:
    """Prefix sums of the two polynomials of a text, from which the hash of any stretch follows at once.

    A text longer than ``PART`` bytes is summed in parts of that size, which overlap by another.
    """

    def __init__(self, raw: np.ndarray) -> None:
        self.raw, self.made = raw, {}

    def _part(self, which: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if (which, k) not in self.made:
            if len(self.made) > 8:
                self.made.clear()
            part = self.raw[k * PART : (k + 2) * PART]
            numbers, powers = _tables(2 * PART)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(numbers[part] * powers[which][0][: len(part)], out=sums[1:])
            self.made[which, k] = sums, powers[which][1]
        return self.made[which, k]

    def hashes(self, which: int, start: np.ndarray, end: np.ndarray, mark: np.ndarray | int) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        at = start // PART
        for k in np.unique(at).tolist():
            sums, inverse = self._part(which, k)
            here = slice(None) if len(self.raw) <= PART else at == k
            s, e = start[here] - k * PART, end[here] - k * PART
            out[here] = (sums[e] - sums[s]) * inverse[s]
        return mixed(out ^ mixed(np.atleast_1d(np.asarray(mark, dtype=np.uint64)))).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def boundaries(raw: np.ndarray, rare: int, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase boundaries (ends of the windows whose hash begins with ``rare`` zero bits) and the texts they are in."""
    found = [np.empty(0, dtype=np.int64)]
    for a in range(0, len(raw) - WINDOW + 1, PART):
        part = raw[a : a + PART + WINDOW - 1]
        word = np.ndarray(len(part) - WINDOW + 1, dtype="<u8", buffer=part.data, strides=(1,)).copy()
        found.append(np.flatnonzero((word * np.uint64(FACTORS[rare])) >> np.uint64(64 - rare) == 0) + a)
    start = np.concatenate(found)
    text = np.searchsorted(first, start, side="right") - 1
    inside = start + WINDOW <= end[text]
    return start[inside] + WINDOW, text[inside]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts without nulls in one run, and where each begins, with the end of the last."""
    texts = texts.cast(pa.binary()).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def parse(raw: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Core hash, context hash, text, first start and number of starts of every context of some texts.

    A string's boundary is the first one at least a window after its start, if it ends within the string;
    its place depends on the string alone. Strings without any boundary are contexts of their own. The texts are
    parsed as one run of bytes, in which nothing crosses the end of a text.
    """
    first, end = edges[:-1], edges[1:]
    last = end - length
    sums, found = _Sums(raw), []

    def split(low, high, at, level: int) -> None:
        for step in range(length // STEP + 1):
            near = np.maximum(at - high, step * STEP)
            far = np.minimum(at - low, step * STEP + STEP - 1)
            held = near <= far
            if not held.any():
                continue
            here, near, far = at[held], near[held], far[held]
            core, start, count = here - step * STEP, here - far, far - near + 1
            mark = 4 + 2 * step + level
            found.append((
                sums.hashes(0, core, core + length - STEP, mark),
                # where the starts stand to the boundary is part of the context
                sums.hashes(1, start, start + count - 1 + length, (far << 32) + (count << 16) + mark),
                start,
                count,
            ))

    at, text = boundaries(raw, RARE, first, end)
    before = np.concatenate(([-1], at[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))[: len(before)]] = -1
    low = np.maximum(np.maximum(before[: len(at)] - WINDOW + 1, first[text]), at - length)
    high = np.minimum(at - WINDOW, last[text])
    held = low <= high
    low, high, at = low[held], high[held], at[held]
    split(low, high, at, 0)

    # starts that no context holds
    valid, taken = np.zeros(len(raw) + 1, dtype=np.int8), np.zeros(len(raw) + 1, dtype=np.int8)
    whole = last >= first
    valid[first[whole]] += 1
    valid[last[whole] + 1] -= 1
    taken[low] += 1
    taken[high + 1] -= 1
    starts = np.flatnonzero((np.cumsum(valid, dtype=np.int8) > 0) & (np.cumsum(taken, dtype=np.int8) == 0))
    if len(starts):
        dense = np.append(boundaries(raw, DENSE, first, end)[0], 1 << 60)
        at = dense[np.searchsorted(dense, starts + WINDOW)]
        bare = at > starts + length
        alone = starts[bare]
        if len(alone):
            one = np.ones(len(alone), dtype=np.int64)
            found.append((sums.hashes(0, alone, alone + length, 1), sums.hashes(1, alone, alone + length, 2), alone, one))
        starts, at = starts[~bare], at[~bare]
    if len(starts):
        cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(starts) - 1]))
        split(starts[firsts], starts[lasts], at[firsts], 1)
    if not found:
        return (np.empty(0, dtype=np.int64),) * 5
    core, context, start, count = (np.concatenate(c) for c in zip(*found, strict=True))
    text = np.searchsorted(first, start, side="right") - 1
    return core, context, text, start - first[text], count


@dataclass
class Bitmap:
    """Bits of a set of keys: a key that is not in it is not in the set."""

    bits: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys % np.int64(8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, key: str) -> Bitmap:
    """Bitmap of a long column, at 16 bits for each row and ``MOST_BITS`` at most: a bounded sketch.

    It only thins out rows before a join that decides; what it lets through does not matter to results.
    """
    page = 8 * 4096  # bits of one bitmap of Spark's aggregate
    pages = min(MOST_BITS, 16 * keys.count()) // page + 1
    at = F.pmod(F.col(key), F.lit(pages * page))
    rows = keys.groupBy((at / page).cast("long").alias("page")).agg(
        F.bitmap_construct_agg(F.pmod(at, F.lit(page))).alias("bits")
    )
    bits = np.zeros(pages * 4096, dtype=np.uint8)
    for row in rows.toLocalIterator():
        bits[row["page"] * 4096 : (row["page"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Bitmap(bits)


def _parts(edges: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + size, side="right")) - 1)
        yield at, end
        at = end


_PARSE = pa.schema(
    [("core", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("starts", pa.int32())]
)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _parse(docs: DataFrame, length: int, cores: Bitmap | None = None) -> DataFrame:
    """Contexts of all texts; only those whose core may be in ``cores`` when it is given."""
    held = docs.sparkSession.sparkContext.broadcast(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            raw, edges = bytes_of(batch.column("text"))
            for a, b in _parts(edges, PART):
                core, context, text, start, starts = parse(raw[edges[a] : edges[b]], edges[a : b + 1] - edges[a], length)
                if wanted is not None:
                    kept = wanted.holds(core)
                    core, context, text, start, starts = (c[kept] for c in (core, context, text, start, starts))
                if len(core):
                    places = pa.array(text + a)
                    ids, keys = (batch.column(c).take(places) for c in ("doc_id", "text_key"))
                    columns = [pa.array(core), pa.array(context), ids, keys, pa.array(start.astype(np.int32)), pa.array(starts.astype(np.int32))]
                    yield pa.record_batch(columns, schema=_PARSE)

    return docs.mapInArrow(run, "core long, context long, doc_id long, text_key long, start int, starts int")


def _may_hold(keys: Bitmap, *columns: str) -> Column:
    known = keys.bits

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(Bitmap(known).holds(values.to_numpy()))

    return test(F.xxhash64(*columns))


def _same_document(id_column: str, key_column: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(id_column)) & (F.col("text_key") == F.col(key_column))


def _document_bitmap(lists: DataFrame) -> Bitmap:
    return bitmap(lists.select(F.xxhash64("id", "key").alias("k")), "k")


def _strings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``cid`` and ``data`` (the bytes) of wanted contexts (``cid``, ``at`` in a document)."""
    lists = wanted.groupBy(F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("key")).agg(
        F.collect_list(F.struct("cid", "at.start", "at.starts")).alias("wanted")
    )
    lists = cut_lineage(lists, "wanted")
    near = docs.where(_may_hold(_document_bitmap(lists), "doc_id", "text_key"))
    joined = near.join(lists, _same_document("id", "key")).select("text", "wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                data = text.encode()
                out += [(w["cid"], data[w["start"] : w["start"] + w["starts"] - 1 + length]) for w in wanted]
            yield pd.DataFrame(out, columns=["cid", "data"])

    return joined.mapInPandas(run, "cid long, data binary")


def _repeated_suffixes(length: int) -> Callable[[pd.DataFrame], pd.DataFrame | None]:
    """Starts whose string another context of the core has: neighbours in the order of the suffixes."""

    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        run = run.drop_duplicates("cid")
        suffixes = sorted(
            (data[k : k + length], cid, k)
            for cid, data in zip(run["cid"], run["data"], strict=True)
            for k in range(len(data) - length + 1)
        )
        found: dict[int, set[int]] = {}
        for one, two in zip(suffixes, suffixes[1:], strict=False):
            if one[0] == two[0]:
                found.setdefault(one[1], set()).add(one[2])
                found.setdefault(two[1], set()).add(two[2])
        if not found:
            return None
        return pd.DataFrame({"cid": list(found), "starts": [sorted(s) for s in found.values()]})

    return work


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """``id``, ``key`` (hash of the text) and ``spans`` (``start``, ``starts``, ``only``) of texts with repeats.

    A span says that the strings at ``starts`` successive places from ``start`` are repeats, or, when
    ``only`` is not null, those at these offsets.
    """
    texts = _keyed(docs)
    cores = _parse(texts, length).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    cores = cut_lineage(cores, "cores")
    met = _parse(texts, length, bitmap(cores, "core")).join(cores, "core")
    met = cut_lineage(met, "parse")

    place = F.min(F.struct("doc_id", "text_key", "start", "starts")).alias("at")
    dictionary = met.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), place)
    dictionary = cut_lineage(dictionary.withColumn("cid", F.monotonically_increasing_id()), "dictionary")
    alike = dictionary.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # a core whose contexts all occur twice is settled already
    open_cores = alike.where("kinds > 1 AND least = 1").select("core")
    unsettled = cut_lineage(dictionary.join(open_cores, "core").select("core", "cid", "n", "at"), "unsettled")

    runs = cells(unsettled.select("core", "cid"), ["core"], F.col("cid"), CHUNK)
    runs = runs.join(_strings(texts, unsettled, length), "cid")
    keys = ["core", "cell_a", "cell_b"]
    parts = by_run(runs.select(*keys, "cid", "data"), keys, _repeated_suffixes(length), "cid long, starts array<int>")
    parts = parts.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("only"))

    # in a context that occurs twice all starts are repeats
    known = dictionary.join(parts, "cid", "left").where("n > 1 OR only IS NOT NULL")
    known = known.select("core", "context", F.when(F.col("n") == 1, F.col("only")).alias("only"))
    spans = met.join(known, ["core", "context"])
    return spans.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.collect_list(F.struct("start", "starts", "only")).alias("spans")
    )


def covered(size: int, base: np.ndarray, spans: pa.ListArray, length: int) -> np.ndarray:
    """Which of ``size`` bytes the strings of the spans cover; the spans of text i count from ``base[i]``."""
    count = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    start = flat.field("start").to_numpy(zero_copy_only=False) + np.repeat(base, count)
    starts, only = flat.field("starts").to_numpy(zero_copy_only=False), flat.field("only")
    whole = only.is_null().to_numpy(zero_copy_only=False)
    some = only.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.repeat(start, some) + only.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate((start[whole], at))
    end = np.concatenate((start[whole] + starts[whole] - 1 + length, at + length))
    change = np.bincount(begin.astype(np.int64), minlength=size + 1) - np.bincount(end.astype(np.int64), minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def _cut(batch: pa.RecordBatch, length: int, kind: pa.Schema) -> pa.RecordBatch:
    """What is left of some texts without the bytes that their spans cover."""
    raw, edges = bytes_of(batch.column("text"))
    gone = covered(len(raw), edges[:-1], batch.column("spans"), length)
    before = np.concatenate(([False], gone[:-1]))
    before[edges[:-1][edges[:-1] < len(raw)]] = False
    removed = np.concatenate(([0], np.cumsum(gone)))[edges]
    runs = np.concatenate(([0], np.cumsum(gone & ~before)))[edges]
    left = edges - removed
    kept = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(raw[~gone].tobytes())]
    )
    columns = [batch.column("doc_id"), pa.array(np.diff(edges)), pa.array(np.diff(removed)), pa.array(np.diff(runs)), kept.cast(pa.binary())]
    return pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=kind)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left).

    Removes every byte of the UTF-8 text that a string of ``length`` bytes covers which starts anywhere
    else as well, in the same document or another; strings never cross documents and are judged on the
    input. A null text is empty. Repeated rows are copies of each other; rows that share an id are told
    apart by their text. An empty table gives no rows; other columns are ignored.
    """
    lists = cut_lineage(repeated_spans(docs, length), "spans")
    texts = _keyed(docs)
    may = _may_hold(_document_bitmap(lists), "doc_id", "text_key")
    whole = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    size = F.octet_length("text").cast("long")
    untouched = texts.where(~may).select(
        "doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), whole.alias("kept")
    )

    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield _cut(batch.slice(at, 512), length, kind)

    joined = texts.where(may).join(lists, _same_document("id", "key"), "left").select("doc_id", "text", "spans")
    cut = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return untouched.unionAll(cut)
