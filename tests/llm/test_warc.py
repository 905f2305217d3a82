import gzip
import hashlib
import random

import oracle
import pytest
from pyspark.sql import functions as F

from postloom.llm import warc

KIND = "page_id long, url string, html string, file string, range int, digest string"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "f", 3, "d") for r in rows], KIND)


def rows():
    rng = random.Random(8)
    out = [(i * 7 + (1 << 60), f"http://e.org/{i}", f"<p>{rng.random()}é</p>" * rng.randrange(1, 60)) for i in range(60)]
    same = "<html>" + "x" * 300 + "</html>"
    out += [(i, f"http://same/{i}", same) for i in (90, 12, 55)] + [(i, None, "short") for i in (91, 13)]
    out += [(70, "http://a\r\nX: b", None), (71, "", ""), (72, "u", "y" * 2_000_000), (73, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    out += [(12, "http://same/12", same), (12, "u", "other" * 40), (None, "n", same), (None, "n", "z" * 200), (None, "n", "z" * 200)]
    rng.shuffle(out)
    return out


def slow(given):
    facts = []
    for page, _, html in given:
        data = (html or "").encode()
        facts.append((page, len(data), hashlib.sha256(data).hexdigest()))
    out, seen = [], set()
    for page, size, digest in sorted(facts, key=lambda f: (f[0] is None, f[0] or 0)):
        first = min((p for p, _, d in facts if d == digest and p is not None), default=None)
        if size >= 100 and first is not None and (page != first or digest in seen):
            out.append((page, size, digest, "revisit", first))
        else:
            out.append((page, size, digest, "response", None))
        seen.add(digest)
    return sorted(out, key=str)


def test_round_trip(pages, tmp_path):
    given = rows()
    layout = warc.Layout(least_ranges=5, picked=2, file_bytes=3000)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages(given), folder, layout)
    found = warc.read(manifest, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == slow(given)
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in given}
    assert all(r.payload == texts[r.payload_digest] for r in found if r.record_type == "response")
    listed = manifest.collect()
    assert len(listed) > 5 and sum(m.records for m in listed) == len(given)
    for m in listed:
        data = (tmp_path / "a" / m.file).read_bytes()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not [p for p in (tmp_path / "a" / "_temporary").iterdir()]


def test_files_do_not_depend_on_the_partitions(pages, tmp_path):
    given, sums = [r for r in rows() if r[0] is not None], []
    for n, parts in enumerate((1, 7)):
        shuffled = random.Random(n).sample(given, len(given))
        manifest = warc.write(pages(shuffled).repartition(parts), str(tmp_path / str(n)), warc.Layout(least_ranges=4, file_bytes=4000))
        sums.append(sorted((m.file, m.sha256) for m in manifest.collect()))
    assert sums[0] == sums[1]


def test_commit_can_be_done_again(pages, tmp_path):
    manifest = warc.write(pages(rows()), str(tmp_path), warc.Layout(least_ranges=2))
    before = warc.read(manifest, str(tmp_path)).count()
    assert warc._commit(manifest, str(tmp_path)).count() == manifest.count()
    assert warc.read(manifest, str(tmp_path)).count() == before


def test_broken_files_are_noticed(pages, tmp_path):
    manifest = warc.write(pages([(1, "u", "hello")]), str(tmp_path))
    name = tmp_path / manifest.first().file
    name.write_bytes(gzip.compress(gzip.decompress(name.read_bytes()).replace(b"hello", b"hullo")))
    with pytest.raises(Exception, match="digest is wrong"):
        warc.read(manifest, str(tmp_path)).collect()


def test_empty_table(pages, tmp_path):
    manifest = warc.write(pages([]), str(tmp_path))
    assert manifest.collect() == [] and warc.read(manifest, str(tmp_path)).collect() == []


def test_query_equals_sql(spark, folder):
    assert oracle.difference(spark, oracle.connect(folder), "op5_warc_writer", folder) is None


def test_files_are_read_and_committed_side_by_side(spark, pages, tmp_path):
    given = [(i, f"http://e.org/{i}", f"<p>{i}</p>" * 40) for i in range(1200)]
    manifest = warc.write(pages(given), f"{tmp_path}/many", warc.Layout(least_ranges=300, picked=2, file_bytes=100))
    assert manifest.count() >= 1000
    spread = warc.read(manifest, f"{tmp_path}/many").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 200 and sum(r["count"] for r in spread) == 1200 and max(r["count"] for r in spread) < 30


def test_folder_is_qualified(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == warc.qualified(spark, f"file:{tmp_path}")
