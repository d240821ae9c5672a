"""WARC files and their audit against the bytes themselves."""

import gzip
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows(prose):
    out = [(i, f"http://h/{i}", f"<p>{prose(5 + i % 40)}</p>") for i in range(700)]
    return out + [(None, "u", "x"), (None, "u", "x"), (5, None, None), (7, "a\r\nb c", ""), (8, "long", "y" * 3_000_000)]


@pytest.fixture(scope="module")
def index(stored, rows):
    pages = stored(rows, PAGE).withColumn("offset", F.lit("clash")).withColumn("part", F.lit(1))
    return warc.write_warc(pages)


def local(path):
    return re.sub("^file:/+", "/", path)


def test_files_hold_all_records(index, rows):
    listed = index.orderBy("part", "file", "record").collect()
    assert len(listed) == len(rows) and max(r["record"] for r in listed) < warc.RECORDS
    ids = [r["page_id"] for r in listed]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    seen = []
    for path in {r["path"] for r in listed}:
        whole = open(local(path), "rb").read()
        own = [r for r in listed if r["path"] == path]
        assert own[-1]["offset"] + own[-1]["length"] == len(whole)
        parts = [zlib.decompress(whole[r["offset"] : r["offset"] + r["length"]], 31) for r in own]
        assert b"".join(parts) == gzip.decompress(whole)
        for part in parts:
            head, body = part.split(b"\r\n\r\n", 1)
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.0\r\n") and len(body) == size + 4
            seen.append(body[:size].decode())
    assert sorted(seen) == sorted(h or "" for _, _, h in rows)


def test_equal_replicas_differ_nowhere(index):
    copies = warc.replicate(index)
    assert warc.audit(index, copies).count() == 0
    records = warc.leaves(index, 0).unionByName(warc.leaves(index, 1, copies))
    roots = warc.trees(records)[-1].collect()
    assert len(roots) == 2 and roots[0]["hash"] == roots[1]["hash"] and {r["place"] for r in roots} == {0}


def test_damage_is_found(index):
    copies = warc.replicate(index, damage=F.col("page_id") % 50 == 3)
    where = {r["path"]: local(r["copy"]) for r in copies.collect()}
    listed = index.orderBy("part", "file", "record").collect()
    by_file = {}
    for r in listed:
        by_file.setdefault(r["path"], []).append(r)
    paths = sorted(by_file)
    wanted = {(r["path"], r["offset"]): "changed" for r in listed if r["page_id"] is not None and r["page_id"] % 50 == 3}
    cut, gone, longer = paths[0], paths[1], paths[2]
    cut_at = by_file[cut][-2]["offset"] + 3
    with open(where[cut], "r+b") as file:
        file.truncate(cut_at)
    wanted[(cut, by_file[cut][-2]["offset"])] = "short"
    wanted[(cut, by_file[cut][-1]["offset"])] = "missing"
    import os

    os.replace(where[gone], where[gone] + ".away")
    wanted |= {(gone, r["offset"]): "missing" for r in by_file[gone]}
    with open(where[longer], "ab") as file:
        file.write(b"tail")
    wanted[(longer, by_file[longer][-1]["offset"])] = "extended"
    got = {(r["path"], r["offset"]): r["status"] for r in warc.audit(index, copies).collect()}
    assert got == wanted


def test_only_differing_branches_are_compared(spark):
    rows = [(r, p, bytes([0 if r == 0 or p != 777 else 1])) for r in (0, 1) for p in range(1000)]
    levels = warc.trees(spark.createDataFrame(rows, "replica int, place long, hash binary").withColumn("size", F.lit(1)))
    assert len(levels) == 4
    assert [r["place"] for r in warc.differing(levels, 0, 1).collect()] == [777]
    for level, place in zip(levels[1:], (777 >> 4, 777 >> 8, 0)):
        a, b = ({r["place"]: r["hash"] for r in level.where(F.col("replica") == k).collect()} for k in (0, 1))
        assert [p for p in a if a[p] != b[p]] == [place]


def test_no_pages(stored):
    index = warc.write_warc(stored([], PAGE, parts=1))
    assert index.count() == 0 and warc.audit(index, warc.replicate(index)).count() == 0
