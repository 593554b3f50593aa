"""Archives: exact round trip, revisits, rolling, and files outside the manifest."""

import glob
import os
from collections import defaultdict

import pytest

from quern.llm import warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y%", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "été" * 50_000), (6, "w", "same"), (6, "w", "same"), (None, "n", "same"), (7, "q", "\r\n\r\nWARC/1.1\r\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, uid int, digest string").repartition(3)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, tmp_path, min_bytes):
    root = f"file://{tmp_path}/w{min_bytes}"
    warc.write_archives(frame(spark, PAGES), root, min_bytes=min_bytes, roll=200)
    got = warc.read_archives(spark, root).collect()
    assert len(got) == len(PAGES)
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[(h or "").encode()].append(i)
    by_digest = {warc.base32_sha1(h): h for h in groups}
    responses = defaultdict(list)
    for r in got:
        h = by_digest[r.payload_digest]
        assert r.payload_bytes == len(h)
        best = max((i for i in groups[h] if i is not None), default=None)
        if r.record_type == "response":
            responses[h].append(r.page_id)
            assert bytes(r.payload) == h and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == best and len(h) >= min_bytes
    for h, ids in groups.items():
        assert len(responses[h]) == (1 if len(h) >= min_bytes else len(ids))
        if len(h) >= min_bytes:
            assert responses[h] == [max((i for i in ids if i is not None), default=None)]
    assert sorted(str(r.url) for r in got) == sorted(str(u) for _, u, _ in PAGES)


def test_files_roll_and_strays_are_not_read(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archives(frame(spark, PAGES), root, roll=1)
    assert sum(f["n_records"] for f in manifest["files"]) == len(PAGES) == len(manifest["files"])
    with open(tmp_path / "w/part-stray.warc.gz", "wb") as f:
        f.write(warc.member(b"broken"))
    assert warc.read_archives(spark, root).count() == len(PAGES)
    assert not glob.glob(f"{tmp_path}/w/.temp*")
    first = manifest["files"][0]["name"]
    with open(tmp_path / "w" / first, "r+b") as f:
        f.truncate(os.path.getsize(tmp_path / "w" / first) - 3)
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, root).collect()


def test_empty_and_same_bytes(spark, tmp_path):
    assert warc.round_trip(frame(spark, []), f"file://{tmp_path}/e").count() == 0
    row = {"uid": 1, "page_id": 2, "url": "u", "html": b"x", "digest": warc.base32_sha1(b"x"), "refers_to": None, "refers_uid": None}
    assert warc.member(warc.record(row)) == warc.member(warc.record(dict(row)))
