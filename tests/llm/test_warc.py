"""Archives are written, read back and indexed in order."""

import gzip
import hashlib
import itertools
import random
from pathlib import Path

import pytest

from quaytally.llm import warc
from quaytally.llm.common import new_path

SCHEMA = "page_id long, url string, html string, content string, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def plain(rows):
    """The contract's rows, by a plain pass."""
    last = {}
    for i, _, h in rows:
        body = (h or "").encode()
        last[body] = max(last.get(body, (False, 0)), (i is not None, i or 0))
    taken, out = set(), []
    for i, _, h in rows:
        body = (h or "").encode()
        is_last = last[body] == (i is not None, i or 0) and body not in taken
        if len(body) >= 1000 and is_last:
            taken.add(body)
        revisit = len(body) >= 1000 and not is_last
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", (last[body][1] if last[body][0] else None) if revisit else None))
    return sorted(out, key=repr)


def digest(spark, rows):
    return sorted(map(tuple, warc.page_digest(frame(spark, rows)).collect()), key=repr)


LONG = "é" * 600
HARD = [
    (1, "http://www.Example.com/a?x=1#f", LONG), (2, None, LONG), (3, "no scheme", None), (4, "http://e.com/\r\nX: y", ""), (5, "http://e.com", "short"), (6, "http://e.com", "short"),
    (7, "http://e.com/tear", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (8, "http://e.com/tear", "\r\n\r\nWARC/1.1\r\n"), (9, "http://e.com/big", "x\r\n" * 700_000),
    (None, "http://e.com/null", "n" * 1000), (None, "http://e.com/null", "n" * 1000), (11, "http://e.com/both", "m" * 999), (12, "http://e.com/both", "m" * 999), (13, "http://e.com/tie", "t" * 1000), (13, "http://e.com/tie", "t" * 1000), (-5, "http://漢字.com/ü", "t" * 1000),
]


def test_hard_rows(spark):
    assert digest(spark, HARD) == plain(HARD)


def test_hot_payload_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_CLASSES", 0)
    rows = [(i, f"http://h{i % 3}.org/{i}", "hot " * 300 if i % 3 == 0 else f"{i % 20} " * 400) for i in range(200)]
    assert digest(spark, rows) == plain(rows)


def test_an_empty_table_gives_no_rows(spark):
    assert digest(spark, [(1, "u", "h")][:0]) == []


def test_index_is_in_global_order_and_points_into_the_archives(spark):
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/{i % 7}", f"page {i} " * (i % 50)) for i in range(300)]
    path = new_path(spark, "test-warc")
    warc.write_archives(frame(spark, rows).repartition(3), path, archive_bytes=20_000)
    files = list(Path(path.removeprefix("file://")).glob("*.gz"))
    assert len(files) > 5
    index = warc.capture_index(spark, path)
    found = index.collect()
    assert sorted(r.page_id for r in found) == list(range(300))
    keys = [(r.url_key.encode(), r.time, r.page_id) for r in found]
    assert keys == sorted(keys)
    texts = dict((i, h) for i, _, h in rows)
    for r in found[::10]:
        archive = gzip.decompress(Path(r.archive.removeprefix("file://").removeprefix("file:")).read_bytes())
        (_, length, headers, block), *_ = warc.records(archive[r.record_offset : r.record_offset + r.record_length])
        assert length == r.record_length and headers["X-Page-ID"] == str(r.page_id)
        if r.record_type == "response":
            assert block.split(b"\r\n\r\n", 1)[1].decode() == texts[r.page_id]


def test_merging_runs_equals_sorting():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randrange(20), j, i) for i in range(rng.randrange(6))) for j in range(k)]
        assert [runs[r][p] for r, p in warc.merged(runs)] == sorted(itertools.chain(*runs))


@pytest.mark.parametrize(
    ("url", "key"),
    [("http://www.Example.com:80/A?b#c", "com,example)/a?b"), ("https://user@x.org:8443", "org,x:8443)/"), ("", ")/"), ("x.de?q", "de,x)/?q")],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_broken_archives_are_errors():
    whole = warc.record("response", {"WARC-Record-ID": "<a>"}, b"abc")
    assert [r[3] for r in warc.records(whole + whole)] == [b"abc", b"abc"]
    for broken in (whole[:-3], b"x" + whole, whole.replace(b"Length: 3", b"Length: 2")):
        with pytest.raises(ValueError, match="record"):
            list(warc.records(broken))
