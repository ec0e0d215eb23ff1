import hashlib
import random
import zlib

from penprint.llm import warc
from penprint.session import scratch_path


def archive(n=6, packed=True):
    rng = random.Random(4)
    payloads = [bytes(rng.choices(b"abc <p>\n", k=rng.randrange(0, 40_000))) for _ in range(n)]
    members = [warc.record(i, f"http://x/{i}", p) for i, p in enumerate(payloads)]
    return payloads, members if packed else [zlib.decompress(m, 31) for m in members]


def test_records_come_back_whole():
    for packed in (True, False):
        payloads, members = archive(packed=packed)
        found = warc.read_records(b"".join(members))
        assert [r.payload for r in found.records] == payloads and not found.gaps
        assert [r.page_id() for r in found.records] == list(range(6))


def test_salvage_after_damage():
    """Bad bytes in a member, noise between members, a cut end, a wrong length: all others are saved."""
    for packed in (True, False):
        payloads, members = archive(packed=packed)
        places = [0]
        for m in members:
            places.append(places[-1] + len(m))
        middle = len(members[2]) // 2
        broken = members[2][:middle] + b"\x00\xff\x00" + members[2][middle + 3 :]
        data = b"".join([members[0], members[1], broken, members[3], b"noise\x1f\x8b\x08 noise WARC/1.1 no\n", members[4], members[5][:-9]])
        found = warc.read_records(data)
        assert [r.page_id() for r in found.records] == [0, 1, 3, 4]
        assert all(r.payload == payloads[r.page_id()] for r in found.records)
        covered = sorted([(r.start, r.end) for r in found.records] + [(a, b) for a, b, _ in found.gaps])
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
        assert found.gaps[0][0] == places[2] and found.gaps[-1][1] == len(data)
    lied = members[1].replace(b"Content-Length: ", b"Content-Length: 1", 1)
    assert [r.page_id() for r in warc.read_records(members[0] + lied + members[3]).records] == [0, 3]
    assert warc.read_records(b"").records == [] and warc.read_records(b"rubbish").gaps == [(0, 7, "no version line")]


def test_reading_takes_time_in_proportion():
    import time

    member = warc.record(1, None, b"x" * 500)
    times = []
    for n in (2_000, 8_000):
        started = time.thread_time()
        assert len(warc.read_records(member * n).records) == n
        times.append(time.thread_time() - started)
    assert times[1] < 12 * times[0]


def test_archives_of_edge_rows(spark):
    rows = [
        (1, "u1", "same", "x"), (2, "u2\r\nWARC-Type: evil", "same", "x"), (9, None, "same", "x"), (3, "u", None, "x"), (4, "u", "", "x"),
        (5, "u", "née \U0001f600\r\n\r\nWARC/1.1\r\n" * 3, "x"), (None, "u", "same", "x"), (9, None, "same", "x"), (None, None, "alone", None),
        (6, "u", "long " * 300_000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    manifest = warc.write_archives(pages, scratch_path(spark, "warc"))
    found = warc.read_archives(manifest).collect()
    assert not [r for r in found if r.gap] and len(found) == len(rows)
    largest = {}
    for p, _, h, _ in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, _ in rows:
        data, top = (h or "").encode(), largest[h or ""]
        first = p == (None if top < 0 else top)
        want.append((p, len(data), warc.digest(data), "response" if first else "revisit", None if first else top))
        assert hashlib.sha1(data).digest() == __import__("base64").b32decode(warc.digest(data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {bytes(r.payload) for r in found if r.record_type == "response"} == {(h or "").encode() for _, _, h, _ in rows}
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch_path(spark, "warc"))).count() == 0
