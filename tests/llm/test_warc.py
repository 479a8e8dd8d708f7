"""Round trips, revisits and damaged archives."""
import base64
import hashlib
import io

from panelyard.llm import warc


def read(data):
    return list(warc.read_records(io.BytesIO(data).read))


def test_records_round_trip():
    payloads = [b"", b"x", b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 5000, b"a" * 3_000_000]
    data = b"".join(warc.response_record(str(i), f"http://h/{i}", p) for i, p in enumerate(payloads))
    got = read(data)
    assert [r.payload for r in got] == payloads and all(r.problem is None for r in got)
    assert [r.headers["warc-target-uri"] for r in got] == [f"http://h/{i}" for i in range(5)]
    again = read(data[got[2].offset :])
    assert [r.payload for r in again] == payloads[2:]


def test_small_reads_give_the_same():
    data = b"".join(warc.response_record(str(i), "u", bytes([i]) * 5000) for i in range(4))
    f = io.BytesIO(data)
    assert [r.payload for r in warc.read_records(lambda n: f.read(7))] == [r.payload for r in read(data)]


def test_damage_is_told():
    a, b = warc.response_record("1", "u", b"hello" * 50), warc.response_record("2", "u", b"world")
    assert [r.problem for r in read(a + b[:-9])] == [None, "cut member"]
    bad = bytearray(b)
    bad[30] ^= 255
    last = read(a + bytes(bad))[-1]
    assert last.problem
    import zlib

    text = zlib.decompress(a, 31).replace(b"hellohello", b"hellojello", 1)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert read(z.compress(text) + z.flush())[0].problem == "block digest differs"
    assert read(b"") == []


def test_revisits_by_largest_key(spark):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/\r\nX: y", "other"), (4, None, None), (5, "", ""), (7, "u", "same"), (7, "u", "same"), (None, "n", "alone")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.read_archives(warc.write_archives(d, "page_id", "url", "html", roll=600)).collect()
    assert len(got) == len(pages) and all(r.problem is None for r in got)
    kinds = {(r.record_key, r.record_type, r.refers_to) for r in got}
    assert kinds == {("1", "revisit", "7"), ("2", "revisit", "7"), ("3", "response", None), ("4", "revisit", "5"), ("5", "response", None), ("7", "response", None), ("", "response", None)}
    for r in got:
        want = {str(i): (h or "").encode() for i, _, h in pages}.get(r.record_key, b"alone")
        assert r.payload_bytes == len(want) and r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
    assert len({r.path for r in got}) > 3


def test_smaller_payloads_are_all_responses_and_empty_table(spark):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(d, "page_id", "url", "html", min_revisit=3), payloads=False).collect()
    assert {(r.record_key, r.record_type) for r in got} == {("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")}
    assert warc.read_archives(warc.write_archives(d.limit(0), "page_id", "url", "html")).count() == 0


def member(head, block=b"abc", tail=b"\r\n\r\n"):
    import zlib

    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head + b"\r\n\r\n" + block + tail) + z.flush()


def test_odd_headers_are_problems_and_reading_goes_on():
    import os

    good = warc.response_record("1", "u", b"hello")
    for length in (b"abc", b"-3", b"1e3", b"", "٣".encode(), b"9" * 30):
        got = read(member(b"WARC-Type: resource\r\nContent-Length: " + length) + good)
        assert [r.problem for r in got] == ["bad Content-Length", None]
    got = read(member(b"Content-Type: text/plain;\r\n charset=x\r\nContent-Length:\r\n\t3") + good)
    assert got[0].headers["content-type"] == "text/plain; charset=x" and [r.problem for r in got] == [None, None] and got[0].payload == b"abc"
    assert [r.problem for r in read(member(b"X: " + os.urandom(3 << 20).hex().encode()) + good)] == ["no header", None]


def test_digests_by_their_kind():
    for kind, make in (("SHA1", hashlib.sha1), ("sha256", hashlib.sha256), ("SHA-512", hashlib.sha512), ("md5", hashlib.md5)):
        for show in (lambda d: base64.b32encode(d).decode(), lambda d: d.hex(), lambda d: d.hex().upper()):
            def one(data):
                return read(member(f"Content-Length: 3\r\nWARC-Block-Digest: {kind}:{show(make(data).digest())}".encode()))[0].problem

            assert one(b"abc") is None and one(b"abd") == "block digest differs"
    assert read(member(b"Content-Length: 3\r\nWARC-Block-Digest: crc:abc"))[0].problem == "block digest of unknown kind"


def test_bad_length_of_a_revisit_is_a_problem(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(member(b"WARC-Type: revisit\r\nContent-Type: application/http\r\nContent-Length: 42", b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"[:42].ljust(42)))
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).collect()
    assert len(got) == 1 and got[0].problem == "bad Content-Length" and got[0].payload_bytes is None
