import hashlib

import pytest

from fjordbook.llm import archives as A

LONG, SHORT = "<p>long</p>" * 200, "<p>short</p>"
PAGES = [(1, "http://a/x y", LONG), (2, "http://a/2", LONG), (3, None, LONG), (4, "http://b", SHORT), (5, "http://b", SHORT), (6, "http://c", None),
         (7, "http://c", ""), (8, "http://d#frag", "é\r\n\r\nWARC/1.1\r\n日本" * 100), (None, "http://n", LONG), (9, "http://e", "x" * 999), (9, "http://e", "x" * 999), (10, "http://f", "y" * 1000), (11, "http://g", "y" * 1000)]


@pytest.fixture
def converted(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    A.write_arc(pages.repartition(3), f"{tmp_path}/arc")
    A.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    return tmp_path


def test_round_trip_and_revisits(spark, converted):
    rows = A.read_warc(spark, f"{converted}/warc").collect()
    assert len(rows) == len(PAGES)
    top = {}
    for key, _, html in PAGES:
        body = (html or "").encode()
        if key is not None and len(body) >= 1000:
            top[body] = max(top.get(body, key), key)
    expected = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        again = body in top and key != top[body]
        expected.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[body] if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
        assert r.date == "2024-01-01T00:00:00Z"
    assert {r.target for r in rows} >= {"http://a/x%20y", "unknown:", "http://d#frag"}


def test_both_versions_were_written(spark, converted):
    import gzip
    heads = {gzip.open(p).read(200).split(b"\n")[1][:1] for p in (converted / "arc").glob("part-*")}
    assert heads == {b"1", b"2"}


def arc(version, lines):
    body = f"{version} 0 org\n{A.ARC_FIELDS[version]}\n"
    rest = "" if version == 1 else "200 - - 0 f.arc "
    return (f"filedesc://f.arc 0.0.0.0 20010203040506 text/plain {rest}{len(body)}\n{body}\n" + lines).encode()


def test_version_specific_headers_and_declared_lengths():
    one = list(A.parse_arc(arc(1, "http://x 1.2.3.4 20010203040506 text/html 5\nab\ncd\nhttp://y 1.2.3.4 2001 text/html; charset=x 0\n\n")))
    assert [(r["URL"], r["block"], r["Content-type"]) for r in one] == [("http://x", b"ab\ncd", "text/html"), ("http://y", b"", "text/html; charset=x")]
    two = list(A.parse_arc(arc(2, "http://x 1.2.3.4 20010203040506 text/html 404 abc - 17 f.arc 3\nxyz\n")))
    assert (two[0]["Result-code"], two[0]["Checksum"], two[0]["Offset"], two[0]["block"]) == ("404", "abc", "17", b"xyz")


@pytest.mark.parametrize("data", [arc(1, "http://x 1.2.3.4 2001 text/html 50\nshort\n"), arc(1, "no header\n"), b"http://x 1 2 3 4\n", arc(1, "http://x 1 2001 text/html 2")])
def test_broken_archives_stop(data):
    with pytest.raises(ValueError):
        list(A.parse_arc(data))


def test_dates_and_ids():
    assert A.timestamp("20010203") == "2001-02-03T00:00:00Z" and A.timestamp("2001") == "2001-01-01T00:00:00Z"
    ids = [A.record_id("u", d, b"x", place) for d, place in (("d", "f 1"), ("d", "f 1"), ("e", "f 1"), ("d", "f 2"))]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_addresses_that_look_like_keys_and_records_alike(spark, tmp_path):
    body = "x" * 1200
    pages = [(7, "http://a", body), (None, "http://a#page-7", body), (None, "http://b#page-", body), (3, "http://c#page-9", body), (7, "http://a", body), (8, "http://d", "short"), (8, "http://d", "short")]
    A.write_arc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/arc")
    A.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    rows = A.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len({r.record_id for r in rows}) == len(pages)
    assert sorted((r.page_id is None, r.page_id or 0, r.target, r.record_type, r.refers_to) for r in rows) == [
        (False, 3, "http://c#page-9", "revisit", 7), (False, 7, "http://a", "response", None), (False, 7, "http://a", "response", None),
        (False, 8, "http://d", "response", None), (False, 8, "http://d", "response", None),
        (True, 0, "http://a#page-7", "revisit", 7), (True, 0, "http://b#page-", "revisit", 7)]


def test_members_of_a_gzip_file():
    import gzip
    data = gzip.compress(arc(1, "http://x 1.2.3.4 2001 text/html 3\nabc\n")) + gzip.compress(b"http://y 1.2.3.4 2001 text/html 1\nd\n")
    assert [r["block"] for r in A.parse_arc(data)] == [b"abc", b"d"]


def test_no_pages(spark, tmp_path):
    A.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/arc")
    A.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert A.read_warc(spark, f"{tmp_path}/warc").count() == 0
