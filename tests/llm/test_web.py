"""WARC archives and url rules."""

import base64
import gzip
import hashlib

import pytest

from riskloom.llm import urls, warc

PAGES = "page_id long, url string, html string, key string, block int, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1, "z") for i, u, h in rows], PAGES)


def test_report_equals_brute_force(spark, tmp_path):
    long_text = "".join(f"<p>{i} é\r\n\r\nWARC/1.1\r\n0\r\n\r\n</p>" for i in range(4_000))
    rows = [(5, "http://a.b/\r\nx", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "u", long_text),
            (6, "u", long_text), (None, "u", "same"), (None, "u", "only without id"), (7, "u", "twice"), (7, "v", "twice"), (8, "u", "one\x00two")]
    found = warc.archive_report(pages(spark, rows), str(tmp_path / "w"), segment_bytes=1_000).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = []
    for i, _, h in rows:
        data = (h or "").encode()
        holder = first.get(h or "")
        revisit = holder is not None and holder != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        wanted.append((i, len(data), digest, "revisit" if revisit else "response", holder if revisit else None))
    got = [tuple(r)[:5] for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert max(r["segments"] for r in found) > 100


def test_small_payloads_are_not_revisited(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    found = warc.archive_report(pages(spark, rows), str(tmp_path / "w"), min_revisit_bytes=4).collect()
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in found} == {
        1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_empty_archive(spark, tmp_path):
    assert warc.archive_report(pages(spark, []), str(tmp_path / "w")).collect() == []


def test_chunked_framing():
    for data in (b"", b"x", b"0\r\n\r\n" * 50, bytes(range(256)) * 100):
        framed = warc.frame_chunks(data, 37)
        assert warc.unframe_chunks(framed) == data
        assert warc.unframe_chunks(framed[:-6]) in (None, b"")
    assert warc.unframe_chunks(b"5;name=value\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc.unframe_chunks(b"zz\r\nhello") is None and warc.unframe_chunks(b"5\r\nhel") is None
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab"


def test_segments_out_of_order_missing_and_repeated(spark, tmp_path):
    payload = b"abcdefghij" * 10
    block = warc._HEAD + warc.frame_chunks(payload)
    whole = list(warc.records_of("response", "urn:a", {"WARC-Page-ID": 1}, block, 50))
    short = list(warc.records_of("response", "urn:b", {"WARC-Page-ID": 2}, block, 50))
    single = list(warc.records_of("response", "urn:c", {"WARC-Page-ID": 3}, block, 5_000))
    info = warc._record("warcinfo", "urn:i", {}, b"software: x")
    records = [info, *reversed(whole), whole[2], *short[:2], *short[3:], *single]
    # a gzip member per record, as crawlers write them
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    (tmp_path / "y.warc").write_bytes(single[0].replace(b"urn:c", b"urn:d") + b"\r\n\r\n" + single[0][:60])
    found = {r["record_id"]: r["payload"] for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert {k: v and bytes(v) for k, v in found.items()} == {"urn:a": payload, "urn:b": None, "urn:c": payload, "urn:d": payload}


URLS = ["http://a.example.net/en/1", "http://A.Example.NET/de/1", "https://net/", "http://net", "http://xnet/", "http://example.com/de/",
        "http://example.com/de", "http://www.example.com/de/x?y#z", "http://example.org/fr/", "http://org/fr/q", "http://example.org?fr/",
        "no scheme", "", None, "http://", "://example.net/en/", "http://example.net#/en/", "http://u.example.net/EN/", "http://a.net/x://b.com/de/",
        "http://example.net./en/", "http://example-net/", "http://\nexample.net/en/", "ftp://ÉXAMPLE.net/é"]


def plain(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("rules", [urls.RULES, (), tuple(
    (v, h, p) for v, (h, p) in zip(["block", "allow"] * 20, [(h, p) for h in ("net", "example.net", "a.example.net", "com", "example.com", "org")
                                                             for p in ("/", "/en/", "/de/", "/fr/", "/en/1")]))])
def test_rules_equal_brute_force(spark, rules):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], ""), (3, URLS[1], ""), (3, URLS[1], "")]
    rows += [(100 + i, f"http://hot.example.net/en/{i % 50}", "") for i in range(6_000)]  # one host in several ranges
    rows += [(10_000 + i, f"http://h{i % 97}.example.{['net', 'com', 'org'][i % 3]}/{['en', 'de', 'fr'][i % 7 % 3]}/{i}", "") for i in range(3_000)]
    found = urls.judge(pages(spark, rows), rules).collect()
    wanted = [(i, *plain(u, rules, "allow")) for i, u, _ in rows]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_no_urls(spark):
    assert urls.judge(pages(spark, [])).collect() == []
