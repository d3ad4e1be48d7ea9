"""WARC round trips and the URL filter against brute force."""

import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import url_filter, warc
from tallyframe.llm.q_pages import RULES

SCHEMA = "page_id long, url string, html string, path string, offset int, good int, host string"


def pages():
    bodies = [None, "", "<p>one</p>", "<p>one</p>", "é漢\U0001F600", "x" * 300_000, "WARC/1.1\r\n\r\n", "\x1f\x8b\x08 not gzip", "<p>one</p>"]
    rows = [(i + 1, f"https://h{i}.example/a/{i}?q", b, "p", 1, 0, "h") for i, b in enumerate(bodies)]
    return rows + [(3, "https://again.example/", "<p>one</p>", "p", 1, 0, "h"), (50, None, "only", "p", 1, 0, "h"), (None, "http://x/", "only", "p", 1, 0, "h"), (None, "http://x/", "no id", "p", 1, 0, "h")]


@pytest.mark.parametrize("split, least", [(1 << 20, 0), (700, 0), (64, 1)])
def test_archives_come_back(spark, tmp_path, split, least):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    files = warc.write_archives(df, str(tmp_path / "w"), least=least, file_bytes=2000)
    got = warc.read_archives(files, split_bytes=split).where("record_type <> 'warcinfo'").collect()
    assert len(got) == len(rows) and {r.record_type for r in got} == {"response", "revisit"}
    groups = {}
    for key, _, body, *_ in rows:
        groups.setdefault(body or "", []).append(key)
    seen = sorted((r.record_id if (r.record_id or "").isdigit() else "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in got)
    want = []
    for key, _, body, *_ in rows:
        raw = (body or "").encode()
        known = [k for k in groups[body or ""] if k is not None]
        first = min(known) if known and len(groups[body or ""]) > 1 and len(raw) >= least else None
        revisit = first is not None and key != first
        want.append((str(key or ""), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", str(first) if revisit else ""))
    assert seen == sorted(want)
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest


def test_archives_are_plain_gzip(spark, tmp_path):
    files = warc.write_archives(spark.createDataFrame(pages()[:4], SCHEMA), str(tmp_path / "w")).collect()
    text = b"".join(gzip.open(f.path).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == 4 + len(files) and b"WARC-Refers-To: <urn:page:3>" in text


def test_empty_and_damaged_archives(spark, tmp_path):
    none = warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    whole = warc.member(warc.record("1", "u", b"first", None)) + warc.member(warc.record("2", "u", bytes(range(256)) * 40, None))
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(b"junk" + whole[:-20])
    files = spark.createDataFrame([(str(path), len(whole) - 16, 2)], warc.MANIFEST)
    got = warc.read_archives(files).orderBy("offset").collect()
    assert [r.record_type for r in got] == ["response", "corrupt"] and got[0].payload == b"first"


@pytest.mark.parametrize("split", [1 << 20, 700])
def test_long_headers_come_back(spark, tmp_path, split):
    long = "https://h.example/" + "".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(2500))  # 100 KB that hardly shrink
    rows = [(1, "https://h.example/1", "one", "p", 1, 0, "h"), (2, long, "two", "p", 1, 0, "h"), (3, long, "one", "p", 1, 0, "h"), (4, "u", "four", "p", 1, 0, "h")]
    files = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    got = warc.read_archives(files, split_bytes=split).where("record_type <> 'warcinfo'").collect()
    assert len(got) == sum(f.records for f in files.collect()) == len(rows)
    assert {r.record_id: (r.target_uri, r.record_type) for r in got} == {str(k): (u, "revisit" if k == 3 else "response") for k, u, *_ in rows}
    # damaged inside a long header: a corrupt row, not none
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(warc.member(warc.record("1", "u", b"first", None)) + warc.member(warc.record("2", long, b"x", None))[:40_000])
    cut = warc.read_archives(spark.createDataFrame([(str(path), path.stat().st_size, 2)], warc.MANIFEST)).orderBy("offset").collect()
    assert [r.record_type for r in cut] == ["response", "corrupt"]


def verdict(host, path):
    best = None
    for v, rule in RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (v, rule)
    return best


def test_rules_and_parts(spark):
    urls = ["https://a.net/x", "http://Sub.Example.NET/en/1?q#f", "example.net/en/", None, "", "ftp://example.com/de/x", "x://example.com/de", "http://deep.org/fr/9", "http://org", "http://net?x=/y",
            "http://example.net/en", "http://notexample.com/de/1", "a://b://c/d", "http://É.org/fr/é", "http://h.io/" + "s/" * 400]
    rows = [(i, u, "p", 0, True, "h") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, path string, n int, good boolean, host string"), RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        want = verdict(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want[1] if want else None)
        if want:
            assert got[i].verdict == want[0]
    assert url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, path string, n int, good boolean, host string").limit(0), RULES).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = []
    for i in range(400):
        section = ["news", "blog", "spam", "docs"][i % 4]
        good = {"news": i % 40 < 36, "blog": i % 40 < 37, "docs": i % 40 != 2, "spam": i % 40 < 3}[section]
        rows.append((i, f"https://h.example/{section}/{i}.html", good if i < 300 else None))
    rows += [(1000 + i, f"https://small.example/{i}", None) for i in range(5)] + [(1000, "https://small.example/0", None)]
    out = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, good boolean"), []).collect()
    assert len(out) == len(rows)
    templates = {r.template: r.verdict for r in out if r.host == "h.example"}
    spam = {t: v for t, v in templates.items() if "spam" in t}
    assert all(t.endswith("/*") for t in templates)
    assert set(spam.values()) == {"block"} and {v for t, v in templates.items() if t not in spam} == {"allow"}
    assert {(r.template, r.verdict) for r in out if r.host == "small.example"} == {("/*", "allow")}
    # purity: smoothed with the host's share, which is smoothed with that of all
    mark = [g for _, u, g in rows if g is not None]
    prior = sum(mark) / len(mark)
    host = (sum(mark) + url_filter.WEIGHT * prior) / (len(mark) + url_filter.WEIGHT)
    own = [g for _, u, g in rows if "/spam/" in u and g is not None]
    want = (sum(own) + url_filter.WEIGHT * host) / (len(own) + url_filter.WEIGHT)
    assert next(r.purity for r in out if r.template == "/spam/*") == pytest.approx(want)
    assert F is not None


def test_a_section_is_judged_whatever_its_hosts_size(spark):
    # 80 sections of 25 pages on one host, each 1.25 % of it, one of them bad; the same two sections on a small host
    rows = [(i, f"https://hot.example/s{i % 80}/{i}", i % 80 != 7) for i in range(2000)]
    rows += [(5000 + i, f"https://cold.example/s{i % 2 + 6}/{i}", i % 2 == 0) for i in range(50)]
    rows += [(9000 + i, f"https://hot.example/rare{i}/x", None) for i in range(30)]
    out = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, good boolean"), []).collect()
    assert len(out) == len(rows)
    for host in ("hot.example", "cold.example"):
        assert {r.verdict for r in out if r.host == host and r.path.startswith("/s7/")} == {"block"}
        assert {r.verdict for r in out if r.host == host and not r.path.startswith("/s7/")} == {"allow"}
    templates = {r.template for r in out if r.host == "hot.example"}
    assert templates == {"/s7/*", "/{s0|+78}/*", "/*/x"}


def test_malformed_lengths_are_corrupt():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: %s\r\n\r\nbody"
    assert warc.parsed(head % b"4")[:2] == ("response", "5")
    for bad in (b"four", b"-1", b"", b"5", b"9" * 30, "４".encode()):
        assert warc.parsed(head % bad) == warc.CORRUPT
    inner = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"
    revisit = b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner
    assert warc.parsed(revisit) == warc.CORRUPT
