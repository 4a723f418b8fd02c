import base64
import gzip
import hashlib
import os
import random

import pytest
from helpers import prose

from tablescope.llm import warc_index as W

SCHEMA = "page_id long, url string, html string, surt string, file string, key string, at long, payload string, n int"


def pages(spark, rows, parts=4):
    """With columns that clash with working names."""
    return spark.createDataFrame([(*r, "s", "f", "k", 1, "p", 2) for r in rows], SCHEMA).repartition(parts)


def case():
    r = random.Random(3)
    rows = [(k, f"http://h{r.randrange(9)}.example.com/p/{k % 70}?q={k % 3}", prose(k, 30)) for k in range(400)]
    rows += [(1000 + k, f"https://hot.example.org/{k % 4}", "the same page") for k in range(150)]  # a large group of copies
    rows += [(2000 + k, "http://hot.example.org/one", prose(k, 3)) for k in range(200)]  # one very common URL
    rows += [(1, None, None), (2, "", ""), (3, "http://a.b/", None), (None, "http://a.b/", "x"), (None, "http://a.b/", "x"), (4, "http://a.b/", "x"),
             (5, "http://u:p@WWW.Ex.com:8080/é 日本?x#frag", "é日本😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "http://a.b/\r\nX: y\tz", "inject"),
             (7, "http://a.b/7", "y" * 300_000), (8, "http://twin/", "twin"), (8, "http://twin/", "twin"), (8, "http://twin/", "twin"), (9, "http://nulls/", "nn")]
    rows += [(None, "http://nulls/", "only null ids")] * 3
    return rows


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    groups = {}
    for i, url, html in rows:
        groups.setdefault(html or "", []).append((i is not None, i or 0, url is not None, url or ""))
    out, written = [], set()
    for i, url, html in sorted(rows, key=str):
        best = max(groups[html or ""])
        is_best = best == (i is not None, i or 0, url is not None, url or "") and (html or "") not in written
        if is_best:
            written.add(html or "")
        out.append((i, len((html or "").encode()), digest(html), "response" if is_best else "revisit",
                    None if is_best or not best[0] else best[1]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("file_bytes,lines", [(W.FILE_BYTES, W.BLOCK_LINES), (20_000, 7)])
def test_archives_read_back_equal_brute_force(spark, tmp_path, file_bytes, lines):
    rows = case()
    df = pages(spark, rows)
    entries = W.write_archives(df, f"{tmp_path}/a", file_bytes)
    index = W.build_index(entries, f"{tmp_path}/i", lines)
    asked = df.select(W.reversed_host_key(W.F.col("url")).alias("surt"), "page_id")
    found = W.lookup(asked, index, f"{tmp_path}/i")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, entries.collect()), key=str)
    assert got(W.read_captures(found, f"{tmp_path}/a")) == brute(rows)


def test_archives_are_whole_warc_files(spark, tmp_path):
    rows = case()
    W.write_archives(pages(spark, rows), str(tmp_path), 30_000)
    found = []
    for name in os.listdir(tmp_path):
        data = gzip.open(tmp_path / name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            if b"WARC-Type: warcinfo" not in head:
                found.append(head)
            data = rest[n + 4:]
    assert len(found) == len(rows)
    ids = [x.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for x in found if b"X-Page-ID" in x]
    assert len(set(ids)) == len(ids)
    named = {x.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for x in found if b"WARC-Type: revisit" in x}
    assert named <= {x.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for x in found if b"WARC-Type: response" in x}


def test_lookup_by_url_alone_and_of_unknown_keys(spark, tmp_path):
    rows = case()
    entries = W.write_archives(pages(spark, rows), f"{tmp_path}/a")
    index = W.build_index(entries, f"{tmp_path}/i", 5)
    asked = spark.createDataFrame([("org,example,hot)/one",), ("org,example,hot)/one",), ("a,unknown)/",), ("zz)/",), ("",), ("b,a)/",), (None,)], "surt string")
    found = W.lookup(asked, index, f"{tmp_path}/i").collect()
    keys = {s for s, in asked.collect()}
    assert sorted(map(tuple, found), key=str) == sorted((tuple(r) for r in entries.collect() if r["surt"] in keys), key=str)
    assert len([r for r in found if r["surt"] == "org,example,hot)/one"]) == 200


def test_reversed_host_keys(spark):
    want = {"http://www.Example.com:8080/a?b#c": "com,example,www:8080)/a?b", "https://example.com": "com,example)/", "//h.x/p": "x,h)/p",
            "http://u@h.x:80?q": "x,h)/?q", "": ")/", None: "", "http://[::1]:8/x": "[::1]:8)/x", "mailto:a@b.c": "c,b)/"}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r["u"]: r["k"] for r in df.select("u", W.reversed_host_key(W.F.col("u")).alias("k")).collect()} == want


def test_a_changed_payload_is_found(spark):
    record = W.warc_record(1, "http://a/", b"payload", b"k", 0, None)
    assert W.parse_record(record)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"))
    with pytest.raises(ValueError):
        W.parse_record(record[:-4])


def test_revisits_only_from_a_least_size(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "v", "abc"), (4, "v", "abc")]
    out = got(W.archive_and_read(pages(spark, rows), str(tmp_path), least=3))
    assert [(r[0], r[3], r[4]) for r in out] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty_table(spark, tmp_path):
    assert W.archive_and_read(pages(spark, [(1, "u", "x")]).limit(0), str(tmp_path)).collect() == []
