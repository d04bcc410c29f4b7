import hashlib

import numpy as np
import pytest

from sparkassay.llm import warc
from sparkassay.llm.files import write_file

BODY = "<p>" + "shared " * 40 + "</p>"
FALSE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def wanted(rows):
    out, first = [], {}
    for key, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and key is not None:
            first[body] = min(first.get(body, key), key)
    for key, _, html in rows:
        body = (html or "").encode()
        ref = first.get(body) if first.get(body) != key else None
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def read(spark, rows, folder, block):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS k", "3 AS first")
    warc.write_archives(pages.repartition(2), folder)
    found = warc.read_archives(spark.read.parquet(f"{folder}/list"), block=block).collect()
    number = lambda x: int(x[9:]) if x and x != "urn:page:" else None
    for r in found:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    return sorted(
        ((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in found), key=str
    )


ROWS = [(i, f"http://a/{i}", f"<p>page {i}</p>" * (1 + i % 7)) for i in range(60)]
ROWS += [(100 + i, "http://b c/\né", BODY) for i in range(9)] + [(3, "http://twice", "<p>page 3</p>" * 4), (104, "http://x", BODY)]
ROWS += [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", FALSE * 3 + BODY), (None, "u", BODY)]


def test_round_trip_over_many_blocks(spark, folder):
    for block in (200, 1000, 1 << 22):
        assert read(spark, ROWS, f"{folder}/{block}", block) == wanted(ROWS)


def test_empty(spark, folder):
    assert read(spark, [], folder, 1000) == []


def test_magic_in_a_payload_is_no_record(spark, folder):
    body = (FALSE * 200).encode()
    one = warc.record_bytes(1, None, body, hashlib.sha256(body).hexdigest(), None)
    two = warc.record_bytes(2, None, b"x", hashlib.sha256(b"x").hexdigest(), None)
    write_file(f"{folder}/one.warc", one, two)
    files = spark.createDataFrame([(f"{folder}/one.warc", len(one) + len(two))], "path string, length long")
    for block in (64, 500, 1 << 20):
        found = warc.read_archives(files, block=block, payload=False).collect()
        assert sorted((r["record_id"], r["payload_bytes"]) for r in found) == [("urn:page:1", len(body)), ("urn:page:2", 1)]


def test_links_leave_the_block():
    record = lambda n: warc.record_bytes(n, None, b"y" * 50, "d", None)
    data = b"".join(map(record, range(5)))
    own, leaves = warc.candidates(data, 1000, len(data))
    assert len(own) == 5 and (leaves == 1000 + len(data)).all() and own[0] == 1000
    assert np.diff(own).tolist() == [len(record(n)) for n in range(4)]


def test_headers_of_any_length(spark, folder):
    rows = [(i, "data:," + "x y" * 70_000 if i % 7 == 3 else f"http://a/{i}", f"<p>page {i}</p>" * 9) for i in range(20)]
    for block in (5000, 1 << 22):
        assert read(spark, rows, f"{folder}/{block}", block) == wanted(rows)


def test_a_chain_that_breaks_is_an_error(spark, folder):
    one = warc.record_bytes(1, None, b"x", "d", None)
    write_file(f"{folder}/one.warc", one, b"lost", one)
    files = spark.createDataFrame([(f"{folder}/one.warc", 2 * len(one) + 4, 2)], "path string, length long, records long")
    with pytest.raises(ValueError, match="one.warc"):
        warc.read_archives(files)
    assert warc.read_archives(files.drop("records")).count() == 1
