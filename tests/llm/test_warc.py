import base64
import hashlib

from threatlake.llm.warc import archive_folder, coalesced, read_records, write_archives


def test_round_trip(spark):
    pages = [(i, f"http://x/{i}", f"<p>page {i % 7} é\r\n\r\nWARC/1.0</p>" * (1 + i % 3)) for i in range(50)] + [(50, None, None), (51, "u", ""), (52, "u", "x" * 300_000), (5, "http://x/5", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    folder = archive_folder(spark)
    index = write_archives(df, folder, file_bytes=2000)
    assert index.count() == len(pages) and index.select("file").distinct().count() > 4
    rows = read_records(index, folder).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, html in pages:
        first[html or ""] = min(i, first.get(html or "", i))
    want = sorted((i, u, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, u, h in pages)
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == sorted(want, key=str)
    texts = {r.page_id: r.payload for r in rows if r.record_type == "response"}
    assert texts[52] == b"x" * 300_000
    some = read_records(index.where("page_id % 10 = 3"), folder, with_payload=False)
    assert {r.page_id for r in some.collect()} == {3, 13, 23, 33, 43}


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y" * 50), (4, "d", "y" * 50)], "page_id long, url string, html string")
    folder = archive_folder(spark)
    kinds = {r.page_id: r.record_type for r in read_records(write_archives(df, folder, revisit_from=10), folder).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 500, 10), ("b", 0, 10), ("b", 10, 95)]
    assert list(coalesced(iter(rows), 100, 50)) == [("a", 0, [(0, 10), (10, 10)]), ("a", 500, [(500, 10)]), ("b", 0, [(0, 10)]), ("b", 10, [(10, 95)])]


def test_empty(spark):
    folder = archive_folder(spark)
    index = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert index.count() == 0 and read_records(index, folder).count() == 0
