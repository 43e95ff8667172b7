import hashlib

import pytest
from pyspark.sql import functions as F

from moundworks.llm import warc

BIG = "<p>" + "same page " * 40 + "é</p>"
ROWS = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (3, None, BIG), (9, "http://a/9", BIG), (1, "http://b", "small"), (2, "http://b\r\nx", "small"),
        (4, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 30), (8, "v", "long " * 200_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, file int")
    found = warc.archive_round_trip(pages).collect()
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        revisit = html == BIG and page != 3
        want.append(repr((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, b"" if revisit else raw)))
    assert sorted(repr((*tuple(r)[:5], bytes(r.body))) for r in found) == sorted(want)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_selected_records_and_coalescing(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(200)], "page_id bigint, url string, html string").coalesce(2)
    index = warc.write_archives(warc.with_first_seen(pages, "page_id", "url", "html"), f"file://{tmp_path}/w")
    some = index.filter(F.col("page_id").cast("int") % 10 == 0)
    found = warc.read_records(some, f"file://{tmp_path}/w").collect()
    assert sorted(int(r.page_id) for r in found) == list(range(0, 200, 10))
    assert all(bytes(r.body).decode() == f"page {r.page_id} " * 50 and r.url == f"http://x/{r.page_id}" for r in found)


def test_ranges_join_over_small_gaps():
    ranges = [(0, 10), (10, 5), (40, 5), (1000, 5), (1005, 20)]
    assert warc.coalesced(ranges, max_gap=25, max_read=100) == [[(0, 10), (10, 5), (40, 5)], [(1000, 5), (1005, 20)]]
    assert warc.coalesced(ranges, max_gap=5, max_read=12) == [[(0, 10)], [(10, 5)], [(40, 5)], [(1000, 5)], [(1005, 20)]]
    assert warc.coalesced([]) == []


def test_ids_of_any_content(spark):
    ids = ["", None, "a\r\nb", "a b", "<urn:page:x>", "é%41", "\n", "x: y", "z" * 300]
    same = "s" * 200
    pages = spark.createDataFrame([(k, "http://h/\r\nX: 1", f"<p>{k}</p>") for k in ids] + [(f"{k}'", None, same) for k in ids if k is not None], "page_id string, url string, html string")
    found = warc.archive_round_trip(pages).collect()
    assert sorted(map(repr, (r.page_id for r in found))) == sorted(map(repr, (r.page_id for r in pages.collect())))
    first = min(f"{k}'" for k in ids if k is not None)
    again = [r for r in found if r.payload_bytes == 200]
    assert {r.page_id: r.refers_to for r in again} == {f"{k}'": None if f"{k}'" == first else first for k in ids if k is not None}


def test_paths_without_a_scheme_mean_the_default_file_system(spark, tmp_path):
    from moundworks.sources import store
    assert store.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    fs, root = store.open_folder(store.qualified(spark, str(tmp_path)))
    assert fs.type_name == "local" and root == str(tmp_path)
    with pytest.raises(ValueError):
        store.open_folder(str(tmp_path))
