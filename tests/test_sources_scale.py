"""Sources: files that no parser takes, and the size of what a worker gives at once."""

import pyarrow as pa
import pytest

from recallgrid.sources import chunks, parsers, web

ODD = {"a.py": "(" * 5000 + ")" * 5000, "b.yaml": "a: 2024-13-45", "c.yaml": "&a [*a]", "d.yaml": "a: {2024-01-01: 1}", "e.csv": 'h\n"' + "long words " * 20000, "f.csv": "a,b\rhello there,word\r", "i.json": '{"paths": 3, "swagger": 1}', "chrome_history.json": '{"Browser History":[{"url":"x","title":"t","time_usec":1e30}]}'}


@pytest.mark.parametrize("path", sorted(ODD))
def test_files_that_parsers_reject_are_chunked_all_the_same(path):
    assert parsers.chunk(path, ODD[path])


def test_half_characters(spark):
    f = spark.createDataFrame([("a.json", '{"a": "\\ud800 b"}')], "path string, content string")
    assert [r.content for r in chunks.chunk_files(f).collect()] == ['"a": "� b"']


def test_batches_are_bounded():
    rows = [(i, "x" * 1000) for i in range(5000)]
    got = list(chunks.batched(iter(rows), pa.schema([("i", pa.int64()), ("t", pa.string())]), 2000, 1 << 20))
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns))] == rows
    assert max(b.num_rows for b in got) <= 1049 and list(chunks.input_rows(got)) == rows


def test_a_batch_of_pages_gives_several_batches(spark):
    pages = spark.range(50).selectExpr("id AS page_id", "'http://a.org' AS url", "repeat('<p>some words of a page.</p>', 100) AS html").coalesce(1)
    files = chunks.chunk_files(pages.selectExpr("concat(page_id, '.html') AS path", "html AS content"))
    assert files.count() == 5000
    assert web.articles(pages).count() == 50
