"""A table that is a folder of Parquet files arrives whole in the streams, as one that is a single file does."""

import glob
import shutil

import pytest

from webloom.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The same rows twice: tables in several files, and in one file each."""
    top = tmp_path_factory.mktemp("tables")
    pages = [(i, f"http://h{i % 3}.example.org/en/{i % 4}", f"<html><body><h1>t{i}</h1><a href='/x{i}'>a</a></body></html>") for i in range(12)]
    docs = [(i, f"text {i % 7}", "en", "s") for i in range(12)]
    both = {"pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
            "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")}
    (top / "one").mkdir()
    for name, rows in both.items():
        rows.repartition(3).write.parquet(f"{top}/many/{name}.parquet")
        rows.coalesce(1).write.parquet(f"{top}/parts/{name}")
        shutil.copy(glob.glob(f"{top}/parts/{name}/part-*.parquet")[0], top / "one" / f"{name}.parquet")
    return top


@pytest.mark.parametrize("stream,batch", [("stream_classify_parse", "page_results"), ("stream_page_cache", "page_cache_latest"),
                                          ("stream_content_dedup", "content_dedup")])
def test_streams_read_folders(spark, tables, stream, batch):
    queries = catalog.queries()

    def rows(name, of):
        got = queries[name](spark, f"{tables}/{of}")
        got = got.select("id_hash", "body_chars") if batch == "content_dedup" else got
        return sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=str)

    want = rows(batch, "many")
    assert want and rows(stream, "many") == want
    assert rows(stream, "one") == want
