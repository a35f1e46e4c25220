"""The stages of the pipeline and the whole of it against plain Python."""

import collections
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from webloom.llm import common  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, again int, live string, part int"
SECRET = "zQ9xV7rT2mK4pL8wN3sY6bD1"


@pytest.fixture(scope="module")
def world(tmp_path_factory, spark):
    """documents, benchmark and labels in a folder; what must be left, in plain Python."""
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("ran", "del", "vis", "pon", "gar", "hut", "mel")]
    words += [f"w{i}" for i in range(800)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(0, prose(60)), (1, prose(45)), (2, None), (3, "")]
    rows = [(i, prose(rng.randint(60, 120))) for i in range(40)]
    plain = dict(rows)
    gone = set()
    for i in range(8):  # exact and near copies of documents 0 to 7
        w = plain[i].split()
        w[rng.randrange(len(w))] = "changed"
        rows += [(100 + i, plain[i]), (200 + i, " ".join(w))]
        gone |= {100 + i, 200 + i}
    rows += [(300, prose(40) + " " + items[0][1] + " " + prose(40)), (301, items[1][1])]
    gone |= {300, 301}
    rows += [(400, f"{prose(50)} see {SECRET} there"), (401, prose(30_000))]
    rows += [(500, None), (501, ""), (502, " \n"), (None, prose(70)), (None, None), (8, plain[8]), (8, plain[8])]
    rng.shuffle(rows)
    want = collections.Counter()
    for i, t in rows:
        if i == 8 and want[i, t] or i in gone:
            continue
        want[i, (t or "").replace(SECRET, "[secret]")] += 1
    base = str(tmp_path_factory.mktemp("world"))
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(0, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, want


def test_stages(spark, world):
    base, want = world
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.schema == docs.schema, name
        docs = spark.createDataFrame(out.collect(), out.schema).repartition(2)
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect()) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())


def test_groups_without_broadcast(spark, world, monkeypatch):
    base, _ = world
    docs = spark.read.parquet(f"{base}/documents.parquet")
    few = corpus_pipeline.one_of_each_group(spark, docs, base).collect()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    many = corpus_pipeline.one_of_each_group(spark, docs, base).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, many), key=repr)


def test_whole_run(spark, world):
    base, want = world
    end = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    ids = collections.Counter()
    for (i, t), n in want.items():
        ids[i, tuple([*end.encode(t, add_special_tokens=False).ids, 1])] += n
    pieces = corpus_pipeline.run(spark, base).collect()
    assert sum(r["length"] for r in pieces) == sum(len(k[1]) * n for k, n in ids.items())
    whole = {(i, x): (np.array(x, "<u4"), n) for (i, x), n in ids.items()}
    for r in pieces:
        assert any(zlib.crc32(a[r["start"]: r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
                   for (i, _), (a, n) in whole.items() if i == r["doc_id"] and len(a) == r["doc_tokens"])


def test_empty(spark, world, tmp_path):
    base, _ = world
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{base}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
