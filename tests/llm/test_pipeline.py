import random

import numpy as np

import corpus_pipeline
from emberline.llm import packing, simhash
from tests.llm import edge

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER).cache())
        if name != "packing":
            assert seen[-1].columns == docs.columns, name
    clean, single, cut, mixed, packed = seen[1:]
    assert 0 < clean.count() < docs.count()
    fps = np.array([simhash.prints((r["text"] or "").encode(), 5, 42, 8) for r in single.collect()])
    far = np.bitwise_count(fps[:, None] ^ fps[None]).min(axis=2)
    assert (far[np.triu_indices(len(fps), 1)] > 4).all()
    assert cut.count() == single.count() and cut.where("n_chars != char_length(text)").count() == 0
    strings = [t[i : i + 200] for t in ((r["text"] or "").encode() for r in single.collect()) for i in range(max(0, len(t) - 199))]
    assert len(strings) != len(set(strings))  # there was something to cut
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times.values()) <= {1, 2}
    encode = packing.encoder(*packing.default_paths())
    want = sum(len(encode(r["text"] or "")) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed.collect()) == want


def test_stages_take_awkward_and_empty_documents(spark):
    for docs in (edge.docs(spark).select(*[c.split()[0] for c in edge.COLUMNS.split(", ")]), edge.docs(spark, empty=True)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER).cache()
            docs.count()


def test_repeated_rows_are_kept_once(spark):
    texts = [edge.words(random.Random(i), 60) for i in range(100, 104)]
    one = (50, texts[0], "en", "s1", 1)
    rows = [
        *([one] * 3),  # ingested three times
        (50, texts[1], "en", "s1", 1),  # another text of that doc_id
        *([(None, texts[2], "en", "s1", 1)] * 2),  # a component of null ids alone
        (None, texts[2], None, "en", 1),
        (None, texts[2], "en", None, 1),
        (None, texts[3], "en", "s1", 1),  # linked to a document with an id
        (60, texts[3], "en", "s1", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    single = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).cache()
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in single.collect())
    assert got == sorted([(50, texts[0]), (50, texts[1]), (0, texts[2]), (60, texts[3])])
    assert sorted(r["text"] for r in corpus_pipeline.cut_repeats(spark, single, FOLDER).collect()) == sorted(texts)
