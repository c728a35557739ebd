import random
import zlib

import numpy as np

import corpus_pipeline
from faultline.llm.queries import vocabulary_path


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    """Planted toxic, repeated and leaked documents go, the rest ends in the token files."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    item = " ".join(word() for _ in range(20))
    toxic = [f"{a} grumf {b} blarg" for a, b in zip(clean[100:150], clean[50:100])]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean[:50])]
    rows += [(1000 + i, t, "en", "s0", len(t)) for i, t in enumerate(toxic)]
    rows += [(2000 + i, clean[i] + " tail", "en", "s1", 0) for i in range(10)]
    rows += [(3000 + i, clean[60 + i] + " " + item, "en", "s2", 0) for i in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, int(1000 <= d < 2000)) for d, *_ in rows if d < 2000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert kept <= set(range(50)) and len(kept) > 35
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    for r in got:
        ids = [*t.encode(clean[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4")))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
