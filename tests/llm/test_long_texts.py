"""Very long texts, null ids and repeated rows, operator by operator."""

import collections
import hashlib
import zlib

import numpy as np

from faultline.llm import chat, decontam, mixing, tokenbin, warc
from faultline.llm.queries import vocabulary_path

TEXTS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}é" for i in range(150_000))
ITEM = " ".join(f"item{i}" for i in range(15))


def test_contamination_deep_in_a_long_text(spark):
    rows = [(1, f"{LONG} {ITEM} {LONG}"), (2, LONG), (None, ITEM), (None, "clean"), (3, ITEM), (3, ITEM), (None, None)]
    bench = spark.createDataFrame([(7, ITEM), (None, "other words than any of the texts above would ever hold in a row of thirteen")], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, TEXTS), bench)
    assert sorted((r.doc_id or -1, r.item_id, r.matched_words, r.places) for r in got.collect()) == [(-1, 7, 15, 1), (1, 7, 15, 1), (3, 7, 15, 1)]
    kept = decontam.decontaminate(spark.createDataFrame(rows, TEXTS), bench).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(2, LONG)]


def test_a_long_text_is_mixed_whole(spark):
    rows = [(i, "a b c", "s") for i in range(50)] + [(100, LONG, "t"), (None, "x y", "t"), (None, "x y", "t"), (101, None, None)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.doc_id is not None}
    assert got[100]["size"] == 150_000 and got[100].taken in (0, 150_000, 300_000) and got[101].taken == 0


def test_a_long_text_becomes_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    rows = [(1, LONG), (None, "x" * 300_000), (2, LONG), (2, LONG)]
    want = collections.Counter((d, len(i), zlib.crc32(np.array(i, "<u4"))) for d, x in rows for i in [[*t.encode(x, add_special_tokens=False).ids, 2]])
    got = tokenbin.token_binary(spark.createDataFrame(rows, TEXTS), vocabulary_path()).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_other_vocabularies_are_left_to_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(["Don't  STOP\n now", "it's 12 3x", "", None, "É  é ﬁ"])]
    got = {r.doc_id: r.n_tokens for r in tokenbin.token_binary(spark.createDataFrame(rows, TEXTS), path, None).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    assert not tokenbin.UnitEncoder(path).cuts and tokenbin.UnitEncoder(vocabulary_path()).cuts


def test_long_pages_are_archived_and_split(spark, tmp_path, monkeypatch):
    pages = [(i, f"u{i}", LONG + str(i % 3)) for i in range(6)] + [(9, None, None)]
    path = f"file://{tmp_path}/a/w"
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archive(df.coalesce(1), path)
    (tmp_path / "a").rename(tmp_path / "b")  # names in the manifest are relative
    path = f"file://{tmp_path}/b/w"
    got = {r.page_id: r for r in warc.read_archive(spark, path, verify=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {0: ("response", None), 1: ("response", None), 2: ("response", None), 3: ("revisit", 0), 4: ("revisit", 1), 5: ("revisit", 2), 9: ("response", None)}
    assert got[0].payload == bytearray((LONG + "0").encode()) and got[9].payload == bytearray()

    monkeypatch.setattr(warc, "SPLIT_BYTES", 200)
    for packed in ("gzip", "none"):
        writer = warc.WarcWriter({"path": f"{tmp_path}/{packed}", "compression": packed})
        import pyarrow as pa

        rows = [{"record_id": None, "record_type": "response", "page_id": i, "target_uri": "u", "payload_digest": hashlib.sha256(b"x" * 300).hexdigest(), "payload_bytes": 300, "refers_to": None, "payload": b"x" * 300} for i in range(20)]
        writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)]))])
        from pyspark.sql.types import LongType, StructField, StructType

        reader = warc.WarcReader(StructType([StructField("page_id", LongType())]), {"path": f"{tmp_path}/{packed}", "verify": "true"})
        parts = reader.partitions()
        assert len(parts) > 5 and [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()] == list(range(20))


def test_a_long_conversation_is_formatted(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + "<|im_end|>"), (1, 1, "assistant", LONG + "<|im_end|>"), (None, None, None, None)]
    got = {r.conv_id: r for r in chat.read_formatted(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])
    loss = rows[1][3] * 2
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
