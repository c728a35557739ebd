from faultline.llm.queries import op6_decontaminate

TEXTS = "doc_id long, text string"


def test_short_benchmark_items_are_found(spark, tmp_path):
    """Items of 1 to 7 tokens exactly, those of 8 to 12 with one token replaced."""
    sizes = (1, 5, 7, 8, 10, 12)
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n))) for n in sizes]
    docs = [(n, t) for n, t in items] + [(100 + n, f"a b {t} c") for n, t in items]
    for n, t in items:
        for at in range(n):
            w = t.split()
            w[at] = "other"
            docs.append((1000 * n + at, "before " + " ".join(w)))
    docs.append((9_000_000, "before " + items[-1][1].replace("t12x1 ", "no ").replace("t12x7 ", "no ")))
    spark.createDataFrame(docs, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op6_decontaminate(spark, str(tmp_path)).collect()}
    want = {(d, n) for n in sizes for d in (n, 100 + n)} | {(1000 * n + at, n) for n in (8, 10, 12) for at in range(n)}
    assert got == want
