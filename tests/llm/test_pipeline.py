import random
import zlib

import corpus_pipeline as pipeline
import public_tokenizers
from test_learners import corpus

from umbra.llm import op2_byte_bpe


def test_stages(spark, tmp_path):
    rows = [list(r) for r in corpus(700, seed=9)]
    rng = random.Random(1)
    item = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(k % 3) * 0 for k in range(30))
    good = [k for k, r in enumerate(rows) if r[2] and not r[3] and k >= 500]
    leak, copy = good[:5], good[5:10]
    for k in leak:
        rows[k][1] += "\n" + item
    for k in copy:
        rows.append([10_000 + k, rows[k][1] + " oneword", 1, 0])
    tables = {
        "documents": ([(r[0], r[1], "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(r[0], r[2], r[3]) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item)], "item_id long, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert name == "encode" or docs.columns == columns
        docs.write.parquet(f"{tmp_path}/out/{k}")
        docs = spark.read.parquet(f"{tmp_path}/out/{k}")
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
    truth = {r[0]: r for r in rows}
    assert counts[0] == {i for i, r in truth.items() if r[2]}
    wrong = {i for i in counts[0] if bool(truth[i][3]) == (i in counts[1])}
    assert len(wrong) <= 0.02 * len(counts[0]) and all(zlib.crc32(str(i).encode()) % 5 == 0 or i >= 500 for i in wrong)
    assert counts[1] - counts[2] == {10_000 + k for k in copy if 10_000 + k in counts[1] and k in counts[1]}
    assert counts[2] - counts[3] == set(leak) & counts[2] and counts[4] == counts[3]
    assert all(r.restored for r in docs.collect())
    codec = op2_byte_bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert all(codec.decode(bytes(r.ids_le)) == truth[r.doc_id][1].encode() for r in docs.collect())
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == counts[4]


def test_rows_without_ids_and_empty_tables(spark, tmp_path):
    text = " ".join(f"w{k % 17}x{k}" for k in range(40))
    item = "eleven quick foxes jump over one lazy dog near the old mill pond again"
    rows = [(None, text, "e"), (None, text, "e"), (None, None, "e"), (None, None, "f"), (5, "short", "e"), (5, "short", "e"), (7, text + " more", "e"), (None, "so " + item, "e"), (None, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted([("7", text + " more"), ("5", "short"), ("5", "short"), ("None", ""), ("None", ""), ("None", "so " + item)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.decontaminate(spark, docs, str(tmp_path)).count() == len(rows) - 1
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
