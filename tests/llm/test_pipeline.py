import array
import zlib

import numpy as np

import corpus_pipeline
from morphspark.llm import common, toxicity, tokens
from tests.llm.test_operators import SF, brute_similarities, brute_substring


def test_pipeline_by_stage(spark):
    """Every stage on its predecessor's output, held against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert after.keys() <= before.keys()
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert after.keys() == {i for i in before if not scores[i]}
        elif name == "near_duplicates":
            ids = sorted(before)
            sim = brute_similarities([before[i].text or "" for i in ids])
            kept = np.array([i in after for i in ids])
            assert not (sim[kept][:, kept] >= 0.801).any()
            gone = np.flatnonzero(~kept)
            assert all((sim[k] >= 0.799).any() or any((before[j].text or "") == (before[ids[k]].text or "") for j in after) for k in gone)
        elif name == "substring_dedup":
            assert after.keys() == before.keys()
            for i, want in zip(sorted(before), brute_substring([before[i].text for i in sorted(before)])):
                assert len((before[i].text or "").split()) - len((after[i].text or "").split()) == want[1]
                assert want[1] or after[i] == before[i]
        elif name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = {i for i, r in before.items() if any(x in " ".join((r.text or "").lower().split()) for x in items)}
            assert after.keys() == before.keys() - leaks
        else:
            rows = docs.collect()
            enc = tokens.Encoder(tokens.vocabulary())
            ids = {i: enc.encode(r.text or "") + array.array("I", [1]).tobytes() for i, r in before.items()}
            assert sum(r.length for r in rows) == sum(len(x) // 4 for x in ids.values())
            assert all(zlib.crc32(ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32 for r in rows)
    assert rows


def test_stages_take_odd_tables(spark):
    """Each stage takes nulls in any column, empty and repeated rows, columns of clashing names, and an empty table."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(1, "same words here " * 20, "en", "a", 5, 1, "x"), (1, "same words here " * 20, "en", "a", 5, 1, "x"), (None, None, None, None, None, None, None), (3, "", "", "", 0, None, "y"), (4, "w" * 50_000, "en", None, None, 2, None), (5, "one two", None, "a", 7, 3, "z")]
    names = "`__th` int, `__root` string"
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    assert labels.count()
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            if name == "packing":
                assert sum(r.length for r in out.collect()) >= d.count()
            else:
                assert out.columns == d.columns and out.count() == {"near_duplicates": 4}.get(name, 6) * (d is docs)
