"""The pipeline's stages on the given tables, each held against a plain version on its own input, and on odd rows."""

import re

import corpus_pipeline
from tests.llm.test_operators import plain_lines, plain_links

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(list(before.values()), docs.schema), SF)
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "mixing":
            assert set(after) == set(before)
            assert all(after[i].size == len(re.findall(r"[^\x20\x09-\x0D]+", before[i].text or "")) and 0 <= after[i].taken <= 3 * after[i].size for i in after)
            break
        assert out.columns == docs.columns
        if name == "language":
            assert len(after) >= 0.95 * len(before) and all(after[i].text == before[i].text for i in after)
        if name == "line_dedup":
            want = {i: t for i, t, *_ in plain_lines([(r.doc_id, r.text, r.source) for r in before.values()])}
            assert {i: r.text for i, r in after.items()} == want
        if name == "near_duplicates":
            ids = sorted(before)
            _, root = plain_links([before[i].text for i in ids])
            assert set(after) == {ids[r] for r in set(root)}
        if name == "decontamination":
            bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            grams = [{tuple(b[k : k + 5]) for k in range(len(b) - 4)} for b in bench]
            for i, r in before.items():
                w = r.text.lower().split()
                mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                share = max(len(g & mine) / len(g) for g in grams)
                assert share < 0.8 or i not in after
                assert share > 0.3 or i in after
        before = after


def test_odd_rows_pass_every_stage(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count()
        assert name == "mixing" or out.columns == odd.columns
        assert stage(spark, odd.filter("false"), SF).count() == 0
        odd = odd if name == "mixing" else out


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r.taken for r in rows) > 0
