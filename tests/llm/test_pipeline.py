"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from millrace.llm import linededup, neardup, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
            assert set(after) <= set(before)
            if name == "quality_rules":
                assert set(after) == {r.doc_id for r in quality.quality_stats(docs).filter("kept").collect()}
                assert all(before[i] == t for i, t in after.items())
            if name == "line_dedup":
                want = {r.row.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
                assert all(want[i] == t for i, t in after.items()) and all(not want[i].strip() for i in set(before) - set(after))
            if name == "near_dedup":
                comp = {r.id: r.comp for r in neardup.linked(docs.withColumnRenamed("doc_id", "id"), 5).collect()}
                assert set(after) == {i for i in before if comp[i] == i}
            if name == "redact_pii":
                assert set(after) == set(before) and not any(r.email for r in pii.find_pii(out).collect())
        docs = out
    assert docs.select("doc_id").distinct().count() == len(after)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_take_odd_rows(spark):
    """Nulls, empty texts, repeated rows, extra columns and an empty table: no stage fails, and what is defined comes out."""
    from pyspark.sql import functions as F

    good = " ".join(f"{a} {b} walked home" for a, b in zip("river stone cloud field window garden letter market".split(), "slowly gladly often twice never early later again".split()))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good + " today", "en", "s", 1), (3, None, "en", "s", 0), (4, "", None, None, 0), (5, " \n ", "de", "t", 3), (None, good + " ada@mail.org", "en", None, 9), (6, f"{good}\nwrite to ada@mail.org", None, "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = df.select("*", F.lit(1).alias("row"), F.lit("x").alias("gone"), F.lit(2).alias("id"), F.lit(3).alias("h"), F.lit(4).alias("comp"), F.lit(5).alias("kept"))
    want = {"quality_rules": 5, "line_dedup": 7, "near_dedup": 6, "redact_pii": 8, "pack": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert name == "pack" or out.columns == df.columns
        got = out.collect()
        if name == "line_dedup":  # the second line of text is new, the first is that of document 1
            assert {r.doc_id: r.text for r in got if r.doc_id in (2, 6)} == {2: good + " today", 6: "write to ada@mail.org"}
        elif name == "redact_pii":
            assert sorted(str(r.text) for r in got if "[EMAIL]" in str(r.text)) == sorted([good + " [EMAIL]", f"{good}\nwrite to [EMAIL]"])
        else:
            assert len(got) == want[name], (name, got)
        assert stage(spark, odd.limit(0), SF).count() == 0
