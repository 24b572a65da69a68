"""The pipeline's stages on a small corpus with planted cases."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_operators import docs, labelled, words


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(11)
    d, y = labelled(spark, "toxic")
    y.write.parquet(str(tmp_path / "labels.parquet"))
    base = words(rng, 80)
    planted = docs(spark, [base, base, base + " end", "mail ann.7@x.org " + words(rng, 20)], [9001, 9002, 9003, 9004])
    d.unionByName(planted).write.parquet(str(tmp_path / "documents.parquet"))
    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        table.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen[name] = table
    toxic = {r.doc_id for r in y.where("toxic = 1").collect()}
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert len(kept & toxic) <= 0.05 * len(toxic) and len(kept) >= 0.97 * (804 - len(toxic))
    unique = {r.doc_id for r in seen["jaccard"].collect()}
    assert unique & {9001, 9002, 9003} == {9001} and unique >= kept - {9002, 9003}
    masked = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert set(masked) == unique and "ann.7@" not in masked[9004] and re.match(r"mail [a-z]{3}\.\d@x\.org ", masked[9004])
    assert {r.doc_id for r in seen["mixing"].collect()} == unique and seen["mixing"].columns == pipeline.COLUMNS
    assert {r.doc_id for r in seen["packing"].collect()} == unique
    assert pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_sequences_follow_the_schedule(spark, tmp_path):
    import random

    rng = random.Random(12)
    # Lengths go with sources, so that an order by length would part the sources.
    of = {"src0": (8, 1500), "src1": (2, 40), "src2": (3, 300)}
    rows = [(s, words(rng, n)) for s, (shares, n) in of.items() for _ in range(shares * 3 * 65536 // (n * 5))]
    rows = [(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = pipeline.mixing(spark, table, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    for ordered in (spark.read.parquet(str(tmp_path / "mixed")), pipeline.written(mixed)[0]):
        got = pipeline.packing(spark, ordered, "").toPandas()
        assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all() and len(set(got.doc_id)) == len(rows)
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 4096
        got["source"] = [rows[i][3] for i in got.doc_id]
        for part in (0.2, 0.4, 0.6, 0.8):
            head = got[got.sequence_id < part * (got.sequence_id.max() + 1)]
            shares = head.groupby("source").length.sum() / head.length.sum()
            assert all(abs(shares.get(s, 0) - of[s][0] / 13) < 0.08 for s in of), (part, shares)


def test_odd_tables_pass_all_stages(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    same = "one two three four five six seven"
    rows = [(1, same), (1, same), (1, "eight nine ten eleven twelve"), (2, same), (None, same), (None, "only here without any id"), (3, None), (3, None), (4, ""), (5, "w " * 4000)]
    odd = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    for name, table in (("odd", odd), ("none", odd.where("false"))):
        folder = tmp_path / name
        table.withColumn("score", F.lit("clash")).write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        table = spark.read.parquet(str(folder / "documents.parquet"))
        kept = sorted((r.doc_id or 0, r.text or "") for r in pipeline.jaccard(spark, table, "").collect())
        if name == "odd":
            assert kept == sorted([(1, same), (1, rows[2][1]), (0, rows[5][1]), (3, ""), (3, ""), (4, ""), (5, rows[9][1])])
        assert pipeline.run(spark, str(folder)).agg(F.count("*")).first()[0] >= len(kept)
