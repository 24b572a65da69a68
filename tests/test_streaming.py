"""Packages that arrive are taken up once."""

from rillgraph.sources import cgf
from rillgraph.streaming.incremental import follow
from tests.test_sources import function, iid, packages


def test_arrivals(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "0.pb").write_bytes(cgf.encode(packages()[0]))
    run = lambda: follow(spark, str(folder), out, str(tmp_path / "ck")).awaitTermination()
    run()
    assert [r.iid for r in spark.read.parquet(out).collect()] == [iid(1)]
    (folder / "1.pb").write_bytes(cgf.encode({"repo": "x", "functions": [packages()[0]["functions"][0], function(5, "new.F")]}))
    run()
    run()
    assert sorted(r.iid for r in spark.read.parquet(out).collect()) == [iid(1), iid(5)]
