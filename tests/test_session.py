import os
from types import SimpleNamespace

from tarnbeck import session
from tarnbeck.session import materialize, remove, scratch_dir, shared_dir, spread


class Named(SimpleNamespace):
    def __init__(self, app, **conf):
        super().__init__(conf=conf, sparkContext=SimpleNamespace(applicationId=app))


def test_the_named_folder_is_read_from_the_session(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(session.atexit, "register", lambda *_: None)
    named = Named("app-1", **{"spark.checkpoint.dir": f"file://{tmp_path}/"})
    assert shared_dir(named) == shared_dir(named) == f"file://{tmp_path}/tarnbeck-app-1"
    os.makedirs(tmp_path / "tarnbeck-app-1" / "x")
    session._clear(shared_dir(named))
    assert os.listdir(tmp_path) == []
    own = shared_dir(Named("app-2"))
    assert own.startswith("file:///") and os.path.isdir(own.removeprefix("file://"))
    session._clear(own)
    assert not os.path.exists(own.removeprefix("file://"))


def test_tables_go_to_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    df = materialize(spark.range(3).selectExpr("id", "cast(null as string) s"), "part")
    assert [p.startswith("part-") for p in os.listdir(tmp_path)] == [True]
    assert df.count() == 3 and df.columns == ["id", "s"]
    folder = scratch_dir(spark, "work")
    materialize(df, "inner", folder)
    assert len(os.listdir(tmp_path)) == 2
    remove(spark, folder)
    assert len(os.listdir(tmp_path)) == 1


def test_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 9)
    assert spread(many) is many
