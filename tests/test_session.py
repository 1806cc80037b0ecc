import pytest

from offerscope import session


def test_staged_tables_keep_types_and_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_STAGED", [])
    df = spark.createDataFrame([("a", 1, [1.0]), ("b", None, None)], "k string, day int, x array<double>")
    staged = session.stage(df, "t", ("day",))
    assert staged.schema == df.schema and sorted(r["k"] for r in staged.collect()) == ["a", "b"]
    (path,) = session._STAGED
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.release_staged(spark) == 1 and session._STAGED == []
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_runtime_settings(spark):
    assert session.tune(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def test_workers_do_not_need_the_package(tmp_path):
    """Run the Python-side operators from a folder where the package cannot be imported."""
    import subprocess
    import sys
    from pathlib import Path

    from conftest import SF_DIR

    root = Path(__file__).resolve().parent.parent
    script = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as entry
from offerscope.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
    "spark.checkpoint.dir": {str(tmp_path / "staging")!r}}})
for name in ("thompson_choice", "stream_attribution"):
    assert entry.queries()[name](spark, {SF_DIR!r}).count() > 0, name
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_rounds_are_read_by_many_tasks(spark, monkeypatch):
    from conftest import SF_DIR
    from pyspark.sql import functions as F

    from offerscope.plans import campaign

    monkeypatch.setattr(campaign, "FILE_ROWS", 7)
    c = campaign.Campaign.from_parquet(spark, SF_DIR)
    for table in (c.staged_contexts, c.design):
        files = table.groupBy("round_day", F.input_file_name()).count()
        assert 1 < files.agg(F.max("count")).first()[0] <= 7
    assert c.design.count() == c.staged_contexts.count() == c.opps.count()
