import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["sensor_id", "bucket_ms", "avg_value", "min_value", "max_value", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage still imports and registers the other queries."""
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and part.parts[0] != "tests":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'latest_single' in q and not any(k.startswith('op') for k in q); assert len(e.oracle_sql()) > 40 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_scratch_tables_can_be_cleared(spark):
    from gaugeworks.storage import _own_dir, clear, cut

    df = cut(spark.range(5), "numbers")
    assert df.count() == 5 and _own_dir(spark) in df.inputFiles()[0]
    clear(spark)
    assert not Path(_own_dir(spark)).exists()
