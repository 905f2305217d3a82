"""Every registered query against its SQL on the small tables."""

import __spark_entry__ as entry
import oracle
import pytest


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(entry.CORPUS_ORACLES) - {"pipeline"}))
def test_query_equals_sql(spark, con, folder, name):
    assert oracle.difference(spark, con, name, folder) is None


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry.CORPUS_QUERIES) - {"pipeline"}
    assert own == set(entry.oracle_sql()) - set(entry.CORPUS_ORACLES) - {"pipeline"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["keyword", "total", "high_compat", "medium_compat", "low_compat"]
    assert df.count() > 0


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The folder and the pipeline may be gone."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['postloom.llm'] = None; sys.modules['corpus_pipeline'] = None; "
        "import __spark_entry__ as e; names = set(e.queries()); "
        "assert 'keyword_quality' in names and not [n for n in names if n.startswith('op') and n[2:3].isdigit()]; "
        "assert 'pipeline' not in names and names == set(e.oracle_sql())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
