"""Every registered query of the library's own operators against its SQL, on whole tables."""

import duckdb
import pytest

from vecroute.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((norm(tuple(r)) for r in df.collect()), key=repr)
    assert got
    if name not in registry.ORACLE_SQL:
        return
    found = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((norm(tuple(r[names.index(c)] for c in df.columns)) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_imports_without_the_training_data_parts():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['vecroute.llm'] = None; "
        "import __spark_entry__ as e; q = e.queries(); assert 'knn_euclidean' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True)


def test_a_missing_library_is_no_removed_part():
    import subprocess
    import sys

    pytest.importorskip("vecroute.llm")
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode and "zstandard" in done.stderr
