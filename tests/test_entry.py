"""The driver's contract: every query beside its SQL, and the engine without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).parent.parent
DATA = "/root/testdata/sf0.001"

from lexweave.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(map(tuple, df.select(*(f"`{c}`" for c in cols)).collect())) == plain(tuple(r[k] for k in at) for r in found.fetchall())


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_f1_of_the_model_by_its_tokens(spark):
    from lexweave.operators import segment as S
    from lexweave.plans import segment_queries as q
    from lexweave.plans.text_queries import lines_of
    from pyspark.sql import functions as F

    got = registry.QUERIES["model_f1"](spark, DATA).first()
    words = q._words(spark, DATA)
    plain = lines_of(spark, DATA).withColumn("line", F.translate("line", " \t", ""))
    want = S.boundary_scores(S.tokenize(plain, q.model(spark, DATA)), words, ["doc_id", "line_no"]).first()
    assert abs(got.precision - want.precision) < 1e-8 and abs(got.recall - want.recall) < 1e-8 and abs(got.f1 - want.f1) < 1e-8 and 0.1 < got.f1 < 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "line_no", "n_tokens", "tokens_md5", "score"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_data_operators(tmp_path):
    shutil.copytree(REPO / "lexweave", tmp_path / "lexweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
