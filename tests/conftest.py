from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from braidwork.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = session(8, **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


def same_rows(df, sql: str, sf_dir: str) -> None:
    """df's rows are those of the SQL, by column name, in any order."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)
