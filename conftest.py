import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from verdigris.paths import on_workers

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    on_workers(s)
    return s


def compared(spark, query, sql, folder):
    """Rows of a query and of its SQL, as sorted text."""
    from pathlib import Path as P

    import duckdb

    con = duckdb.connect()
    for f in P(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = query(spark, folder)
    cols = sorted(df.columns)
    norm = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    ours = norm(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = con.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall()
    return ours, norm(theirs)
