"""Lines of texts that are empty or end in line ends of any kind, as the SQL counts them."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import quarrylens.plans  # noqa: F401
from quarrylens import registry

ENDS = ["", "\n", "\n\n", "\r\n", "\r", "a", "a\n", "a\r\n", "a\n\n", "a\r\n\r\n", "a\n\r\n", "a\r", "a\r\nb", "a\r\r\nb\n", "\na", "\r\na\r\n", "a\x00b\nc", "é\nñ́\r\n", "😀\n😀", "a\x0b\n", "a\x85 b\n", None]


@pytest.mark.parametrize("name, table", [("s03_lines", "documents"), ("q07_style", "conversations")])
def test_line_ends_count_as_in_sql(spark, tmp_path, name, table):
    texts = ENDS + [f"{'x' * n}{end}" for n in (199, 200, 499, 500) for end in ("", "\n", "\r\n", "\r\n\r\n")] + [("x" * 500 + "\n") * 5 + "x" * 500 + "\r\n"]
    own = {"doc_id": range(len(texts))} if table == "documents" else {"conv_id": range(len(texts)), "turn": [1] * len(texts), "role": ["user"] * len(texts)}
    pq.write_table(pa.table({**{k: list(v) for k, v in own.items()}, "text": texts}), tmp_path / f"{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    expected = con.sql(registry.ORACLE_SQL[name]).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))
