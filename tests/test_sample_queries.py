"""Vectors as samples: floats just below a whole number after scaling, which single precision rounds up to it."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__


def edges(scale: int, wanted: list[int]) -> list[float]:
    """For each number a float whose product is that number in single precision and less in double."""
    out = []
    for n in wanted:
        v = np.float32(n / scale)
        near = [np.nextafter(v, np.float32(0)), v]
        out += [float(x) for x in near if np.float32(x * np.float32(scale)) == n and float(x) * scale < n][:1]
    return out


@pytest.mark.parametrize(("name", "scale", "wanted"), [("image_redact", 1000, [26, 50, 85, 100, 200, 255, 256]), ("non_white_ratio", 10000, [255 + 256 * k for k in range(20)])])
def test_samples_are_scaled_in_single_precision(spark, tmp_path, name, scale, wanted):
    found = edges(scale, wanted)
    assert found
    rows = [[0.0] * k + [v] + [0.1] * (63 - k) for k, v in enumerate(found)] + [[-v for v in found] + [0.2] * (64 - len(found))]
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).orderBy("vec_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    assert got == con.execute(f"{__spark_entry__.oracle_sql()[name]} ORDER BY 1").fetchall()
