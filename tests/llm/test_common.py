import pyarrow as pa

from tessera.llm.common import map_arrow


def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])


def test_batches_are_bounded_by_bytes(spark):
    """Many long texts come in many batches, and all of them come; a text beyond the bound comes whole."""
    got = map_arrow(spark.range(0, 300, 1, 1).selectExpr("id", "repeat('x', 100000) AS text"), sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 300
    assert max(r.bytes for r in got) < 4_000_000
    got = map_arrow(spark.range(0, 3, 1, 1).selectExpr("id", "repeat('y', 9000000) AS text"), sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 3 and max(r.bytes for r in got) >= 9_000_000
