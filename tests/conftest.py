import os
import sys
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

TS = pa.timestamp("us")
#: Schemas of the tables that the tests write.
SCHEMAS = {
    "crawl_run": {"run_id": pa.string(), "job_id": pa.string(), "config_version": pa.int32(), "started_at": TS, "finished_at": TS, "status": pa.string(), "pages_fetched": pa.int32(), "pages_extracted": pa.int32(), "error": pa.string()},
    "extracted_record": {"record_id": pa.string(), "run_id": pa.string(), "page_url": pa.string(), "template_id": pa.string(), "record_index": pa.int32(), "payload": pa.string(), "confidence": pa.float64(), "extracted_at": TS},
    "strategy_config": {"job_id": pa.string(), "version": pa.int32(), "payload": pa.string(), "created_by": pa.string(), "created_at": TS, "last_validated": TS, "reason": pa.string()},
    "outcomes": {"outcome_id": pa.int64(), "page_id": pa.int64(), "source_url": pa.string(), "value": pa.string(), "value_type": pa.string(), "raw_text": pa.string()},
    "pages": {"page_id": pa.int64(), "url": pa.string(), "cleaned_html": pa.string(), "status": pa.int32()},
    "site": {"host": pa.string(), "lang": pa.string(), "time_zone": pa.string(), "date_order": pa.string()},
    "documents": {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()},
    "benchmark": {"item_id": pa.int64(), "text": pa.string()},
}
#: Columns that the operators use inside; a table that has them already must not disturb them.
CLASH = {n: pa.string() for n in ("bucket", "kh", "vh", "seq", "series", "host", "row", "h", "t", "s", "r", "tbl", "item_id2", "kind", "size", "runs", "f", "word", "ids", "n")}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def tables(tmp_path):
    """Writes tables from lists of dicts, with clashing extra columns; those that are not given are empty."""

    def write(**given):
        for name, schema in SCHEMAS.items():
            rows = given.get(name, [])
            schema = dict(schema) | {k: v for k, v in CLASH.items() if k not in schema}
            cols = {c: pa.array([r.get(c, "x" if c in CLASH and c not in SCHEMAS[name] else None) for r in rows], type=kind) for c, kind in schema.items()}
            pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2025, 1, day, hour)
