import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def docs(spark):
    """Rows -> documents table with an extra column whose name clashes with result columns."""
    def make(rows, source="src0"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else source, -7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, size long")
    return make
