import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def texts(small) -> list[str]:
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{small}/documents.parquet", columns=["text"]).column("text").to_pylist()]
