import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")  # the workers of a local session share its cores
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")


@pytest.fixture
def write_tables(tmp_path):
    """Writes frames as the tables of a folder and returns its path."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
