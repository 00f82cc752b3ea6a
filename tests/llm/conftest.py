import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from ``(doc_id, text)`` or longer tuples."""
    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:   # names that operators use inside
            for c in ("seed", "piece", "loc", "node", "token", "part", "block", "z", "_tk", "copies", "kept", "size", "target"):
                df = df.withColumn(c, df["doc_id"].cast("string"))
        return df
    return make
