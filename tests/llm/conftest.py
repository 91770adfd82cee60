from __future__ import annotations

from datetime import datetime

import pytest

ENTRY = "entry_id long, session_id string, chunk_id int, entry_key string, entry_value string, comments string, extractor string, source string, extracted_ts timestamp_ntz, received_ts timestamp_ntz"
# Columns whose names the operators use inside.
CLASH = "id long, cls string, words string, n string, key string, value string, text string, plain string, state string, g1 string"
NOW = datetime(2024, 1, 1)


@pytest.fixture
def entries(spark):
    """Entries of (id, session, key, value, comments, extractor, days) with columns of clashing names beside."""

    def make(rows):
        full = []
        for r in rows:
            i, session, key, value, comments, extractor, day = (*r, *[None] * 7)[:7]
            at = None if day is None else NOW.replace(day=day)
            full.append((i, session, 1, key, value, comments, extractor, "s", at, NOW, 7, *["x"] * 9))
        return spark.createDataFrame(full, f"{ENTRY}, {CLASH}")

    return make
