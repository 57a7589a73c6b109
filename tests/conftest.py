from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from checks.verify import session

    return session("4")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.fixture
def patients(spark):
    rows = [
        ("PAT1", " Rosa ", "Lind", "1990-02-03", "female", "+1 (555) 0100", " Rosa@Mail.org", "1 Elm", "INS1", "2024-01-01 10:00:00", "2024-06-01 10:00:00"),
        ("PAT2", "Omar", "Vance", "1985-07-09", "Male", "555-0101", "omar@mail.org", "2 Oak", "INS2", "2024-01-02 10:00:00", "2024-06-02 10:00:00"),
        ("PAT2", "Omar", "Vance", "1985-07-09", "Male", "555-0199", "omar@mail.org", "2 Oak", "INS2", "2024-01-02 10:00:00", "2024-07-01 10:00:00"),
        ("PAT3", None, "Quist", "not a day", "robot", "555-0102", "no-at-sign", "3 Ash", "INS3", "2024-01-03 10:00:00", "2024-06-03 10:00:00"),
        (None, "No", "Key", "1999-01-01", "Other", "1", "a@b.c", "4 Fir", "INS4", "2024-01-03 10:00:00", "2024-06-03 10:00:00"),
        ("  ", "Blank", "Key", "1999-01-01", "Other", "1", "a@b.c", "4 Fir", "INS4", "2024-01-03 10:00:00", "2024-06-03 10:00:00"),
    ]
    from lamina.contracts import ENTITIES

    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITIES["patients"].columns))
