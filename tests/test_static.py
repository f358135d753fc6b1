"""The library stays on the JVM side and off the driver."""

import re
from pathlib import Path

import pytest

PACKAGE = Path(__file__).parent.parent / "tidepane"
SOURCES = sorted(PACKAGE.rglob("*.py"))

# Bounded by a check next to the call, or a single row.
ALLOWED: dict[str, list[str]] = {}
FORBIDDEN = [
    r"\.collect\(\)", r"\.toPandas\(", r"\.rdd\b", r"localCheckpoint", r"\.crossJoin\(", r"@udf", r"F\.udf\(",
    r"\.sample\(", r"mapPartitions", r"\.foreach\(",
]


@pytest.mark.parametrize("path", SOURCES, ids=lambda p: p.name)
def test_no_driver_side_work(path):
    text = path.read_text()
    for allowed in ALLOWED.get(path.name, []):
        text = re.sub(allowed, "", text)
    for pattern in FORBIDDEN:
        assert not re.search(pattern, text), f"{pattern} in {path.name}"


def test_broadcasts_are_checked():
    """Explicit broadcasts exist only where the number of rows was counted before."""
    users = [p.name for p in SOURCES if "F.broadcast(" in p.read_text()]
    assert users == ["joins.py"]
