import pytest


@pytest.fixture
def near_texts():
    """Words by number, so that edits are easy to state."""

    def make(*ranges):
        return " ".join(f"w{i}" for r in ranges for i in r)

    return make
