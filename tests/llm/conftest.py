import re

import pytest


@pytest.fixture(scope="session")
def words():
    """Lower-cased words as the contracts define them."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lambda text, pattern: re.findall(pattern, (text or "").translate(lower))
