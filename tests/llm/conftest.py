import zlib

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest test tables."""
    return "/root/testdata/sf0.001"


def held(doc_id, mod, rest=2):
    return zlib.crc32(str(doc_id).encode()) % mod == rest
