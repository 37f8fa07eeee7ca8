import os

import pytest

import __spark_entry__ as entry
from bibflux import queries as core
from bibflux.functions.lexicon import affiliation_table
from bibflux.functions.trie import trie_pattern

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.ORACLE) <= set(core.QUERIES)
    assert len(affiliation_table()) == len({a for a, *_ in affiliation_table()})


def test_trie():
    import re

    words = ["loading", "load", "lorem", "a+b", "é"]
    assert all(re.fullmatch(trie_pattern(words), w) for w in words) and not re.fullmatch(trie_pattern(words), "lo")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "n"] and df.count() > 0
