"""The registry of queries with and without what the training-data operators need."""

import subprocess
import sys

import pytest

REGISTRY = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.QUERIES) <= names, "the engine's queries stay"
assert set(entry.oracle_sql()) >= set(entry.SQL)
print("added", len(names) - len(entry.QUERIES))
"""


def added(*masked):
    found = subprocess.run([sys.executable, "-c", REGISTRY, *masked], capture_output=True, text=True, check=True)
    return int(found.stdout.split()[-1])


@pytest.mark.parametrize("masked", ["public_tokenizers", "tiktoken", "xxhash", "pairwise.llm", "corpus_pipeline"])
def test_engine_queries_do_not_need(masked):
    assert added(masked) == 0
