"""Docstrings of any length."""

import pytest

from loregraph.llm import pairs


@pytest.mark.parametrize("size", [3, 58, 59, 60, 200])
def test_long_docstring(size):
    doc = "\n".join(["Reads the ledger and settles what is due.", *(f"    line {i}" for i in range(size))])
    src = f'def settle(a):\n    """{doc}\n    """\n    return a\n\n\ndef other(b):\n    return b\n'
    first, second = pairs.functions_of(src)
    assert first.description == doc and second.description == ""
