"""Texts that make patterns backtrack: time grows with the length only."""

import time

import pytest

from loregraph.llm import pairs, secrets, subjects

CASES = {"dots": "a.", "quotes": "'a',", "begins": "-----BEGIN PRIVATE KEY-----\n", "spaces": " ", "lines": "\n", "parens": "(", "ticks": "`", "comments": "/* ", "paths": "a/", "camels": "aB", "lows": "a_", "sets": "a = ", "tags": "<a ", "names": "token: ", "flags": "?a-"}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("run", [secrets.find, pairs.functions_of, subjects.sentences], ids=["secrets", "pairs", "subjects"])
def test_linear(name, run):
    text = CASES[name] * (100_000 // len(CASES[name]))
    began = time.time()
    run(text)
    assert time.time() - began < 3
