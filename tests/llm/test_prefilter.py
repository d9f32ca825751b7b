"""Secrets that the pre-filter must let through."""

import re

import pytest

from loregraph.llm import secrets

WORTH = [
    "curl --user deploy:Zq81mPxw https://h.example/x",
    "curl --user=deploy:Zq81mPxw https://h.example/x",
    "curl -u deploy:Zq81mPxw https://h.example/x",
    "fetch('https://h.example/x?code=Zq81mPxwT')",
    "fetch('https://h.example/x?a=1&signature=Zq81mPxwT')",
    "fetch('https://h.example/x?sig=Zq81mPxwT')",
]


@pytest.mark.parametrize("text", WORTH)
def test_prefilter_passes_what_a_pattern_takes(text):
    assert secrets._USER.search(text) or secrets._QUERY.search(text)
    assert re.search(secrets.WORTH, text)
