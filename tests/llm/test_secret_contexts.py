"""Secrets in credential contexts without : or = in the text."""

from __future__ import annotations

import time

import pytest

from causalake.llm import secrets


@pytest.mark.parametrize("text", ["Passphrase IS xK9mQ2vTz7", "passphrase\tis\txK9mQ2vTz7", "the password\nis xK9mQ2vTz7"])
def test_context_without_marks(text):
    assert any(text[a:b] == "xK9mQ2vTz7" and k == "guess" for a, b, k in secrets.scan(text))


@pytest.mark.parametrize("user", ["", "u", "u" * 60, "u" * 70, "u" * 5000])
def test_users_of_any_length(user):
    text = f"see redis://{user}:xK9mQ2vTz7pq@host/0"
    assert [text[a:b] for a, b, k in secrets.scan(text) if k == "guess"] == ["xK9mQ2vTz7pq"]


@pytest.mark.parametrize("gap", ["", " ", " " * 8, "\t" * 9, " " * 3000, "\n  "])
def test_aligned_signs(gap):
    for text in (f"pwd{gap}={gap}xK9mQ2vTz7 end", f"passphrase{gap or ' '}is{gap or ' '}xK9mQ2vTz7"):
        assert [text[a:b] for a, b, k in secrets.scan(text) if k == "guess"] == ["xK9mQ2vTz7"]


@pytest.mark.parametrize("text", ["pwd" + " " * 300_000, ("pwd" + " " * 50) * 6000, "pwd = " + " " * 300_000, "://" + "a" * 300_000, "://:" + "b" * 300_000, "://a:" * 60_000])
def test_scan_stays_linear(text):
    start = time.monotonic()
    assert not [x for x in secrets.scan(text) if x[2] == "guess"]
    assert time.monotonic() - start < 5
