from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st

from leafcutter.functions import text as T


def test_sentences_need_white_space_after_the_end():
    assert T.sentences("One. Two!Three? Four") == ["One.", "Two!Three?", "Four"]
    assert T.sentences("  ") == []


def test_keywords_are_long_ascii_words_that_are_not_stopped():
    assert T.keywords("The Quick-brown fox with 12345 Überfall") == {"quick", "brown", "12345", "berfall"}


def test_lines_end_with_lf_or_crlf_only():
    assert T.lines("a\r\nb\x0bc\n") == ["a", "b\x0bc"]
    assert T.lines("") == []


def test_strip_leaves_separators_that_are_not_white_space():
    assert T.strip("\x1e a　") == "\x1e a"


@given(st.text(alphabet="ab .!?\né🙂", max_size=300), st.integers(5, 60))
def test_bounded_pieces_keep_the_cap_and_every_letter(text, cap):
    pieces = T.bounded(text, cap)
    if len(text) > cap:
        assert all(len(p) <= cap for p in pieces)
    letters = lambda s: [c for c in s if c not in T.WHITE]
    assert letters("".join(pieces)) == letters(text)


def test_table_pieces_repeat_their_head():
    rows = ["| a | b |", "|---|---|"] + [f"| {i} | x |" for i in range(40)]
    parts = T.at_lines("\n".join(rows), 120, 2)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts)
    assert [x for p in parts for x in p.split("\n")[2:]] == rows[2:]


def test_hash_is_fnv():
    assert T.content_hash(b"") == "cbf29ce484222325"
    assert T.content_hash(b"a") == "af63dc4c8601ec8c"


def test_words_are_not_cut_where_white_space_is_near():
    random.seed(1)
    text = " ".join("banana" for _ in range(100))
    assert all(set(p.split(" ")) == {"banana"} for p in T.at_words(text, 40))
    assert T.at_words("x" * 90, 40) == ["x" * 40, "x" * 40, "x" * 10]
