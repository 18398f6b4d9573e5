"""Boilerplate rule: short lines and lines made of the phrases, not long lines that mention one."""

import pytest

from defectlens.llm import op4_quality as quality

WORDS = ("Every evening some people walk along a river near the old town and talk about the weather of last week while children play "
         "between tall trees, feed small birds and wait until the lamps over both bridges are lit again by a quiet guard").split()
PROSE = " ".join(WORDS)
LAST = " ".join(sorted(WORDS))
OTHER = " ".join(w[::-1] for w in WORDS).lower()


@pytest.mark.parametrize("phrase", ["sign up", "log in", "terms of use", "all rights reserved", "released under the MIT license"])
def test_long_line_that_mentions_a_phrase_stays(make_docs, phrase):
    long = f"{PROSE}, then they {phrase} for more, and {OTHER}."
    docs = make_docs([(1, long), (2, f"{LAST}\n{long}")])
    assert {r["doc_id"]: (r["kept"], r["lost_chars"]) for r in quality.quality_report(docs).collect()} == {1: (True, 0), 2: (True, 0)}
    assert {r["doc_id"]: r["text"] for r in quality.keep_clean(docs).collect()} == {1: long, 2: f"{LAST}\n{long}"}


@pytest.mark.parametrize("line", [
    "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Please log in or sign up", "log in",
    "This work is licensed under the GNU General Public License, version 3.", "privacy policy terms of use cookie policy " * 8])
def test_short_lines_and_lines_of_phrases_go(make_docs, line):
    docs = make_docs([(1, f"{PROSE} {PROSE[:40]}\n{PROSE[::-1]}\n{line}")])
    assert line not in docs.select(quality.cleaned(docs["text"])).first()[0].split("\n")


@pytest.mark.parametrize("line", ["The log information is kept for a week", "The album was released under the label of a friend"])
def test_phrases_end_at_a_word(make_docs, line):
    docs = make_docs([(1, f"{PROSE}\n{line}")])
    assert line in docs.select(quality.cleaned(docs["text"])).first()[0].split("\n")
