"""Surrogates: whole names of any letters, phones with any grouping, one entity for titles without a gender."""

import re

import pytest

from defectlens.llm import op5_surrogates as pii


def found(text, kind):
    return [text[a:z] for a, z, k, _ in pii.mentions(text) if k.split(":")[0] == kind]


@pytest.mark.parametrize("title,name", [
    ("Mr.", "McDonald"), ("Mr.", "O’Neill"), ("Mr.", "O'Neill"), ("Mr.", "Dvořák"), ("Mr.", "Dvořák"), ("Dr.", "Anna Wałęsa"),
    ("Mrs.", "Łucja Nowak"), ("Mr.", "SMITH"), ("Frau", "Anna-Maria Müller-Lüdenscheidt"), ("господин", "Їжакевич"), ("Mr.", "Παπαδόπουλος")])
def test_names_are_whole_words(title, name):
    assert found(f"Then {title} {name} left.", "name") == [name]
    assert found(f"Then {title} {name}, who left", "name") == [name]
    assert found(f"Then {title} {name}’s car", "name") == [name]


@pytest.mark.parametrize("phone", ["+14155552671", "4155552671", "+33 6 12 34 56 78", "+1 (415) 555-2671", "415-555-2671", "(415) 555-2671",
                                   "+33612345678", "06 12 34 56 78", "0612345678", "0033612345678", "+44 (0)20 7946 0958", "+49.30.1234.5678"])
def test_phones_with_any_grouping(phone):
    for text in (f"call {phone} now", f"call {phone}.", f"({phone})"):
        assert found(text, "phone") == [phone]
    new, kinds = pii.rewritten(f"call {phone}.", "k", {}, {})
    assert kinds == ["phone"] and new != f"call {phone}." and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", f"call {phone}.")
    assert found(new, "phone") == [new[5:-1]]  # a phone again


def test_numbers_that_are_no_phones():
    for text in ("at 1700000000 s", "0.4155552671", "id a4155552671", "in 2020 123456 rows", "+14155552671234567890"):
        assert found(text, "phone") == []
    assert found("call +14155552671 2 times", "phone") == ["+14155552671"]


def test_one_phone_in_two_groupings_is_one_entity():
    assert pii.normal("phone", "+14155552671") == pii.normal("phone", "+1 415-555-2671") == "+1/4155552671"
    assert pii.normal("phone", "+33612345678") == pii.normal("phone", "+33 6 12 34 56 78")


def test_names_with_one_beginning_stay_distinct(make_docs):
    docs = make_docs([(1, "Mr. McDonald and Mr. McGregor met Mr. McDonald’s son and Mr. O'Neill, Mr. O’Neill.")])
    new = pii.surrogate_report(docs, "k").first()["text"]
    first, second, third, oneill, again = re.findall(r"Mr\. (\w+)", new)
    assert first == third != second and oneill == again and "Donald" not in new and "Neill" not in new and "’s son" in new


@pytest.mark.parametrize("sent", [pii.SENT_EXCEPTIONS, 0])
def test_titles_without_a_gender_take_the_gendered_entity(make_docs, sent):
    docs = make_docs([(1, "Mrs. Anna Nowak"), (2, "Dr. Anna Nowak"), (3, "Dr. Kim Nowak"), (4, "Mr. Robin Nowak"), (5, "Ms. Robin Nowak"), (6, "Prof. Robin Nowak")])
    new = {r["row"]["doc_id"]: r["new_text"].split(" ")[1] for r in pii.replace(docs, "k", sent=sent).collect()}
    assert new[1] == new[2] and new[4] != new[5]
    assert new[3] == pii.surrogate("k", "given:n:latin", "kim", 0).capitalize()
    assert new[6] == pii.surrogate("k", "given:n:latin", "robin", 0).capitalize()  # two genders: its own
