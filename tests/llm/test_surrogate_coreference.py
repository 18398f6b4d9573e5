"""Surrogates: parts of found names, marks inside names, whole addresses; planted entities against a plain replacement."""

import random
import re

import pytest

from defectlens.llm import op5_surrogates as pii


def found(text, kind):
    return [text[a:z] for a, z, k, _ in pii.mentions(text) if k.split(":")[0] == kind]


def test_parts_of_a_name_are_the_same_person():
    text = "Mr. John Smith came. Then Smith left and John said hello. Smith's wife, Anna Smith, and SMITH; Johnson, Smith-Jones stay."
    assert found(text, "name") == ["John Smith", "Smith", "John", "Smith", "Smith", "SMITH"]
    new = pii.rewritten(text, "k", {}, {})[0]
    given, surname = re.match(r"Mr\. (\w+) (\w+) came", new).groups()
    assert new == f"Mr. {given} {surname} came. Then {surname} left and {given} said hello. {surname}'s wife, Anna {surname}, and " \
                  f"{surname.upper()}; Johnson, Smith-Jones stay."


def test_words_in_lower_case_are_no_names():
    assert found("Mrs. Rose met us. Rose bushes, a rose.", "name") == ["Rose"]
    assert found("Smith met John.", "name") == []


@pytest.mark.parametrize("name", ["Müller-Lüdenscheidt", "O’Neill", "O'Neill", "Anna-Maria", "D’Arcy-Ó", "JEAN-LUC"])
def test_marks_and_case_stay(name):
    new = pii.rewritten(f"Dr. {name} left", "k", {}, {})[0][4:-5]
    shape = lambda t: re.sub(r"[^\W_]+", lambda m: "U" if m[0].isupper() and len(m[0]) > 1 else "c", t)
    assert new != name and shape(new) == shape(name)


@pytest.mark.parametrize("address", ["MÜLLER@x.de", "jean.o'neil@exämple.com", "a.b+c@d-e.co.uk", "_x@y.org"])
def test_whole_addresses(address):
    for text in (f"to {address}, now", f"<{address}>", f"'{address}'", f"-{address}."):
        assert found(text, "email") == [address]
    new = pii.rewritten(f"to {address}", "k", {}, {})[0][3:]
    assert found(new, "email") == [new] and not set(re.findall(r"\w{3,}", new)) & set(re.findall(r"\w{3,}", address.partition("@")[0]))


@pytest.mark.parametrize("address", ["2001:db8:0:0:8:800:200c:417a", "2001:db8::1", "FE80::1:2", "10.1.2.3"])
def test_addresses_of_machines(address):
    assert found(f"at {address}, port", "ip") == [address]
    new = pii.rewritten(f"at {address}.", "k", {}, {})[0][3:-1]
    assert new != address and found(f"at {new}.", "ip") == [new] and re.sub(r"\w+", "x", new) == re.sub(r"\w+", "x", address)


def test_no_addresses_of_machines():
    for text in ("std::vector", "a::b", "at 12:30:45", "::", "de:ad:be:ef:00:01"):
        assert found(text, "ip") == []


def test_long_text_takes_linear_time():
    text = "Mr. John Smith " + "a" * 2_000_000 + " me@x.org " + "Smith and John " * 20_000 + "a-" * 200_000
    assert len(pii.mentions(text)) == 40_002


def test_planted_entities_against_plain_replacement(make_docs):
    """Texts made of known entities: the rest stays, one entity has one surrogate everywhere, two never share one."""
    rng = random.Random(3)
    letters = "bcdfgklmnprst"
    word = lambda: rng.choice(letters).upper() + "".join(rng.choice("aeiou") + rng.choice(letters) for _ in range(3))
    people = [(word(), word() + rng.choice(["", "-" + word(), "ez"]), rng.choice(["Mr.", "Mrs."])) for _ in range(60)]
    mails = [f"{word().lower()}.{n}@{word().lower()}.net" for n in range(40)]
    phones = [f"+1 {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}" for _ in range(40)]
    rows, pieces = [], []
    for k in range(150):
        out = []
        for _ in range(rng.randrange(6)):
            g, s, t = rng.choice(people)
            m, p = rng.choice(mails), rng.choice(phones)
            out += [f"{t} ", ("given " + t, g), " ", ("surname", s), " wrote from ", ("email", m), "; later ", ("surname", s), "’s phone ", ("phone", p),
                    " and ", ("given " + t, g), " came.\n"]
        rows.append((k, "".join(x if isinstance(x, str) else x[1] for x in out)))
        pieces.append(out)
    got = {r["doc_id"]: r["text"] for r in pii.surrogate_report(make_docs(rows), "k").collect()}
    chosen = {}
    for k, out in enumerate(pieces):
        pattern = "".join(re.escape(x) if isinstance(x, str) else r"([^\s;’]+(?: [0-9][0-9-]+)?)" for x in out)
        m = re.fullmatch(pattern, got[k])
        assert m, (rows[k], got[k])
        for entity, new in zip((x for x in out if not isinstance(x, str)), m.groups()):
            assert chosen.setdefault(entity, new) == new != entity[1]
    for kind in {e[0] for e in chosen}:
        of_kind = {e[1]: new for e, new in chosen.items() if e[0] == kind}
        assert len(set(of_kind.values())) == len(of_kind) and not set(of_kind) & set(of_kind.values())
