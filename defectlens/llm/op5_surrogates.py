"""PII: keyed, type-consistent surrogates.

1. Mentions are found in every text; the distinct entities (kind and normal
   form) are kept.  A name is found after a title; each of its parts is then a
   mention wherever it stands in the same text as a whole word with a capital,
   unless the text also has the word in lower case.
2. An entity's surrogate is derived from a keyed hash of its normal form and
   an attempt number: letters for letters, digits for digits, valid octets,
   a valid check digit where the original has one, names of the same script
   and, by the title before them, the same gender.  A given name after a title
   that tells none ("Dr") is the entity of its gender elsewhere in the texts,
   if there is exactly one.
3. Collision checks over all entities: of those with one surrogate the
   smallest keeps it, and a surrogate that is an original of its kind is not
   used; the others go to their next attempt until all are distinct.
4. The texts are written again, each mention in its own format (spacing,
   brackets, case, hyphens and apostrophes).  Equal entities get equal surrogates in all documents.

Only entities beyond their first attempt or of a gender found elsewhere must be looked up.  Up to
``SENT_EXCEPTIONS`` of them are sent to the tasks; more are joined to the
documents that mention them.

Edge cases: null text counts as empty (and stays null in :func:`replace`);
overlapping mentions: the leftmost, on ties the kind listed first; a part that is
a given name of one name and a surname of another stands alone for the surname; repeated
rows are handled one by one; an empty table gives an empty result; other
columns are carried by :func:`replace` unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import in_arrow, staged, text_or_empty

KEY = "surrogates of this corpus"  # callers pass their own secret
SENT_EXCEPTIONS = 50_000
MAX_ROUNDS = 40
KINDS = ("email", "ip", "card", "ssn", "phone", "name")
#: Titles and the gender they tell (fixed values).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "госпожа": "f",
          "Dr": "n", "Prof": "n"}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or three at least around one ``::``.
_IP6 = (rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|{_HEX}:(?::{_HEX}){{2,6}})(?![\w:])")
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"  # of any script, or a combining accent


def _capitals() -> str:
    """The upper and title case letters of all scripts as the inside of a character class."""
    runs: list[list[int]] = []
    for c in (c for c in range(0x1E944) if chr(c).isupper() or chr(c).istitle()):
        if chr(c).isalpha():
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(z)}" for a, z in runs)


#: A whole word: inner capitals, apostrophes and hyphens; an 's at its end stays outside.
_CAPITAL = rf"[{_capitals()}](?:{_LETTER}|['’](?![sS](?!{_LETTER})){_LETTER}|[-‐‑]{_LETTER})+(?!{_LETTER})"
#: One separator at most between the digits; a number without any has the digits of a national or international one.
_PHONES = (r"(?<![\w+])\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
           r"(?<![\w+])\+[1-9][0-9]{9,14}(?![0-9])",
           r"(?<![\w+])\+[1-9](?:[ .-]?\(?[0-9](?:\)(?=[ .-]?[0-9]))?){6,14}(?![0-9])",
           r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
           r"(?<![0-9])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{7}(?![0-9])",
           r"(?<![0-9])(?<![0-9][.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])",
           r"(?<!\w)(?<![0-9][.-])(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{8,9}|00[1-9][0-9]{7,12})(?!\w|[.-][0-9])")
#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")
PATTERNS = {
    "email": re.compile(r"(?<!\w)(?<!\w[.'%+-])\w[\w.'%+-]{0,255}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    "ip": re.compile(rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])|{_IP6}"),
    "card": re.compile(r"(?<![0-9])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": re.compile("|".join(_PHONES)),
    "name": re.compile(rf"\b(?:{'|'.join(TITLES)})\.? ({_CAPITAL}(?: {_CAPITAL}){{0,2}})"),
}
_DIGITS = re.compile(r"[0-9][0-9. -]*[0-9]")
_WORD = re.compile(rf"(?<![\w\u0300-\u036f])(?<!\w['’‐‑-]){_CAPITAL}")
_MARK = re.compile("(['’‐‑-])")
_SIXTEENS = re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]*:")
_TITLE = re.compile("|".join(f"{t}[. ]" for t in TITLES))
_ONSETS = {"latin": ["b", "br", "c", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w"],
           "cyrillic": ["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х"],
           "greek": ["β", "γ", "δ", "ζ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "χ"]}
_VOWELS = {"latin": ["a", "e", "i", "o", "u"], "cyrillic": ["а", "е", "и", "о", "у"], "greek": ["α", "ε", "ι", "ο", "υ"]}
_ENDINGS = {"latin": {"m": ["rd", "n", "us", "l"], "f": ["na", "ra", "lia", "ssa"], "n": ["n", "l", "s", "x"], "surname": ["son", "man", "ler", "ett", "ov", "ini"]},
            "cyrillic": {"m": ["н", "р", "л", "слав"], "f": ["на", "ра", "лия", "сса"], "n": ["н", "л", "р", "с"], "surname": ["ский", "енко", "ин", "ов"]},
            "greek": {"m": ["νος", "ρης", "λος", "σης"], "f": ["να", "ρα", "λία", "ση"], "n": ["ν", "ξ", "ρ", "λι"], "surname": ["ίδης", "άκης", "όπουλος", "έας"]}}


class Stream:
    """Numbers drawn from a keyed hash of an entity and its attempt."""

    def __init__(self, key: str, *parts):
        self.key, self.seed, self.block, self.left = key.encode(), "\0".join(map(str, parts)), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, f"{self.seed}\0{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def check_digit(digits: str) -> str:
    """The last digit that makes a card number valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return str(-total % 10)


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of each mention, not overlapping, in order."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), 0, "email") for m in PATTERNS["email"].finditer(text)]
    digits = _DIGITS.search(text)
    if digits or _SIXTEENS.search(text):
        for k in ("ip", "card", "ssn", "phone") if digits else ("ip",):
            found += [(m.start(), m.end(), KINDS.index(k), k) for m in PATTERNS[k].finditer(text)]
    if _TITLE.search(text):
        names = [(m.start(1), m.end(1), KINDS.index("name"), "name:" + TITLES[text[m.start():m.end()].split(" ")[0].rstrip(".")])
                 for m in PATTERNS["name"].finditer(text)]
        found += names + _named_again(text, names)
    found.sort(key=lambda x: (x[0], x[2]))
    out, at = [], 0
    for a, z, _, kind in found:
        if a >= at:
            out.append((a, z, kind, normal(kind, text[a:z])))
            at = z
    return out


def _part(word: str) -> str:
    """The form of a name's part that all its spellings share."""
    return unicodedata.normalize("NFC", word).replace("’", "'").casefold()


def _named_again(text: str, names: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The words of ``text`` that are parts of ``names``, one mention a word; a word in a name sorts after it."""
    known: dict[str, str] = {}
    for a, z, _, kind in names:
        *given, surname = text[a:z].split(" ")
        known[_part(surname)] = "name:n"  # a surname tells no gender
        for g in given:
            if known.get(_part(g)) in (None, "name:n:given"):
                known[_part(g)] = kind + ":given"
    ordinary = set(re.findall(r"\w+", text))
    known = {p: k for p, k in known.items() if p not in ordinary}
    return [(m.start(), m.end(), len(KINDS), known[_part(m[0])]) for m in _WORD.finditer(text) if _part(m[0]) in known] if known else []


def normal(kind: str, mention: str) -> str:
    if kind == "email":
        return mention.lower()
    if kind in ("card", "ssn", "phone"):
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", mention) or _COUNTRY.match(mention) if kind == "phone" else None
        return (country[0] if country else "") + "/" * bool(country) + re.sub("[^0-9]", "", mention[country.end() if country else 0:])
    return mention


def entities_of(kind: str, form: str) -> list[tuple[str, str]]:
    """(kind, normal form) of what gets a surrogate of its own: the parts of a name, else the whole."""
    if not kind.startswith("name"):
        return [(kind, form)]
    _, gender, *role = kind.split(":")
    parts = [_part(p) for p in form.split(" ")] + [""] * bool(role)  # a given name alone has no surname
    script = "cyrillic" if re.search("[Ѐ-ԯ]", form) else "greek" if re.search("[Ͱ-Ͽἀ-῾]", form) else "latin"
    return [(f"given:{gender}:{script}", p) for p in parts[:-1]] + [(f"surname:{script}", p) for p in parts[-1:] if p]


def surrogate(key: str, kind: str, form: str, attempt: int) -> str:
    """The normal form that takes the place of ``form``."""
    s = Stream(key, kind, form, attempt)
    digit = lambda c: str(1 + s.below(9)) if c != "0" else str(s.below(10))
    if kind == "email":
        local, _, domain = form.partition("@")
        names, _, top = domain.rpartition(".")
        top = top if top in ("com", "net", "org") else "com"
        swap = lambda t: "".join(chr(97 + s.below(26)) if c.isalpha() else str(s.below(10)) if c.isdigit() else c for c in t)
        grown = "".join(chr(97 + s.below(26)) for _ in range(attempt // 4))  # a short form may have no free surrogate left
        return f"{swap(local)}{grown}@{swap(names.split('.')[0])}.example.{top}"  # a reserved domain
    if kind == "ip" and ":" in form:  # groups of the same length, the first digit of each not 0
        return ":".join("".join("123456789abcdef"[s.below(15)] if i == 0 else f"{s.below(16):x}" for i in range(len(g))) for g in form.split(":"))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        body = form[0] + "".join(digit(c) for c in form[1:-1])
        last = check_digit(body)
        return body + (last if check_digit(form[:-1]) == form[-1] else str((int(last) + 1 + s.below(9)) % 10))
    if kind in ("ssn", "phone"):
        country, slash, rest = form.rpartition("/")  # a country's code stays
        # a long phone number's areas may not begin with any digit: 0 and 1 stay and the others become neither
        edge = lambda c: c if c in "01" else str(2 + s.below(8))
        return country + slash + "".join(edge(c) if len(rest) >= 10 and kind == "phone" and i in (0, 1, 3, 4) else digit(c) for i, c in enumerate(rest))
    kind, _, rest = kind.partition(":")
    gender, script = rest.split(":") if kind == "given" else ("surname", rest)
    syllables = lambda n: "".join(_ONSETS[script][s.below(len(_ONSETS[script]))] + _VOWELS[script][s.below(5)] for _ in range(n))
    *before, _ = _MARK.split(form)  # pieces and the marks after them, then the last piece
    start = "".join(x if _MARK.match(x) else syllables(1)[0] if len(x) == 1 else syllables(2) for x in before)
    return start + syllables(2 + attempt // 4) + _ENDINGS[script][gender][s.below(len(_ENDINGS[script][gender]))]


def _name_as(word: str, form: str) -> str:
    """A name's surrogate with the marks and the case of each piece of ``word``."""
    whole = len(word) > 1 and word.isupper()
    pieces = zip(_MARK.split(word), _MARK.split(form))
    return "".join(w if _MARK.match(w) else f.upper() if whole or len(w) > 1 and w.isupper() else f.capitalize() if w[:1] != w[:1].lower() else f
                   for w, f in pieces)


def in_format(kind: str, mention: str, forms: list[str]) -> str:
    """The surrogate written like the mention: its marks, its spacing, its case."""
    if kind.startswith("name"):
        return " ".join(_name_as(p, f) for p, f in zip(unicodedata.normalize("NFC", mention).split(" "), forms))
    form = forms[0]
    if kind in ("card", "ssn", "phone"):
        digits = (c for c in form if "0" <= c <= "9")
        return "".join(next(digits) if "0" <= c <= "9" else c for c in mention)
    if kind == "ip":
        return form.upper() if mention != mention.lower() else form
    if kind == "email":
        old_local, new_local = mention.partition("@")[0], form.partition("@")[0]
        return form.upper() if mention.isupper() else new_local.capitalize() + form[len(new_local):] if old_local.istitle() else form
    return form


def rewritten(text: str, key: str, exceptions: dict[tuple[str, str], tuple[str, int]], memo: dict) -> tuple[str, list[str]]:
    """The text with its surrogates, and the kinds of its mentions; ``exceptions`` has the kind and attempt of later ones."""
    out, at, kinds = [], 0, []
    for a, z, kind, form in mentions(text):
        forms = []
        for e in entities_of(kind, form):
            if e not in memo:
                kind_as, attempt = exceptions.get(e, (e[0], 0))
                memo[e] = surrogate(key, kind_as, e[1], attempt)
            forms.append(memo[e])
        out += [text[at:a], in_format(kind, text[a:z], forms)]
        at = z
        kinds.append(kind.split(":")[0])
    return "".join(out) + text[at:], kinds


def entities(texts: DataFrame) -> DataFrame:
    """Distinct (kind, form) over all texts; each batch sends an entity once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({e for t in b.column("text").to_pylist() for _, _, kind, form in mentions(t) for e in entities_of(kind, form)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "form"])

    return in_arrow(texts.select("text"), run, "kind string, form string").distinct()


def gendered(found: DataFrame) -> DataFrame:
    """(kind, form, kind_as) of given names without a gender that have exactly one elsewhere."""
    part = lambda i: F.split_part("kind", F.lit(":"), F.lit(i))
    given = found.filter(F.col("kind").startswith("given:")).select("form", part(2).alias("gender"), part(3).alias("script"))
    is_n = F.col("gender") == "n"
    one = given.groupBy("script", "form").agg(F.max(is_n).alias("n"), F.min(F.when(~is_n, F.col("gender"))).alias("a"),
                                              F.max(F.when(~is_n, F.col("gender"))).alias("z")).filter("n AND a = z")
    return one.select(F.concat(F.lit("given:n:"), "script").alias("kind"), "form",
                      F.concat(F.lit("given:"), "a", F.lit(":"), "script").alias("kind_as"))


def resolved(found: DataFrame, key: str) -> DataFrame:
    """(kind, form, attempt, surrogate), all surrogates of a kind distinct and none an original of it."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, f, n) for k, f, n in zip(*(b.column(c).to_pylist() for c in ("kind", "form", "attempt")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "form", "attempt")), pa.array(new, pa.string())], ["kind", "form", "attempt", "surrogate"])

    schema = "kind string, form string, attempt int, surrogate string"
    now = staged(in_arrow(found.withColumn("attempt", F.lit(0)), derive, schema), "pii-surrogates")
    originals = found.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("taken"))
    for _ in range(MAX_ROUNDS):
        # who keeps a surrogate: the smallest (attempt, form); one row a surrogate and task is sent
        keeper = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "form")).alias("k"), F.count("*").alias("n"))
        bad = keeper.join(originals, ["kind", "surrogate"], "left").filter("n > 1 OR taken")
        bad = staged(bad.select("kind", "surrogate", F.when(F.col("taken").isNull(), F.col("k.form")).alias("keeps")), "pii-collisions")
        if not bad.take(1):
            return now
        lose = F.col("hit").isNotNull() & ~F.col("form").eqNullSafe(F.col("keeps"))
        marked = now.join(bad.withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left")
        again = marked.filter(lose).select("kind", "form", (F.col("attempt") + 1).cast("int").alias("attempt"))
        now = staged(marked.filter(~lose).select("kind", "form", "attempt", "surrogate").unionByName(in_arrow(again, derive, schema)), "pii-surrogates")
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def replace(docs: DataFrame, key: str = KEY, text: str = "text", sent: int = SENT_EXCEPTIONS) -> DataFrame:
    """``row`` (all input columns), ``new_text`` and ``kinds`` of its mentions."""
    source = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("text"))
    found = staged(entities(source), "pii-entities")
    same = staged(gendered(found), "pii-gendered")
    table = resolved(staged(found.join(same, ["kind", "form"], "left_anti"), "pii-own"), key)
    own_kind = table.filter("attempt > 0").select("kind", "form", F.col("kind").alias("kind_as"), "attempt")
    other_kind = same.join(table.select(F.col("kind").alias("kind_as"), "form", "attempt"), ["kind_as", "form"])
    later = staged(own_kind.unionByName(other_kind), "pii-later")
    some = later.limit(sent + 1).collect() if later.count() <= sent else None
    schema = source.select("row").schema[0].dataType.simpleString()
    known = {(r["kind"], r["form"]): (r["kind_as"], r["attempt"]) for r in some or []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            if len(memo) > 200_000:
                memo.clear()
            own = b.column("later").to_pylist() if "later" in b.schema.names else None
            texts, kinds = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                if own and own[i]:
                    new, kind = rewritten(t, key, {(x["kind"], x["form"]): (x["kind_as"], x["attempt"]) for x in own[i]}, {})
                else:
                    new, kind = rewritten(t, key, known, memo if own is None else {})
                texts.append(new)
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["row", "new_text", "kinds"])

    if some is None:  # too many to send: only the documents that mention them get theirs
        digest = F.sha2("text", 256)

        def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, *e) for d, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist())
                        for e in {e for _, _, kind, form in mentions(t) for e in entities_of(kind, form)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["digest", "kind", "form"])

        pairs = in_arrow(source.select(digest.alias("digest"), "text"), mentioned, "digest string, kind string, form string").distinct()
        lists = (pairs.join(later, ["kind", "form"]).groupBy("digest")
                 .agg(F.collect_list(F.struct("kind", "form", "kind_as", "attempt")).alias("later")))
        source = source.withColumn("digest", digest).join(lists, "digest", "left").drop("digest")
    return in_arrow(source, run, f"row {schema}, new_text string, kinds array<string>")


def surrogate_report(docs: DataFrame, key: str = KEY) -> DataFrame:
    df = replace(docs.select("doc_id", "text"), key)
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return df.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.col("new_text").alias("text"))


def replaced(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text; same columns."""
    df = replace(docs, key, text)
    return df.select(*[F.when(F.size("kinds") > 0, F.col("new_text")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text
                       else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
