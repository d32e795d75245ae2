"""Personal data replaced by surrogates that are keyed, consistent and of the same type, script, gender and format.

Each value is seen as a number in mixed radix (a digit, a letter of the same case, script and kind for each character)
and moved by a keyed permutation of all values of its format. A permutation keeps distinct values distinct in the whole
corpus and gives equal values equal surrogates in every document, without a table to look up or to shuffle. It is the
keyed conjugate of a cyclic shift, ``f(f'(x) + 1)`` with a Feistel network f, so that no value is its own surrogate.

* e-mail addresses: local part and domain labels, the top-level domain stays; case is not part of the value
* telephone numbers: the national digits; the country code, trunk zeros and all punctuation stay, and digits that must not
  be 0 or 1 (area codes and exchanges in American form) are not
* card numbers: the issuer's six digits stay, and the check digit stays as valid or invalid as it was; grouping stays
* IBANs: country and format stay, the check digits are computed anew if they were right
* IPv4 addresses: private, loopback and link-local ranges stay what they are, public addresses stay public
* social-security-like numbers (ddd-dd-dddd); dates of birth (after words that say so): another valid date in that form
* street addresses: the house number and the street's name, its kind stays
* names: after titles, after words that introduce one, after a salutation, or a known given name with a surname after it;
  all their parts, and further mentions of a part in the same document. A known given name becomes one of the same gender
  and script; any other name part changes its letters inside vowels and consonants of its script. Outcomes of the second
  kind that collide with a known given name are moved on until they do not (the collision check of a permutation: cycle
  walking).

``collisions`` compares what was replaced in a corpus with what it became, and lists any two values with one surrogate,
values with two, and values that stay; the query counts them beside its rows.

The key comes from the session's setting ``KEY_SETTING``. Where that is unset, a key that is no secret is used and a
warning is logged: fit for tests, not for data.

Not seen: names in scripts without capitals, names that nothing introduces, dates that nothing calls a birth date.

Cases: a null text stays null, an empty one empty; a null doc_id is kept; repeated rows are replaced alike; an empty
table gives an empty result; other columns are kept by ``pseudonymise`` and ignored by the query. No shuffle but for the
collision check, which takes the values found.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, per_batch

#: The session's setting that holds the secret key, and what stands in for it in tests; the latter is no secret.
KEY_SETTING, OPEN_KEY = "spark.rastercube.surrogates.key", b"surrogates of this corpus"
ROUNDS = 10

#: Letters that have one capital of their own; others (as a sharp s) stay.
ALPHABETS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøœùúûüýÿ", "çñðþšžćčđłńśźż",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ",
]
DIGITS = "0123456789"
_CLASS = {c: (a, i) for a in [*ALPHABETS, DIGITS] for i, c in enumerate(a)}
_LATIN = {c: ("abcdefghijklmnopqrstuvwxyz", i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}

GIVEN = {
    ("f", "latin"): "anna maria elena sofia laura clara julia emma lucia marta ines nora alice camille louise marie sarah emily hannah olivia greta heike ingrid petra carmen pilar rosa isabel claire amélie".split(),
    ("m", "latin"): "john peter paul david daniel martin thomas james robert michael carlos juan pedro luis miguel hans karl jürgen stefan wolfgang pierre jean jacques louis henri andré josé javier oliver henry".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья ирина светлана татьяна юлия екатерина".split(),
    ("m", "cyrillic"): "иван пётр сергей алексей дмитрий николай андрей михаил павел владимир".split(),
    ("f", "greek"): "μαρία ελένη κατερίνα σοφία άννα δήμητρα".split(),
    ("m", "greek"): "γιώργος νίκος δημήτρης γιάννης κώστας παύλος".split(),
}
_GIVEN = {name: (kind, i) for kind, names in GIVEN.items() for i, name in enumerate(names)}
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Señorita Sra Srta Madame Mme Mademoiselle Mlle Госпожа Г-жа Κυρία",
    "m": "Mr Herr Señor Sr Monsieur Господин Г-н Κύριος",
    "": "Dr Prof Dra",
}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts.split()}

EMAIL = re.compile(r"(?<![\w.%+-])([\w.%+-]+)@((?:[\w-]+\.)+)([A-Za-z]{2,})(?![\w-])")
IBAN = re.compile(r"(?<!\w)([A-Z]{2})(\d{2})((?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")
CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w)")
PHONE = re.compile(r"(?<![\w.+])(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}([-.])\d{3}\1\d{4})(?!\w)")
PLUS = re.compile(r"(?<![\w.])\+(\d{1,3})([ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})(?!\w)")
IP = re.compile(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\w|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
#: Without a country code: a trunk zero (030 1234567, 0171/2345678, 01 23 45 67 89, (020) 7946 0958), nine digits as in
#: Spain, ten as in America with blanks or after a 1.
NATIONAL = re.compile(r"(?<![\w.+/-])(?:\(?0\d{1,5}\)?(?:(?:[ .-]|\x20?[/-]\x20?)\d{2,8}){1,5}|\(0\d{1,5}\)\d{4,8}|0[1-9]\d{8,10}|[6-9]\d{2}(?:\x20\d{3}){2}|[6-9]\d{2}(?:\x20\d{2}){3}|\d{3}\x20\d{3}\x20\d{4}|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w|[.-]\d)")
DATE = re.compile(r"\d{1,2}([./ -])\d{1,2}\1\d{2,4}")
#: Words that introduce a date of birth, and dates as year-month-day or with the year last.
BORN = re.compile(r"(?i:\b(?:born(?: on)?|birth ?date|date of birth|d\.?o\.?b\.?|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)\b\.?[ :]{1,3})(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?!\w)")
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[-’'][^\W\d_]+)*"
#: Street addresses: number and name before a kind of street, a German compound, or a kind before the name.
STREETS = (
    re.compile(rf"(?<![\w.])(\d{{1,5}}[A-Za-z]?)( )((?:{_CAP} ){{1,3}})(?=(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Terrace)\b)"),
    re.compile(r"(?<!\w)([A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*?)(straße|strasse|str\.|weg|platz|allee|gasse)( )(\d{1,4}[a-z]?)(?!\w)"),
    re.compile(rf"(?<![\w.])(\d{{1,5}})(,? (?:rue|avenue|boulevard|place|chemin) (?:de (?:la |l’|l')?|du |des )?)({_CAP}(?: {_CAP}){{0,2}})"),
    re.compile(rf"(?<!\w)((?:Calle|Avenida|Plaza|Paseo) (?:de (?:la |los |las )?|del )?)({_CAP}(?: {_CAP}){{0,2}})(,? )(\d{{1,4}})(?!\w)"),
)
#: What introduces a name: the words before it, in four languages.
INTRODUCED = re.compile(r"(?i:\b(?:my name is|name is|i am called|signed by|signed|full name|name|sincerely|regards|ich heiße|mein name ist|name des kunden|je m['’]appelle|mon nom est|nom|me llamo|mi nombre es|nombre|dear|liebe|lieber|chère|cher|querida|querido)\b[:,]?[^\S\n]*\n?[^\S\n]*)(?=[^\W\d_a-zß-öø-ÿ])")
_GAP = r"(?:[^\S\n]*\n[^\S\n]*|[^\S\n]+)"
TITLED = re.compile(rf"\b(?=[{''.join(sorted({t[0] for t in _TITLE}))}])(?:(?:{'|'.join(sorted(map(re.escape, _TITLE), key=len, reverse=True))})(?:\.{_GAP}?|{_GAP}))+(?<![^\W\d_])")
PART = re.compile(r"[^\W\d_]+(?:[-’'](?!s\b)[^\W\d_]+)*")
CAPITAL = re.compile(r"(?<![^\W_])[^\W\d_a-zß-öø-ÿ][^\W\d_]+")
PARTICLES = set("von vom van zu zur zum der den dem de del della di da do dos das du la las le les los y e af av ten ter te bin ibn al el фон де".split())


class Surrogates:
    """The permutations of one key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, r: int, x: int, m: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{x}".encode(), key=self.key, digest_size=24).digest(), "big") % m

    def _feistel(self, tweak: str, a: int, b: int, ma: int, mb: int, sign: int) -> tuple[int, int]:
        for r in range(ROUNDS)[::sign]:
            if r % 2:
                b = (b + sign * self._f(tweak, r, a, mb)) % mb
            else:
                a = (a + sign * self._f(tweak, r, b, ma)) % ma
        return a, b

    def number(self, tweak: str, x: int, m: int) -> int:
        """A keyed permutation of range(m) that is one cycle: no value stays. Its halves have about equal moduli."""
        return self.digits(tweak, [x], [m])[0]

    def digits(self, tweak: str, xs: list[int], radices: list[int]) -> list[int]:
        """The same for numbers in mixed radix."""
        half = (len(xs) + 1) // 2
        tweak = f"{tweak}|{','.join(map(str, radices))}"

        def pack(ds, rs):
            v, m = 0, 1
            for d, r in zip(ds, rs, strict=True):
                v, m = v * r + d, m * r
            return v, m

        (a, ma), (b, mb) = pack(xs[:half], radices[:half]), pack(xs[half:], radices[half:])
        a, b = self._feistel(tweak, a, b, ma, mb, -1)
        b += 1
        if b == mb:
            a, b = (a + 1) % ma, 0
        a, b = self._feistel(tweak, a, b, ma, mb, 1)
        out: list[int] = []
        for v, rs in ((b, radices[half:]), (a, radices[:half])):
            for r in reversed(rs):
                out.append(v % r)
                v //= r
        return out[::-1]

    def pattern(self, kind: str, text: str, classes: dict) -> str:
        """Characters of ``classes`` move inside their class; all others and the case stay. Case is not in the value."""
        low = [c if len(c := x.lower()) == 1 else x for x in text]
        at = [i for i, c in enumerate(low) if c in classes]
        if not at:
            return text
        shape = "".join("?" if c in classes else c for c in low)
        moved = self.digits(f"{kind}|{shape}", [classes[low[i]][1] for i in at], [len(classes[low[i]][0]) for i in at])
        out = list(text)
        for i, d in zip(at, moved, strict=True):
            new = classes[low[i]][0][d]
            out[i] = new.upper() if text[i] != low[i] and len(new.upper()) == 1 else new
        return "".join(out)

    def email(self, local: str, domain: str, top: str) -> str:
        return self.pattern(f"email|{top.lower()}", f"{local}@{domain}", {**_CLASS, **_LATIN}) + top

    def in_digits(self, kind: str, text: str) -> str:
        """The digits of a text moved as one number, whatever stands between them."""
        at = [i for i, c in enumerate(text) if c in DIGITS]
        out = list(text)
        for i, d in zip(at, self.digits(kind, [int(text[i]) for i in at], [10] * len(at)), strict=True):
            out[i] = str(d)
        return "".join(out)

    def phone(self, rest: str) -> str:
        """National digits: trunk zeros stay, the first other digit is not 0, and the first digits of area code and exchange
        in American form are neither 0 nor 1 if they were not."""
        at = [i for i, c in enumerate(rest) if c in DIGITS]
        ds = [int(rest[i]) for i in at]
        zeros = next((k for k, d in enumerate(ds) if d), len(ds))
        least = [0] * len(ds)
        if zeros < len(ds):
            least[zeros] = 1
        if len(ds) == 10 and not zeros and ds[0] > 1 and ds[3] > 1:
            least[0] = least[3] = 2
        own = range(zeros, len(ds))
        tweak = f"phone|{zeros}|{''.join(map(str, least))}"
        moved = self.digits(tweak, [ds[k] - least[k] for k in own], [10 - least[k] for k in own]) if zeros < len(ds) else []
        out = list(rest)
        for k, d in zip(own, moved, strict=True):
            out[at[k]] = str(d + least[k])
        return "".join(out)

    def date(self, y: str, m: str, d: str) -> tuple[str, str, str] | None:
        """Another valid date of 1900 to 2099, with as many digits a field; None if it is none."""
        try:
            day = date(int(y), int(m), int(d)).toordinal() - _EPOCH
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = date.fromordinal(_EPOCH + self.number("date", day, _DAYS))
        return f"{new.year:04d}", f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}"

    def born(self, *g: str | None) -> str:
        if g[0]:
            new = self.date(g[0], g[2], g[3])
            return g[1].join(new or (g[0], g[2], g[3]))
        a, sep, b, y = g[4:]
        # day first unless only the other way gives a date
        if new := self.date(y, b, a):
            return sep.join((new[2], new[1], new[0]))
        new = self.date(y, a, b)
        return sep.join((new[1], new[2], new[0]) if new else (a, b, y))

    def street(self, *g: str) -> str:
        """Parts of an address: numbers move, capitalised words change as names do, the rest stays."""
        out = []
        for x in g:
            if x[:1].isdigit():
                k = len(x) - len(x.lstrip(DIGITS))
                n = [int(x[0]) - 1, *map(int, x[1:k])] if x[0] != "0" else None
                moved = self.digits(f"house|{k}", n, [9] + [10] * (k - 1)) if n else None
                out.append("".join(map(str, [moved[0] + 1, *moved[1:]])) + x[k:] if moved else x)
            elif x.strip() in _KINDS or not x[:1].isupper():
                out.append(x)
            else:
                first = x.split(" ")[0]
                out.append(x if first in _BEFORE else " ".join(self.name(w) if w else w for w in x.split(" ")))
        return "".join(out)

    def card(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        new = digits[:6] + self.in_digits(f"card|{digits[:6]}", digits[6:-1])
        new = iter(new + str((luhn(new) + off) % 10))
        return re.sub(r"\d", lambda _: next(new), text)

    def iban(self, country: str, check: str, rest: str) -> str:
        bare = rest.replace(" ", "")
        valid = iban_check(country, bare) == check
        classes = {c: (DIGITS, i) for i, c in enumerate(DIGITS)} | {c: ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i) for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
        moved = self.digits(f"iban|{country}{'' if valid else check}", [classes[c][1] for c in bare], [len(classes[c][0]) for c in bare])
        new = "".join(classes[c][0][d] for c, d in zip(bare, moved, strict=True))
        spaced = iter(new)
        return country + (iban_check(country, new) if valid else check) + "".join(c if c == " " else next(spaced) for c in rest)

    def ip(self, *parts: str) -> str:
        xs = list(map(int, parts))
        fixed = reserved(xs)
        if fixed:  # what follows the prefix moves
            radices = [16 if fixed == "172" else 256, 256, 256][-3:] if fixed in ("10", "127", "172") else [256, 256]
            own = xs[-len(radices) :]
            own[0] -= 16 if fixed == "172" else 0
            moved = self.digits(f"ip|{fixed}", own, radices)
            moved[0] += 16 if fixed == "172" else 0
            return ".".join(map(str, [*xs[: 4 - len(radices)], *moved]))
        while reserved(xs := self.digits("ip", xs, [256] * 4)):
            pass  # a public address stays public
        return ".".join(map(str, xs))

    def name(self, text: str) -> str:
        """One part of a name."""
        low = text.lower()
        if low in _GIVEN:
            kind, i = _GIVEN[low]
            new = GIVEN[kind][self.number(f"given|{kind}", i, len(GIVEN[kind]))]
            return new.upper() if text.isupper() and len(text) > 1 else new.capitalize() if text[0].isupper() else new
        new = self.pattern("name", text, _CLASS)
        while new.lower() in _GIVEN:
            new = self.pattern("name", new, _CLASS)
        return new


_EPOCH = date(1900, 1, 1).toordinal()
_DAYS = date(2100, 1, 1).toordinal() - _EPOCH
_KINDS = {"straße", "strasse", "str.", "weg", "platz", "allee", "gasse"}
_BEFORE = {"Calle", "Avenida", "Plaza", "Paseo"}


def reserved(xs: list[int]) -> str:
    """Which range that is not public an address is in: its fixed prefix, or nothing."""
    a, b = xs[:2]
    return "10" if a == 10 else "127" if a == 127 else "172" if a == 172 and 16 <= b < 32 else "192.168" if (a, b) == (192, 168) else "169.254" if (a, b) == (169, 254) else ""


def lower(text: str) -> str:
    """Letter by letter, so that a letter's lower case does not depend on its neighbours (as a final sigma's does)."""
    return "".join(map(str.lower, text))


def luhn(digits: str) -> int:
    """The check digit of all but the last digit of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def name_parts(text: str, at: int) -> list[tuple[int, int]]:
    """Where the parts of the name that starts at ``at`` are: any number of capitalised words and initials, with
    particles (which stay) before them, in one line."""
    out = []
    while m := PART.match(text, at):
        big = m[0][0].isupper() or (m[0][1:2] in "’'" and m[0][2:3].isupper())
        if m[0] in _TITLE or not big and m[0] not in PARTICLES:
            break
        if big:
            out.append(m.span())
        at = m.end()
        if big and len(m[0]) == 1 and text[at : at + 1] == ".":
            at += 1
        gap = re.compile(r"[^\S\n]+").match(text, at)
        at = gap.end() if gap else at
        if not gap and text[at - 1] != ".":
            break
    return out


def _named(text: str, at: int, parts: list[tuple[int, int]]) -> tuple:
    """(what stands before, part) of each part."""
    out = []
    for a, b in parts:
        out.append((text[at:a], text[a:b]))
        at = b
    return tuple(out)


def entities(text: str) -> Iterator[tuple[int, int, str, tuple]]:
    """(start, end, kind, groups) of what is found, left to right, without overlaps: the earlier, then the kind listed
    first, wins."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end(), "email", m.groups()) for m in EMAIL.finditer(text)]
    if any(map(text.__contains__, DIGITS)):
        found += [(m.start(), 1, m.end(), "iban", m.groups()) for m in IBAN.finditer(text) if iban_check(m[1], m[3].replace(" ", "")) == m[2]]
        found += [(m.start(), 2, m.end(), "card", (m[0],)) for m in CARD.finditer(text)]
        found += [(m.start(), 3, m.end(), "ip", m.groups()) for m in IP.finditer(text) if max(map(int, m.groups())) < 256]
        found += [(m.start(), 4, m.end(), "phone", (m[1], m[2])) for m in PLUS.finditer(text)]
        found += [(m.start(), 5, m.end(), "phone", ("", m[0])) for m in PHONE.finditer(text)]
        found += [(m.start(), 6, m.end(), "ssn", (m[0],)) for m in SSN.finditer(text)]
        found += [(m.start(), 10, m.end(), "phone", ("", m[0])) for m in NATIONAL.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 13 and not DATE.fullmatch(m[0])]
    if any(map(text.__contains__, DIGITS)):
        for m in BORN.finditer(text):
            at = m.start(1) if m[1] else m.start(5)
            found.append((at, -1, m.end(), "born", m.groups()))
        for k, pattern in enumerate(STREETS):
            found += [(m.start(), -1 - k, m.end(), "street", m.groups()) for m in pattern.finditer(text)]
    named, parts = [], set()

    def name_at(start: int, at: int, rank: int, least: int = 1) -> None:
        got = name_parts(text, at)
        if len(got) >= least:
            named.append((start, rank, got[-1][1], "name", _named(text, start, got)))
            for x in (text[a:b].lower() for a, b in got):
                parts.update({x, *re.split("[-’']", x)} if len(x) > 1 else ())

    for m in TITLED.finditer(text):
        name_at(m.start(), m.end(), 7)
    for m in INTRODUCED.finditer(text):
        first = PART.match(text, m.end())
        # a greeting or a heading may be followed by any capitalised word: there a known given name must begin the name
        sure = re.match(r"(?i)(my name is|name is|i am called|ich heiße|mein name ist|je m['’]appelle|mon nom est|me llamo|mi nombre es|full name)", m[0])
        if first and (sure or first[0].lower() in _GIVEN):
            name_at(m.end(), m.end(), 7)
    for m in CAPITAL.finditer(text):
        if m[0].lower() in _GIVEN and m[0][0].isupper():
            name_at(m.start(), m.start(), 8, least=2)  # a given name and what follows it
    found += named
    if parts:  # further mentions of these people
        parts = {x for x in parts if len(x) > 1 and x not in PARTICLES}
        for m in PART.finditer(text):
            if m[0][0].isupper() and m[0].lower() in parts and m[0] not in _TITLE:
                found.append((m.start(), 9, m.end(), "name", (("", m[0]),)))
    end = 0
    for a, _, b, kind, groups in sorted(found):
        if a >= end:
            yield a, b, kind, groups
            end = b


def replacement(s: Surrogates, kind: str, groups: tuple) -> str:
    if kind == "phone":
        code, rest = groups
        return (f"+{code}" if code else "") + s.phone(rest)
    if kind == "name":
        return "".join(before + s.name(part) for before, part in groups)
    if kind == "ssn":
        return s.in_digits("ssn", groups[0])
    return getattr(s, kind)(*groups)


def surrogate_text(s: Surrogates, text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, value, surrogate) of each."""
    parts, done, at = [], [], 0
    for a, b, kind, groups in entities(text):
        new = replacement(s, kind, groups)
        parts += [text[at:a], new]
        done.append((kind, text[a:b], new))
        at = b
    return ("".join([*parts, text[at:]]) if done else text), done


def _replace(batch: pa.RecordBatch, key: bytes) -> dict:
    s, text, n = Surrogates(key), [], []
    for t in batch.column("text").to_pylist():
        new, done = surrogate_text(s, t or "")
        text.append(t if t is None else new)
        n.append(len(done))
    return {"text": text, "n": n, "rest": batch.column("rest")}


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's setting, or the open one with a warning."""
    found = spark.conf.get(KEY_SETTING, None)
    if found:
        return found.encode()
    logging.getLogger(__name__).warning("%s is not set: surrogates are made with a key that is no secret", KEY_SETTING)
    return OPEN_KEY


def pseudonymise(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns stay, ``n_chars`` follows the text. ``count`` names
    an added column with the number of replacements."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*others).alias("rest") if others else F.lit(None).cast("struct<a:int>").alias("rest"))
    out = per_batch(packed, _replace, f"text string, n long, {_ddl(packed, 'rest')}", key=key)
    cols = {c: F.col("text") if c == "text" else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return out.select(*[v.alias(k) for k, v in cols.items()], *([F.col("n").alias(count)] if count else []))


def _ddl(df: DataFrame, column: str) -> str:
    return df.select(column)._jdf.schema().toDDL()


def found_values(docs: DataFrame, key: bytes) -> DataFrame:
    """Distinct (kind, value, surrogate) of a corpus; values in the form in which equal ones are equal."""

    def f(batch: pa.RecordBatch) -> dict:
        s, out = Surrogates(key), []
        for t in batch.column("text").to_pylist():
            out += [(k, lower(v), lower(x)) for k, v, x in surrogate_text(s, t or "")[1]]
        return dict(zip(("kind", "value", "surrogate"), zip(*out, strict=True) if out else [[]] * 3, strict=True))

    return per_batch(docs.select("text"), f, "kind string, value string, surrogate string").distinct()


def collisions(values: DataFrame) -> DataFrame:
    """Surrogates that stand for two values of a kind, values with two surrogates, and values that stay themselves."""
    one = values.groupBy("kind", F.col("surrogate").alias("what")).agg(F.count_distinct("value").alias("n")).where("n > 1")
    two = values.groupBy("kind", F.col("value").alias("what")).agg(F.count_distinct("surrogate").alias("n")).where("n > 1")
    same = values.where("value = surrogate").select("kind", F.col("value").alias("what"), F.lit(1).cast("long").alias("n"))
    return one.unionByName(two).unionByName(same)


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, how many there are, and the collisions of the whole corpus (0)."""
    docs, key = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark)
    values = materialize(found_values(docs, key), "values")  # three uses; the texts are read once
    bad = collisions(values).agg(F.count("*").alias("n_collisions"))
    return pseudonymise(docs, key, count="n_replaced").join(F.broadcast(bad))  # one row
