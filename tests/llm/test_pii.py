"""Surrogates: permutations, formats, coreference, nothing left behind."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastercube.llm import pii

S = pii.Surrogates(b"test")


@pytest.mark.parametrize("radices", [[10, 10], [26], [5, 21], [256, 3], [2]])
def test_permutation_without_fixed_points(radices):
    from itertools import product

    seen = {tuple(S.digits("t", list(x), radices)): x for x in product(*map(range, radices))}
    assert len(seen) == len(list(product(*map(range, radices))))
    assert all(k != v for k, v in seen.items())


@settings(max_examples=200, deadline=None)
@given(st.text("abcxyzAÉéжβ19.-", min_size=1, max_size=20))
def test_pattern_keeps_shape_and_case(x):
    y = S.pattern("k", x, pii._CLASS)
    assert len(x) == len(y) and x != y or not re.search(r"[^.\-]", x)
    for a, b in zip(x, y, strict=True):
        assert (a.isdigit(), a.isalpha(), a.isupper()) == (b.isdigit(), b.isalpha(), b.isupper()) and (a == b or a.isalnum())
    assert pii.lower(S.pattern("k", x.upper(), pii._CLASS)) == pii.lower(y)


def replaced(text):
    return pii.surrogate_text(S, text)[0]


def test_formats():
    text = "Write ana.34@mail7.example.com or +1 (017) 555-7713, 4689387053447877, 4111 1111 1111 1111; 12.84.156.107. DE89 3704 0044 0532 0130 00, 123-45-6789."
    new, done = pii.surrogate_text(S, text)
    assert [k for k, _, _ in done] == ["email", "phone", "card", "card", "ip", "iban", "ssn"]
    assert all(v not in new and x in new for _, v, x in done)
    assert re.sub(r"\d+|[a-z]+", "", new, flags=re.I)[:20] == re.sub(r"\d+|[a-z]+", "", text, flags=re.I)[:20]
    by = {k: x for k, _, x in done}
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", by["email"])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", by["phone"])
    card = by["card"].replace(" ", "")
    assert pii.luhn(card[:-1]) == int(card[-1])
    bare = by["iban"].replace(" ", "")
    assert bare[:2] == "DE" and pii.iban_check("DE", bare[4:]) == bare[2:4]
    assert max(map(int, by["ip"].split("."))) < 256


def test_names():
    new = replaced("Mrs Anna Smith met Herr Peter Großmann. Mrs Smith and Dr Anna left; Госпожа Мария Иванова. Mr Smith's")
    f, m = pii.GIVEN["f", "latin"], pii.GIVEN["m", "latin"]
    a, last, b, _, last2, c = re.match(r"Mrs (\w+) (\w+) met Herr (\w+) (\w+)\. Mrs (\w+) and Dr (\w+) left", new).groups()
    assert a == c and a.lower() in f and b.lower() in m and last == last2 != "Smith"
    assert re.search(r"Госпожа [А-Яа-яё]+ [А-Яа-яё]+\. Mr " + last + "'s", new)


def test_whole_names_and_mentions():
    for text, parts in (
        ("Herr Dr. Peter Müller kam", "Peter Müller"), ("Prof. Dr. Heike Braun kam", "Heike Braun"), ("Señora María García López vino", "María García López"),
        ("Mr. John Paul Smith left", "John Paul Smith"), ("Herr von Braun kam", "Braun"), ("Mr  Smith left", "Smith"), ("Mr.\nSmith left", "Smith"), ("Dr. J. R. Miller left", "Miller"),
    ):
        new = replaced(text)
        assert not [x for x in parts.split() if x in new], (text, new)
        assert new.split()[0] == text.split()[0] and new.split()[-1] == text.split()[-1]
        assert ("Dr." in text) == ("Dr." in new) and ("von" in text) == ("von" in new)
    new = replaced("Mr John Smith came. Later Smith and Anna Smith left; Smith's smith stayed.")
    last = re.match(r"Mr \w+ (\w+) came", new)[1]
    anna = replaced("Mrs Anna Smith").split()[1]
    assert new.split(" came. ")[1] == f"Later {last} and {anna} {last} left; {last}'s smith stayed."


def test_names_without_titles():
    new = replaced("Mrs Anna Schmidt called. Anna said hi. Schmidt left.")
    first, last = re.match(r"Mrs (\w+) (\w+) called", new).groups()
    assert new == f"Mrs {first} {last} called. {first} said hi. {last} left." and first != "Anna" and last != "Schmidt"
    for text, parts in (
        ("My name is Priya Patel, write to me", "Priya Patel"), ("Ich heiße Jörg Müller und komme", "Jörg Müller"), ("me llamo Lucía Ortega y vivo", "Lucía Ortega"), ("je m'appelle Amélie Dubois et", "Amélie Dubois"),
        ("Dear Laura,\nthanks", "Laura"), ("we met Anna Schmidt there", "Anna Schmidt"), ("Name: Peter Novak\nCity", "Peter Novak"), ("Regards,\nDaniel Weber", "Daniel Weber"),
    ):
        new = replaced(text)
        assert not [x for x in parts.split() if x in new], (text, new)
        assert len(new.split()) == len(text.split())
    for text in ("Dear reader, the name of the game", "Regards to all", "Die Rose und der Wald", "Anna", "the full name is long"):
        assert replaced(text) == text, text


def test_types_stay_what_they_are():
    for ip, check in (("192.168.1.1", r"192\.168\."), ("10.1.2.3", r"10\."), ("172.20.1.1", r"172\.(1[6-9]|2\d|3[01])\."), ("127.0.0.1", r"127\.")):
        new = replaced(f"at {ip} now")[3:-4]
        assert re.match(check, new) and new != ip
    assert all(not pii.reserved(list(map(int, S.ip(*f"8.{i}.4.4".split(".")).split(".")))) for i in range(200))
    assert len({S.ip("192", "168", str(i // 256), str(i % 256)) for i in range(65536)}) == 65536  # all of a range, one to one
    card = replaced("pay 4111 1111 1111 1111 now").removeprefix("pay ").removesuffix(" now").replace(" ", "")
    assert card.startswith("411111") and pii.luhn(card[:-1]) == int(card[-1]) and card != "4111111111111111"
    for i in range(50):
        a, b = re.match(r"\((\d)\d\d\) (\d)", S.phone(f"(2{i:02d}) 555-0{i:03d}")).groups()
        assert a in "23456789" and b in "23456789"
        assert S.phone(f"030 1{i:06d}")[0] == "0" != S.phone(f"030 1{i:06d}")[1]


def test_dates_of_birth_and_addresses():
    for text, shape in (("born on 1980-03-12.", r"born on (19|20)\d\d-\d\d-\d\d\."), ("DOB: 25/12/1975", r"DOB: \d\d/\d\d/(19|20)\d\d"), ("geboren am 3.4.1990 in", r"geboren am \d+\.\d+\.(19|20)\d\d in"), ("née le 07/06/2001", r"née le \d\d/\d\d/(19|20)\d\d")):
        new = replaced(text)
        assert re.fullmatch(shape, new) and new != text
    days = {S.date(str(y), f"{m:02d}", f"{d:02d}") for y in range(1980, 1990) for m in range(1, 13) for d in range(1, 29)}
    assert len(days) == 10 * 12 * 28 and None not in days
    for text in ("on 1980-03-12 it rained", "in 12/03/2020"):
        assert replaced(text) == text
    for text, kept in (("at 12 Maple Street, ", "Street"), ("Bergmannstraße 14 ist", "straße"), ("14 rue de Rivoli, ", "rue de"), ("Calle Mayor, 7 en", "Calle")):
        new = replaced(text)
        assert kept in new and new != text and re.sub(r"\w", "", new) == re.sub(r"\w", "", text), (text, new)
        assert not [w for w in ("Maple", "Bergmann", "Rivoli", "Mayor") if w in new]


def test_query_counts_collisions(spark, tmp_path, make):
    make([(1, "Mr John Doe, 12.84.156.107", "a"), (2, None, None), (2, "Mr Jane Doe", "b")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_replaced, r.n_collisions) for r in pii.op2_pii_surrogates(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 0), (2, 0, 0), (2, 1, 0)}


def test_national_telephones():
    for number in ("030 1234567", "0171/2345678", "01 23 45 67 89", "01.23.45.67.89", "020 7946 0958", "(030) 1234567", "912 345 678", "555 123 4567", "1-800-555-1234", "017612345678"):
        new, done = pii.surrogate_text(S, f"call {number} now")
        assert [k for k, _, _ in done] == ["phone"] and number not in new, number
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {number} now")
    for text in ("on 01.02.2024 and 01/02/2024 or 01-02-2024", "12 345 678 rows", "version 0.12.34"):
        assert replaced(text) == text


def test_coreference_over_formats():
    assert replaced("A.b@Example.com a.b@example.com").lower().split()[0] == replaced("a.b@example.com")
    strip = lambda x: re.sub(r"\D", "", x)
    assert strip(replaced("call 017-555-7713 now")) == strip(replaced("call (017) 555-7713 now"))


def test_table(tricky, make):
    text = "ana.34@mail7.example.com +1 (017) 555-7713 4689387053447877 12.84.156.107 Mr John Doe"
    docs = tricky.unionByName(make([(90, text, "a"), (91, text.upper(), "a"), (92, text.replace("ana.34", "ana.35"), None)]))
    out = pii.pseudonymise(docs, b"test")
    assert out.columns == docs.columns and out.count() == docs.count()
    new = {r.doc_id: r for r in out.collect()}
    old = {r.doc_id: r for r in docs.collect()}
    assert new[3].text == "" and new[4].text is None and new[8].text == old[8].text and new[90]._key == "clash"
    assert new[90].n_chars == len(new[90].text) and new[8].n_chars is None
    assert new[90].text.split()[0] != new[92].text.split()[0] and new[90].text.split()[1:] == new[92].text.split()[1:]
    assert pii.collisions(pii.found_values(docs, b"test")).count() == 0
    assert pii.pseudonymise(docs.limit(0), b"test").count() == 0
    assert pii.pseudonymise(docs, b"test", count="n").agg({"n": "sum"}).first()[0] == 5 + 5 + 5
