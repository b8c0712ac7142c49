"""Pseudonyms: whole secrets, formats by brute force, and time on long texts."""

import random
import re
import string
import time

import pytest

from turnwise.llm import pii

KEY = b"key"


@pytest.mark.parametrize("n", [16, 17, 40, 44, 200, 400, 2000, 9000])
@pytest.mark.parametrize("letters", [string.ascii_letters, string.ascii_lowercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "._-+/="])
def test_nothing_of_a_secret_stays(n, letters):
    rng = random.Random(n)
    seen = set()
    for _ in range(3):
        value = "x" + "".join(rng.choice(letters) for _ in range(n - 1))
        text = f"api_key: {value} end"
        new, kinds = pii.pseudonymise(text, KEY)
        fresh = new[9:-4]
        seen.add(fresh)
        assert kinds == ["secret"] and len(fresh) == n and pii.pseudonymise(new, KEY, back=True)[0] == text
        same = sum(a == b for a, b in zip(value, fresh, strict=True) if a.isalnum())
        assert same <= max(6, 0.25 * n) and value[:8] not in new and value[-8:] not in new
        # One changed letter at the end changes all of the pseudonym.
        other = pii.pseudonymise(f"api_key: {value[:-1]}{'a' if value[-1] != 'a' else 'b'} end", KEY)[0][9:-4]
        if n >= 40 and value[-1].isalnum() == other[-1].isalnum():
            assert sum(a == b for a, b in zip(other, fresh, strict=True)) <= 0.5 * n
    assert len(seen) == 3


def test_symbols_are_a_permutation():
    for shape in ("a", "7", "a7", "b0C"):
        pool = [""]
        for c in shape:
            pool = [p + x for p in pool for x in (string.digits if c.isdigit() else string.ascii_lowercase if c.islower() else string.ascii_uppercase)]
        to = [pii.symbols(v, KEY) for v in pool]
        assert sorted(to) == sorted(pool) and [pii.symbols(v, KEY, back=True) for v in to] == pool


def test_wide_numbers_are_permuted_as_a_whole():
    size = 10**200
    a, b = (pii.permute(v, size, KEY, "t") for v in (12345, 12346))
    assert pii.permute(a, size, KEY, "t", None, True) == 12345 and len(str(a)) > 190 and f"{a:0200d}"[:60] != f"{b:0200d}"[:60]


def test_tokens_with_dots_and_digits_of_other_scripts():
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    new = pii.pseudonymise(f"token={token}", KEY)[0]
    assert new.count(".") == 2 and not any(part in new for part in token.split("."))
    for text in ("am ٢٠٢٤-٠١-٠٢ um 5", "٤١١١١١١١١١١١١١١١ 1"):
        assert pii.pseudonymise(text, KEY) == (text, [])


def test_bank_accounts():
    for value in ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"):
        new, kinds = pii.pseudonymise(f"to {value}.", KEY)
        assert kinds == ["iban"] and value not in new and re.sub("[0-9]", "9", new[5:]).count(" ") == value[2:].count(" ")
        assert pii.pseudonymise(new, KEY, back=True)[0] == f"to {value}."
    assert pii.pseudonymise("to GB83 WEST 1234 5698 7654 32.", KEY)[1] == []


def changed(text):
    new, kinds = pii.pseudonymise(text, KEY)
    assert pii.pseudonymise(new, KEY, back=True) == (text, kinds)
    return new, kinds


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("order 12 4111 1111 1111 1111", "card", "4111 1111 1111 1111"), ("4111 1111 1111 1111 12 x", "card", "4111 1111 1111 1111"), ("id 7 378282246310005 9", "card", "378282246310005"), ("pay BE68 5390 0754 7034 CODE", "iban", "BE68 5390 0754 7034"),
        ("DE89 3704 0044 0532 0130 00 EUR", "iban", "DE89 3704 0044 0532 0130 00"), ("call +14155552671 now", "phone", "4155552671"), ("t: +33 1 42 68 53 00.", "phone", "1 42 68 53 00"), ("or 415.555.2671", "phone", "415.555.2671"), ("born 1985/03/12", "date", "1985/03/12"), ("on 1985.03.12.", "date", "1985.03.12"),
        ("at 3/9/1999", "date", "3/9/1999"), ("password: hunter2", "secret", "hunter2"), ("passwd=p@ssW0rd!", "secret", "p@ssW0rd!"), ("token: aB3x", "secret", "aB3x"), ("+442079460958", "phone", "2079460958"), ("+44 20 7946 0958", "phone", "20 7946 0958"),
    ],
)
def test_what_was_missed_is_found(text, kind, value):
    new, kinds = changed(text)
    assert kinds == [kind] and value in text and value not in new and len(new) == len(text)
    assert re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", new)) == re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", text))


def test_clean_text_stays():
    for text in ("the password: required", "secret: none of it", "token: word", "version 1.2.3.4.5 of 2024", "4111 1111 1111 1112", "in 12 34 56", "+1 2 3", "31.02.2024 1985/13/40", "a 1/2/3", "call 020 7946 0958"):
        assert pii.pseudonymise(text, KEY) == (text, [])


def by_hand(text):
    """Cards and accounts of a text of words and blanks: at every word, what ends latest at the end of a word and is valid."""
    cuts = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    found, at = [], 0
    while at < len(cuts):
        for last in range(len(cuts) - 1, at - 1, -1):
            x = text[cuts[at][0] : cuts[last][1]]
            plain = x.replace(" ", "")
            if re.fullmatch("[0-9]{13,19}", plain) and "  " not in x and plain[0] in "3456" and len(set(plain)) > 1:
                digits = [int(d) for d in reversed(plain)]
                if sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
                    found.append((cuts[at][0], cuts[last][1]))
                    at = last
                    break
        at += 1
    return found


def test_cards_in_rows_of_numbers_by_brute_force():
    rng = random.Random(3)
    more = 0
    for _ in range(1500):
        groups = [rng.choice("0123456789") + "".join(rng.choice("0123456789") for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 3, 5, 7, 14]))) for _ in range(rng.randrange(3, 14))]
        if rng.random() < 0.7:
            payload = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
            whole = payload + str(pii.luhn_digit(payload))
            groups.insert(rng.randrange(len(groups) + 1), " ".join(whole[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.6 else whole)
        if rng.random() < 0.3:
            groups.insert(rng.randrange(len(groups) + 1), "x")
        text = " ".join(groups)
        spans = [(a, b) for k, a, b in pii.values(text)]
        assert spans == by_hand(text), text
        new, kinds = changed(text)
        assert [(a, b) for _, a, b in pii.values(new)] == spans and kinds == ["card"] * len(spans)
        assert all(text[a:b] != new[a:b] for a, b in spans)
        more += len(spans) > 1
    assert more > 20


def test_neighbouring_values_of_all_kinds_are_undone():
    rng = random.Random(8)
    pieces = ["4111 1111 1111 1111", "12", "BE68 5390 0754 7034", "+33 1 42 68 53 00", "+14155552671", "415.555.2671", "1985/03/12", "3/9/1999", "10.0.0.1", "123-45-6789", "a.b@c.org", "token=aB3xaB3xaB3xaB3x", "5", "A", "GB82 WEST 1234 5698 7654 32", "212-555-0187", "0", "2024-02-29", "192.168.10.250", "378282246310005"]
    for _ in range(600):
        changed(rng.choice([" ", " ", "-", ", ", ": "]).join(rng.choices(pieces, k=rng.randrange(1, 9))))


@pytest.mark.parametrize("piece", ["4 5 ", "4111 ", "a", "1", "a.", "a@", "@", "token", "token=", "1-", "1 ", "+1 ", "A1", "a-"])
def test_time_is_linear(piece):
    text = "5 " + piece * (1_000_000 // len(piece))
    began = time.process_time()
    pii.pseudonymise(text, KEY)
    assert time.process_time() - began < 20
