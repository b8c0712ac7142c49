"""Format-preserving pseudonyms for personal data by a keyed Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049


def _stream(key: bytes, label: str, n: int) -> bytes:
    """n keyed bytes for a label."""
    blocks = (hashlib.blake2b(f"{k}|{label}".encode(), key=key[:64], digest_size=64).digest() for k in range(-(-n // 64)))
    return b"".join(blocks)[:n]


def _noise(key: bytes, tweak: str, turn: int, value: int, size: int) -> int:
    """A number far wider than size, so that its remainder has no trend."""
    return int.from_bytes(_stream(key, f"{tweak}|{turn}|{value:x}", size.bit_length() // 8 + 16), "big")


def permute(value: int, size: int, key: bytes, tweak: str, valid=None, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: rounds add to one half what is hashed from the other, and what lands outside is
    permuted again. With `valid`, values that it accepts go to such values, and the rest to the rest. back: the inverse."""
    left_size = 1 << ((size - 1).bit_length() + 1) // 2 if size > 1 else 1
    right_size = -(-size // left_size)
    kind = bool(valid(value)) if valid else True
    while True:
        left, right = value % left_size, value // left_size
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * _noise(key, tweak, turn, left, right_size)) % right_size
            else:
                left = (left + sign * _noise(key, tweak, turn, right, left_size)) % left_size
        value = right * left_size + left
        if value < size and (valid is None or bool(valid(value)) == kind):
            return value


def luhn_digit(payload: str) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _always(found: str) -> bool:
    return True


def card(found: str, key: bytes, back=False, fits=_always) -> str | None:
    d = _digits(found)
    if d[0] not in "3456" or not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    made = lambda v: _refill(found, (new := f"{v:0{n}d}") + str(luhn_digit(new)))
    return made(permute(int(d[:-1]), 10**n, key, f"card{n}", lambda v: f"{v:0{n}d}"[0] in "3456" and fits(made(v)), back))


#: Calling codes of one and of two digits; the others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(found: str, key: bytes, back=False, fits=_always) -> str | None:
    d = _digits(found)
    own = next((k for k in (1, 2) if d[:k] in _CODES), 3) if found[0] == "+" else 0
    tail, n = d[own:], len(d) - own
    if n < 7 or len(d) > 15:
        return None
    usual = lambda v: (s := f"{v:0{n}d}")[0] not in "01" and (n < 10 or s[3] not in "01")
    made, kind = lambda v: _refill(found, d[:own] + f"{v:0{n}d}"), usual(int(tail))
    return made(permute(int(tail), 10**n, key, f"phone{n}", lambda v: usual(v) == kind and fits(made(v)), back))


def ssn(found: str, key: bytes, back=False, fits=_always) -> str | None:
    ok = lambda v: (s := f"{v:09d}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    v, made = int(_digits(found)), lambda v: _refill(found, f"{v:09d}")
    return made(permute(v, 10**9, key, "ssn", lambda v: ok(v) and fits(made(v)), back)) if ok(v) else None


def ip(found: str, key: bytes, back=False, fits=_always) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = sum(int(p) << (24 - 8 * i) for i, p in enumerate(parts))
    usual, made = lambda x: 0 < x >> 24 < 224, lambda x: ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    return made(permute(v, 1 << 32, key, "ip", lambda x: usual(x) == usual(v) and fits(made(x)), back))


def date(found: str, key: bytes, back=False, fits=_always) -> str | None:
    a, b, c = re.split(r"[-/.]", found)
    first = len(a) == 4
    year, month, day = (a, b, c) if first else (c, b, a)
    american = not first and int(month) > 12
    if american:
        month, day = day, month
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None

    def made(v: int) -> str:
        new = datetime.date.fromordinal(v + _FIRST_DAY)
        y, m, d = f"{new.year:04d}", f"{new.month:0{len(month)}d}", f"{new.day:0{len(day)}d}"
        mark = [x for x in found if x in "-/."]
        return "".join((y, mark[0], m, mark[1], d) if first else (m, mark[0], d, mark[1], y) if american else (d, mark[0], m, mark[1], y))

    # A date written with the month first must stay one that can't be read the other way, and the reverse; one digit stays one.
    late = lambda v: datetime.date.fromordinal(v + _FIRST_DAY).day > 12
    kind, label = late(at), "date" if len(month) == len(day) == 2 else f"date{len(month)}{len(day)}"
    return made(permute(at, _DAYS, key, label, lambda v: late(v) == kind and len(made(v)) == len(found) and fits(made(v)), back))


_SETS = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "H": "0123456789ABCDEF"}


def _kinds(found: str) -> str:
    """The set of each character; a character of no set stands for itself. h and H: a string of hex digits, not of digits alone."""
    if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", found) and not found.isdigit():
        return ("H" if found != found.lower() else "h") * len(found)
    return "".join("9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "-" for c in found)


def symbols(found: str, key: bytes, back=False, fits=_always, tweak="text") -> str:
    """Letters stay letters of their case and digits digits; a string of hex digits stays one.

    The halves are rows of symbols: a round adds to each symbol of one half a number hashed from all of the other half, so that
    every symbol depends on all, whatever the length, in linear time. What would be read as of other sets is permuted again."""
    kinds = _kinds(found)
    at = [i for i, k in enumerate(kinds) if k != "-"]
    if not at:
        return found
    bases = [len(_SETS[kinds[i]]) for i in at]
    values = [_SETS[kinds[i]].index(found[i]) for i in at]
    label = f"{tweak}|{hashlib.sha256(kinds.encode()).hexdigest()}"
    middle = (len(at) + 1) // 2
    out = list(found)
    while True:
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (0, middle) if turn % 2 else (middle, len(at))
            noise = _stream(key, f"{label}|{turn}|{hashlib.sha256(bytes(values[:a] + values[b:])).hexdigest()}", 4 * (b - a))
            sign = -1 if back else 1
            for i in range(a, b):
                values[i] = (values[i] + sign * int.from_bytes(noise[4 * (i - a) : 4 * (i - a) + 4], "big")) % bases[i]
        for i, v in zip(at, values, strict=True):
            out[i] = _SETS[kinds[i]][v]
        new = "".join(out)
        if _kinds(new) == kinds and fits(new):
            return new


#: The lengths of bank account numbers by country.
_ACCOUNTS = dict(
    x.split(":") for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 "
        "LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)


def _number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban(found: str, key: bytes, back=False, fits=_always) -> str | None:
    """The country stays, the account is permuted within its shape and gets its own check digits."""
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or len(plain) != int(_ACCOUNTS.get(plain[:2], len(plain))) or _number(plain[4:] + plain[:4]) % 97 != 1:
        return None

    def made(account: str) -> str:
        rest = iter(f"{plain[:2]}{98 - _number(f'{account}{plain[:2]}00') % 97:02d}{account}")
        return "".join(c if c == " " else next(rest) for c in found)

    return made(symbols(plain[4:], key, back, lambda x: fits(made(x)), f"iban{plain[:2]}"))


def email(found: str, key: bytes, back=False, fits=_always) -> str:
    local, _, host = found.partition("@")
    return f"{symbols(local, key, back, tweak='email')}@{host}"


def secret(found: str, key: bytes, back=False, fits=_always) -> str | None:
    """A short value must look like one: with a digit, or with small letters and capitals that aren't just its first."""
    if len(found) < 16 and not re.search(r"[0-9]|[a-z].*[A-Z]", found):
        return None
    return symbols(found, key, back)


#: Kind, pattern of the value (a group named v where more than the value is matched), its pseudonym or None if it isn't valid.
KINDS = (
    ("secret", r"(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\b[^\w\n]{0,12}[=:][^\w\n]{0,12})(?P<secret>[A-Za-z0-9_.~+/=!@#$%^&*?-]{4,})", secret),
    ("email", r"(?<![\w.+%-])(?P<email>[\w.+%-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", email),
    ("iban", r"\b(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b", iban),
    ("date", r"(?<![\d./])(?P<date>[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\d])", date),
    ("ip", r"(?<![\d.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.?\d)", ip),
    ("ssn", r"(?<![\d-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\d-])", ssn),
    (
        "phone",
        r"(?<![\w])(?P<phone>\+[1-9][0-9]{7,14}|\+[0-9]{1,3}[^\w\n(]{0,6}\(?[0-9]{2,4}\)?[^\w\n]{1,6}[0-9]{3,4}[^\w\n]{1,3}[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,4}\)?){2,6}|\([0-9]{3}\)[^\w\n]{0,6}[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|(?<![.])[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?!\d)",
        phone,
    ),
    ("card", r"(?<![\w+])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?!\d)", card),
)
_ALL = re.compile("|".join(p for _, p, _ in KINDS))
_MAKE = {k: f for k, _, f in KINDS}
_ANY = re.compile(r"[0-9@]|(?i:secret|passw|token|api[_-]?key|access[_-]?key)")
#: Characters beside a value that can be part of another reading of it: no value of digits is longer.
_NEAR = 80
_PARTED = re.compile(r"(?<=[0-9A-Z])[ -]")


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "secret":
        return secret(found, b"") is not None if len(found) < 16 else True
    if kind == "card":
        d = _digits(found)
        return d[0] in "3456" and 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == int(d[-1])
    if kind == "iban":
        plain = found.replace(" ", "")
        return 15 <= len(plain) <= 34 and len(plain) == int(_ACCOUNTS.get(plain[:2], len(plain))) and _number(plain[4:] + plain[:4]) % 97 == 1
    if kind == "phone":
        d = _digits(found)
        return 7 <= len(d) - (next((k for k in (1, 2) if d[:k] in _CODES), 3) if found[0] == "+" else 0) and len(d) <= 15
    if kind == "ssn":
        d = _digits(found)
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "ip":
        return all(int(p) < 256 and (len(p) == 1 or p[0] != "0") for p in found.split("."))
    a, b, c = re.split(r"[-/.]", found)
    year, month, day = map(int, (a, b, c) if len(a) == 4 else (c, a, b) if int(b) > 12 else (c, b, a))
    try:
        return 0 <= datetime.date(year, month, day).toordinal() - _FIRST_DAY < _DAYS
    except ValueError:
        return False


def values(text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the validated values of a text in order. Numbers in groups are tried whole, then without their last
    groups; where no reading is valid, the search goes on behind the first character, so that a value after it isn't lost."""
    while m := _ALL.search(text, at):
        kind = m.lastgroup
        start, end = m.span(kind)
        ends = [end]
        if kind in ("card", "iban"):
            ends += [start + x.start() for x in reversed([*_PARTED.finditer(text[start:end])]) if x.start() >= 13]
        for end in ends:
            if _valid(kind, text[start:end]):
                yield kind, start, end
                at = end
                break
        else:
            at = start + 1 if kind != "secret" else ends[0]


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[str]]:
    """text with every validated value replaced, and the kinds of what was replaced in order. back: undo it.

    A pseudonym is one that, between its neighbours, is read where its value was: others are permuted again. Values are replaced
    from the left and undone from the right, so that both see a value between the same neighbours."""
    if not text or not _ANY.search(text):
        return text, []
    spans = list(values(text))
    pieces, kinds, edge, right = [], [], len(text) if back else 0, ""
    made: list[tuple[str, int, int]] = []  # the values on the left as they are read in the changed text
    left, size = "", 0  # its last characters, and how many it has
    for k, (kind, start, end) in reversed([*enumerate(spans)]) if back else enumerate(spans):
        plain = text[end:edge] if back else text[edge:start]
        if back:
            right = (plain + right)[:_NEAR]
            before, after, at, seen = text[max(0, start - _NEAR - 1) : start], right, start, spans[max(0, k - _NEAR) : k]
        else:
            left, size = (left + plain)[-_NEAR - 1 :], size + len(plain)
            before, after, at, seen = left, text[end : end + _NEAR], size, made[-_NEAR:]
        # Reading starts where no value of digits can reach this one, and the values between must be read as they are.
        shift = at - len(before)
        begin = max([1 if shift else 0, *(b - shift for _, a, b in seen if a - shift < 1)] if shift else [0])
        wanted = [(x, a - shift, b - shift) for x, a, b in seen if a - shift >= begin]

        def fits(new: str, kind=kind, before=before, after=after, begin=begin, wanted=wanted) -> bool:
            want = [*wanted, (kind, len(before), len(before) + len(new))]
            return [*itertools.islice(values(before + new + after, begin), len(want))] == want

        old = text[start:end]
        new = _MAKE[kind](old, key, back, fits) or old
        pieces += [plain, new]
        if back:
            right, edge = (new + right)[:_NEAR], start
        else:
            made.append((kind, size, size + len(new)))
            left, size, edge = (left + new)[-_NEAR - 1 :], size + len(new), end
        if new != old:
            kinds.append(kind)
    pieces.append(text[:edge] if back else text[edge:])
    return ("".join(reversed(pieces)), kinds[::-1]) if back else ("".join(pieces), kinds)


def pseudonyms(docs: DataFrame, key: bytes = b"turnwise-example-key") -> DataFrame:
    """doc_id, text, n_values, kinds of every row: the whole text with its personal values replaced, how many, and their distinct
    kinds in name order.

    Cards must pass the Luhn test, bank accounts theirs by 97, and dates, addresses and numbers their ranges; what fails is left
    alone. Only ASCII digits make a value. Equal values of a
    kind get equal pseudonyms in all documents, whatever their punctuation. Null text stays null, empty text empty, both
    with 0 values; repeated rows are changed alike. Rows are independent: nothing is shuffled. The key in use must be passed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [pseudonymise(x.as_py(), key) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([len(k) for _, k in found], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in found], pa.string())],
                    ["doc_id", "text", "n_values", "kinds"],
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, text string, n_values long, kinds string")
