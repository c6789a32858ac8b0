"""Personal data: keyed format-preserving pseudonyms (Feistel) of validated values."""

import datetime
import hashlib
import ipaddress
import re
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T


ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Cipher:
    """Keyed permutations of the numbers below any n, one for each label."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, x: int, n: int, label: str) -> int:
        """A Feistel network over pairs below (a, b) with a * b >= n, repeated until the number is
        below n again (cycle walking), so that it stays a permutation of the numbers below n."""
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        width = (n.bit_length() + 7) // 8
        head = f"{label}|".encode() + n.to_bytes(width, "big")
        while True:
            left, right = divmod(x, b)
            for turn in range(ROUNDS):
                mod, source = (a, right) if turn % 2 == 0 else (b, left)
                # 64 bits more than a half has, so that all its digits change and none is likelier
                add = int.from_bytes(self.stream(head, turn, source.to_bytes(width, "big"), width + 8), "big")
                if turn % 2 == 0:
                    left = (left + add) % mod
                else:
                    right = (right + add) % mod
            x = left * b + right
            if x < n:
                return x

    def stream(self, head: bytes, turn: int, source: bytes, size: int) -> bytes:
        return hashlib.shake_256(self.key + head + bytes([turn]) + source).digest(size)

    def characters(self, text: str, label: str, sets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
        """Digits become digits, small letters small letters, capitals capitals; the rest stays.

        A Feistel network over the characters themselves: in each round one half's places are turned within their
        sets by numbers drawn from the other half, as many as there are places, so any length is changed
        throughout, in linear time.
        """
        code = np.zeros(128, np.int64)
        size = np.zeros(128, np.int64)
        base = np.zeros(128, np.int64)
        letters = "".join(sets)
        for members in sets:
            for i, c in enumerate(members):
                code[ord(c)], size[ord(c)], base[ord(c)] = i, len(members), letters.index(members)
        out = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
        small = np.where(out < 128, out, 0)
        places = np.flatnonzero(size[small])
        radix, value, offset = (table[small[places]] for table in (size, code, base))
        head = f"{label}|{len(text)}|".encode() + radix.astype(np.uint8).tobytes()
        half = len(places) // 2
        sides = [(slice(None, half), slice(half, None)), (slice(half, None), slice(None, half))]
        for turn in range(ROUNDS):
            source, target = sides[turn % 2]
            n = len(radix[target])
            add = np.frombuffer(self.stream(head, turn, value[source].astype(np.uint8).tobytes(), 4 * n), "<u4")
            value[target] = (value[target] + add) % radix[target]
        table = np.frombuffer(letters.encode("utf-32-le"), "<u4")
        out[places] = table[offset + value]
        return out.tobytes().decode("utf-32-le")


def fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in form)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def card(cipher: Cipher, text: str) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    payload = str(cipher.permute(int(digits[:-1]), 10 ** n, "card")).zfill(n)
    return fill(text, payload + luhn_digit(payload))


# Calling codes of one and two digits; all others have three.
SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
               "81 82 84 86 90 91 92 93 94 95 98".split()}


def calling_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def phone(cipher: Cipher, text: str) -> str | None:
    """North American and international numbers with a plus sign; the country code of the number plan stays, so
    that all spellings of a number get the same digits."""
    digits = "".join(filter(str.isdigit, text))
    code = calling_code(digits)
    rest = digits[len(code):]
    if not 7 <= len(rest) <= 12:
        return None
    return fill(text, code + str(cipher.permute(int(rest), 10 ** len(rest), "phone" + code)).zfill(len(rest)))


def address(cipher: Cipher, text: str) -> str | None:
    try:
        x = int(ipaddress.IPv4Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(cipher.permute(x, 1 << 32, "ipv4")))


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def date(cipher: Cipher, text: str) -> str | None:
    """Calendar dates of 1900 to 2099: 2024-02-29, 2024/02/29, 29.02.2024 and 02/29/2024."""
    form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%Y/%m/%d" if text[4] == "/" else "%m/%d/%Y"}[re.search(r"\D", text)[0]]
    try:
        x = datetime.datetime.strptime(text, form).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= x < DAYS:
        return None
    d = datetime.date.fromordinal(FIRST_DAY + cipher.permute(x, DAYS, "date"))
    return form.replace("%Y", f"{d.year:04}").replace("%m", f"{d.month:02}").replace("%d", f"{d.day:02}")


def ssn(cipher: Cipher, text: str) -> str | None:
    """United States social security numbers: area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(cipher.permute(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def iban(cipher: Cipher, text: str) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = cipher.characters(plain[4:], "iban" + plain[:2])
    source = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02}" + body)
    return "".join(c if c == " " else next(source) for c in text)


def email(cipher: Cipher, text: str) -> str | None:
    """Local part and host in their classes of characters; the top-level domain stays."""
    front, dot, top = text.rpartition(".")
    return cipher.characters(front, "email") + dot + top


def secret(cipher: Cipher, text: str) -> str | None:
    name, value = re.match(r"""(.*?[:=]\s*["']?)(.*)""", text, re.S).groups()
    if len(value) < 8 or not any(map(str.isdigit, value)):
        return None
    if re.fullmatch("[0-9a-f]+", value):
        return name + cipher.characters(value, "hex", (DIGITS + "abcdef",))
    return name + cipher.characters(value, "secret")


# Kind, form, what makes a pseudonym of a valid value (None: not valid, the text stays).
KINDS = [
    ("secret", r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password)\s*[:=]\s*["']?)[A-Za-z0-9_+/=-]{8,}""", secret),
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b", email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", iban),
    ("date", r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|\.\d)", date),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", address),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)", phone),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", card),
]
NAMES = [name for name, _, _ in KINDS]
FORMS = [(name, re.compile(form)) for name, form, _ in KINDS]
# Addresses by mail are looked for from each @ backwards: the run before one may be long.
FORM = re.compile("|".join(f"(?:{form})" for name, form, _ in KINDS if name != "email"))
NAME = 16  # more than the longest name of a secret and the sign behind it
LOCAL = "".join(sorted({*DIGITS, *LOWER, *UPPER, *"._%+-"}))
LOCAL_START = re.compile(r"\b[A-Za-z0-9]")
DOMAIN = re.compile(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b")
MAKE = {name: make for name, _, make in KINDS}
HINT = re.compile(r"\d").search  # every form but an address by mail needs a digit


# Characters of an account number by country, and digits behind the country code where all numbers have as many.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
    "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
PHONE_DIGITS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "91": 10,
                "351": 9, "420": 9}


def ends(kind: str, form: re.Pattern, text: str, m: re.Match) -> list[int]:
    """Ends to try for a value that starts with the match ``m``: the length its country has, then the
    longest first, where a group of characters ends."""
    if kind not in ("iban", "phone", "card"):
        return [m.end()]
    inside = str.isalnum if kind == "iban" else str.isdigit
    found = [e for e in range(m.end(), m.start(), -1)
             if inside(text[e - 1]) and not (e < len(text) and inside(text[e])) and form.fullmatch(text, m.start(), e)]
    size = {e: sum(map(str.isalnum, text[m.start():e])) for e in found}
    if kind == "iban":
        if known := IBAN_LENGTH.get(text[m.start():m.start() + 2]):
            return [e for e in found if size[e] == known] + [e for e in found[:1] if size[e] != known]
    if kind == "phone":
        code = re.match(r"\d+", text[m.start() + 1:m.end()])[0]
        planned = {len(c) + n for c, n in PHONE_DIGITS.items() if code.startswith(c)}
        day = dict(FORMS)["date"].search(text, m.start(), m.end() + 6)  # a date behind the number is none of its groups
        found.sort(key=lambda e: (bool(day) and e > day.start(), size[e] not in planned))
    return found


class Masker:
    """Pseudonyms of a text; the last values seen are kept, which changes no result."""

    def __init__(self, key: bytes, limit: int = 100_000):
        self.cipher, self.known, self.limit = Cipher(key), {}, limit

    def one(self, kind: str, text: str) -> str | None:
        at = (kind, text)
        if at not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[at] = MAKE[kind](self.cipher, text)
        return self.known[at]

    def value(self, text: str, start: int, mail_end: int | None) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the first valid value at a place, over all kinds and lengths. ``mail_end``:
        where a mail address that starts there ends."""
        for kind, form in FORMS:
            if kind == "email":
                found = [mail_end] if mail_end else []
            else:
                found = ends(kind, form, text, m) if (m := form.match(text, start)) else []
            for end in found:
                if (new := self.one(kind, text[start:end])) is not None:
                    return kind, end, new
        return None

    def mask(self, text: str) -> tuple[str, dict[str, int]]:
        found: dict[str, int] = {}
        if "@" not in text and not HINT(text):
            return text, found
        out, at, mails, numbers = [], 0, addresses(text), -1
        mail, m, pos = next(mails, None), None, 0  # pos: where other values are looked for next
        while True:
            while mail and (begins := LOCAL_START.search(text, max(mail[0], at), mail[1])) is None:
                mail = next(mails, None)
            if numbers < pos:
                m = FORM.search(text, pos)
                numbers = m.start() if m else len(text)
            start = min(numbers, begins.start()) if mail else numbers
            if start == len(text):
                break
            valid = self.value(text, start, mail[2] if mail and begins.start() == start else None)
            if valid:
                kind, end, new = valid
                out += [text[at:start], new]
                at = pos = end
                found[kind] = found.get(kind, 0) + 1
            elif failed := FORMS[0][1].match(text, start):
                # a secret without digits: but for an address only a secret whose name ends it can begin in it
                pos = max(start + 1, failed.end() - NAME)
            else:  # look again behind the first character
                pos = start + 1
                while pos < m.end() and text[pos].isdigit() and text[pos - 1].isdigit():
                    pos += 1
        return "".join(out) + text[at:], found


def addresses(text: str):
    """(where the run of local-part characters before an @ begins, the @, end of the domain behind it) of every @
    with a domain."""
    last = 0
    for m in re.finditer("@", text):
        before = text[last:m.start()]
        if domain := DOMAIN.match(text, m.start()):
            yield last + len(before.rstrip(LOCAL)), m.start(), domain.end()
        last = m.end()


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the valid personal values of ``text_col`` replaced, and n_<kind> for each kind.

    Card numbers (Luhn), account numbers (mod 97), dates (calendar), IPv4 addresses, social security
    numbers, phone numbers, mail addresses and secrets behind a name are permuted under ``key`` within
    their format and validity: equal values get equal pseudonyms in every document and run, different
    ones different pseudonyms. Numbers that fail their check stay as they are. Nothing is joined or
    shuffled. Null texts stay null with zero counts; other columns, and columns named like the new
    ones (which are replaced), don't matter.
    """
    new = [f"n_{name}" for name in NAMES]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema
    at = kept.index(text_col)

    def work(batches):
        masker = Masker(key)
        for b in batches:
            masked, counts = [], []
            for text in b.column(at).to_pylist():
                text, found = (None, {}) if text is None else masker.mask(text)
                masked.append(text)
                counts.append(found)
            columns = list(b.columns)
            columns[at] = pa.array(masked, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c.get(n, 0) for c in counts], pa.int64()) for n in NAMES)],
                                             names=[*kept, *new])

    out = type(schema)(schema.fields)
    for name in new:
        out = out.add(name, T.LongType())
    return docs.select(*kept).mapInArrow(work, out)
