"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Validated values are found in whole texts, each taken as a number within the numbers that
its format allows, that number permuted with a key, and the result written in the same
format: separators, lengths and check digits hold, equal values get equal pseudonyms in
every document, and whoever has the key can undo them.

    card      13 to 19 digits with a right Luhn digit; new digits, new Luhn digit
    ssn       ddd-dd-dddd within the allocated ranges
    phone     country code kept, all digits after it, whatever separates them
    ipv4      four octets
    date      a day from 1900 to 2099 as y-m-d, d.m.y or m/d/y; another such day
    iban      right check digits; country kept, new account, new check digits
    email     the local part, letters as letters and digits as digits; the domain stays
    secret    the value after token, password, secret or key: class by class

Defined cases: a null text stays null without findings; values that fail validation stay;
values that overlap are taken from the left, longest format first; a value with only one
form in its format stays what it is; texts of any length are searched whole; ids are
integers. `pseudonymise` reads the named columns only; `replace` takes `text` and, where it
is there, `n_chars`, and leaves all other columns as they are, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


class Permutation:
    """A keyed permutation of 0..n-1 for any n: a Feistel network over the smallest square
    that holds n, walked until it lands below n again."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, i: int, n: int, what: str, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{what}|{n}|{i}|{half}".encode(), "sha256"), "big")

    def apply(self, x: int, n: int, what: str) -> int:
        if n < 2:
            return x
        side = math.isqrt(n - 1) + 1
        while True:
            left, right = divmod(x, side)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, n, what, right)) % side
            x = left * side + right
            if x < n:
                return x

    def undo(self, x: int, n: int, what: str) -> int:
        if n < 2:
            return x
        side = math.isqrt(n - 1) + 1
        while True:
            left, right = divmod(x, side)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(i, n, what, left)) % side, left
            x = left * side + right
            if x < n:
                return x


Move = Callable[[int, int, str], int]


def _luhn(digits: str) -> int:
    """The digit that makes `digits` with it valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _filled(shape: str, digits: str) -> str:
    """`shape` with its digits replaced."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _card(value: str, move: Move) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or _luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    body = str(move(int(d[:-1]), 10**n, f"card{n}")).zfill(n)
    return _filled(value, body + str(_luhn(body)))


def _ssn(value: str, move: Move) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    at = area - 1 - (area > 666)
    x = move((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    at, x = divmod(x, 99 * 9999)
    return f"{at + 1 + (at >= 665):03d}-{x // 9999 + 1:02d}-{x % 9999 + 1:04d}"


#: The country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(value: str, move: Move) -> str | None:
    d = _digits(value)
    code = ""
    if value.startswith("+"):
        code = d[0] if d[0] in "17" else d[:2] if d[:2] in _TWO_DIGIT_CODES else d[:3]
        if d[0] == "0" or len(d) > 15:
            return None
        d = d[len(code) :]
    if not 7 <= len(d) <= 13:
        return None
    return _filled(value, code + str(move(int(d), 10 ** len(d), f"phone{len(d)}")).zfill(len(d)))


def _ipv4(value: str, move: Move) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    x = 0
    for o in octets:
        x = x << 8 | int(o)
    x = move(x, 2**32, "ipv4")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _date(value: str, move: Move) -> str | None:
    a, mark, b, _, c = re.match(r"(\d+)([-./])(\d+)([-./])(\d+)", value).groups()
    order = "ymd" if mark == "-" else "dmy" if mark == "." else "mdy"
    part = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + move(day, _DAYS, "date"))
    text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(text[k] for k in order)


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _classes(value: str, move: Move, what: str) -> str:
    """Digits permuted as digits, letters as letters of the same case, other marks kept."""
    out = list(value)
    for name, first, last in (("0", "0", "9"), ("a", "a", "z"), ("A", "A", "Z")):
        at = [i for i, c in enumerate(value) if first <= c <= last]
        radix = ord(last) - ord(first) + 1
        x = 0
        for i in at:
            x = x * radix + ord(value[i]) - ord(first)
        x = move(x, radix ** len(at), f"{what}{name}{len(at)}") if at else 0
        for i in reversed(at):
            x, d = divmod(x, radix)
            out[i] = chr(ord(first) + d)
    return "".join(out)


def _iban(value: str, move: Move) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = _classes(plain[4:], move, "iban")
    new = iter(plain[:2] + _iban_check(plain[:2], account) + account)
    return "".join(c if c == " " else next(new) for c in value)


def _email(value: str, move: Move) -> str | None:
    local, _, domain = value.rpartition("@")
    return _classes(local, move, "email") + "@" + domain


_HEX = "0123456789abcdef"


def _secret(value: str, move: Move) -> str | None:
    if all(c in _HEX for c in value):
        n = len(value)
        return format(move(int(value, 16), 16**n, f"hex{n}"), "x").zfill(n)
    return _classes(value, move, "secret")


#: Kind, form and validation; earlier ones win where several begin at one place.
_NUMBERS = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban),
    ("phone", r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)", _phone),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\w)", _phone),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])", _date),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ipv4),
    ("phone", r"(?<![\w-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])", _phone),
    ("card", r"(?<![\w-])(?:\d{4}[ -]){3}\d{1,7}(?![\w-])|(?<![\w-])\d{4}[ -]\d{6}[ -]\d{4,5}(?![\w-])|(?<!\w)\d{13,19}(?!\w)", _card),
)
_MAKERS = {f"k{i}": (kind, make) for i, (kind, _, make) in enumerate(_NUMBERS)}
_NUMBER = re.compile("|".join(f"(?P<k{i}>{form})" for i, (_, form, _) in enumerate(_NUMBERS)))
#: Every form has a run of digits, or begins as an IBAN does (its bank code may be letters,
#: far from the first run); only the words beside one are looked at closely.
_NEAR_DIGITS = re.compile(r"\d[\d.:/()+ -]{5,}|\d{4}[A-Z0-9 ]{6,}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}")
#: No form of a number is longer: an IBAN of 34 signs has 8 spaces, a card 19 digits, a
#: phone 15 digits with a separator and brackets at most at each group.
LONGEST = 64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NAMES = ("token", "password", "passwd", "secret", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key")
_VALUE = re.compile(r"\s*[\"']?([A-Za-z0-9_+/~.-]{6,}[A-Za-z0-9_+/~=-])")


def _back(text: str, at: int, signs) -> int:
    """Where the run of `signs` that ends at `at` begins."""
    while at and text[at - 1] in signs:
        at -= 1
    return at


def _named(text: str, at: int) -> bool:
    """Whether the sign at `at` follows the name of a secret."""
    while at and text[at - 1].isspace():
        at -= 1
    at -= text[at - 1 : at] in ("'", '"')
    return text[max(0, at - 10) : at].lower().endswith(_NAMES)


def _SAME(x: int, n: int, what: str) -> int:  # noqa: N802, ARG001
    """The move that moves nothing: makers then only validate."""
    return x


def _candidates(text: str):
    """(start, end, kind, maker) of what may be a value, in any order."""
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and text[at - 1 : at] != ".":
            first = _back(text, at, _LOCAL)
            while first < at and text[first] == ".":
                first += 1
            if first < at:
                yield first, domain.end(), "email", _email
        at = text.find("@", at + 1)
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            if _named(text, at) and (value := _VALUE.match(text, at + 1)):
                yield value.start(1), value.end(1), "secret", _secret
            at = text.find(sign, at + 1)
    done = 0
    for near in _NEAR_DIGITS.finditer(text):
        lo = max(done, near.start() - LONGEST)
        hi = min(len(text), near.end() + LONGEST)
        while hi < len(text) and text[hi].isalnum():
            hi += 1
        # a form that fails validation may hide one that begins within it
        while (m := _NUMBER.search(text, lo, hi)) and m.start() < near.end():
            kind, make = _MAKERS[m.lastgroup]
            if make(m.group(), _SAME) is None:
                lo = m.start() + 1
            else:
                yield m.start(), m.end(), kind, make
                lo = done = m.end()


def pseudonymised(text: str | None, move: Move) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with its values replaced, and (start, end, kind) in the original."""
    if not text:
        return text, []
    parts, at, found = [], 0, []
    for start, end, kind, make in sorted(_candidates(text), key=lambda c: (c[0], -c[1])):
        if start >= at and (new := make(text[start:end], move)) is not None:
            parts += [text[at:start], new]
            at = end
            found.append((start, end, kind))
    return "".join([*parts, text[at:]]) if found else text, found


@lru_cache(8)
def _mover(key: bytes) -> Move:
    return lru_cache(100_000)(Permutation(key).apply)


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymise(documents: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_found, found spans of the original text, and the text with pseudonyms."""
    common.text_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        move = _mover(key)
        for b in batches:
            done = [pseudonymised(t, move) for t in b.column(1).to_pylist()]
            found = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for _, f in done], SPAN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for _, f in done], pa.int64()), found, pa.array([t for t, _ in done], pa.string())], ["doc_id", "n_found", "found", "text"])

    return docs.mapInArrow(common.lean(run), "doc_id long, n_found long, found array<struct<start:int,end:int,kind:string>>, text string")


#: A session names the secret here; the name keeps it out of the event log.
KEY_SETTING = "spark.aerolith.pseudonym.secret"
EXAMPLE_KEY = b"aerolith example key"


def key_of(spark: SparkSession) -> bytes:
    """The session's secret, or a published example key that protects nobody."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else EXAMPLE_KEY


def replace(documents: DataFrame, key: bytes) -> DataFrame:
    """`documents` with pseudonyms in text and n_chars counted anew; columns and rows stay."""
    common.text_batches(documents.sparkSession)

    def run(batches):
        move = _mover(key)
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [pseudonymised(t, move)[0] for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                columns[n] = pa.array([len(y) if x is not y else k for x, y, k in zip(old, new, columns[n].to_pylist(), strict=True)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return documents.mapInArrow(common.lean(run), documents.schema)
