"""Format-preserving pseudonyms for personal data.

Values are found by pattern and accepted by validation (Luhn, mod 97, calendar, octets,
assigned SSN areas). An accepted value is numbered within its format, and the number is
permuted by a keyed Feistel network with cycle walking; so the pseudonym has the same format
and passes the same validation, equal values get equal pseudonyms in every document, and
whoever holds the key can go back. Values that can be written in several ways (telephone
numbers, cards, dates, addresses in either case) are permuted by value, not by spelling: a day
has one pseudonym whether it is written 2001-05-13, 13/05/2001, 13.5.2001 or May 13, 2001.

Found are: mail addresses; card numbers of 13 to 19 digits, plain or in groups; telephone
numbers of ten digits in three groups, of ten plain digits if area and exchange can be North
American ones, international ones after ``+``, and national ones after 0 with one separator;
SSNs; IBANs; IPv4 and IPv6 addresses; dates from 1900 to 2099 with year first or last, before
a time too, or with an English month's name; AWS key ids; and values after words such as
``password=``. Two-digit years, other languages' months and names of people aren't.

Rows are independent: no shuffle, no state, and any executor can redo any batch. Null texts
stay null with no values, empty texts stay empty; whole texts are searched whatever their
length. Other columns pass through; the output columns ``n_values`` and ``kinds`` replace
input columns of these names.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import logging
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROUNDS = 10
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
FIRST_YEAR, YEARS = 1900, 200
#: Month names, and the country codes of one and of two digits (all others have three).
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ONE_DIGIT = {"1", "7"}
TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


@lru_cache(maxsize=1)
def late_days() -> list[int]:
    """Ordinals of the days after the twelfth of each month."""
    every = range(datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(FIRST_YEAR + YEARS, 1, 1).toordinal())
    return [d for d in every if datetime.date.fromordinal(d).day > 12]


class Feistel:
    """A keyed permutation of 0 .. n - 1 for each tag and each n."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = hashlib.blake2b(key).digest(), inverse

    def _mix(self, tag: bytes, turn: int, half: int, bits: int) -> int:
        data, out, block = half.to_bytes((half.bit_length() + 8) // 8, "big"), b"", 0
        while len(out) * 8 < bits:
            out += hashlib.blake2b(b"%s|%d|%d|" % (tag, turn, block) + data, key=self.key).digest()
            block += 1
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def __call__(self, tag: str, x: int, n: int) -> int:
        if n < 2:
            return x
        bits = max(2, (n - 1).bit_length())
        a = bits // 2
        b = bits - a
        name = f"{tag}|{n}".encode()
        turns = range(ROUNDS - 1, -1, -1) if self.inverse else range(ROUNDS)
        while True:
            left, right = x >> b, x & ((1 << b) - 1)
            for t in turns:
                if t % 2:
                    right ^= self._mix(name, t, left, b)
                else:
                    left ^= self._mix(name, t, right, a)
            x = left << b | right
            if x < n:
                return x

    def chars(self, tag: str, value: str) -> str:
        """Permutes letters and digits of a string, each within its class; the rest stays."""
        classes = [next((c for c in (LOWER, UPPER, DIGITS) if ch in c), None) for ch in value]
        return self.over(tag, value, classes)

    def over(self, tag: str, value: str, classes: list[str | None]) -> str:
        x, n = 0, 1
        for ch, c in zip(value, classes, strict=True):
            if c:
                x, n = x * len(c) + c.index(ch), n * len(c)
        shape = hashlib.blake2b("".join(c[0] if c else ch for ch, c in zip(value, classes, strict=True)).encode(), digest_size=8).hexdigest()
        x, out = self(f"{tag}|{shape}", x, n), []
        for ch, c in zip(reversed(value), reversed(classes), strict=True):
            if c:
                x, k = divmod(x, len(c))
                out.append(c[k])
            else:
                out.append(ch)
        return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(payload)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _respell(spelling: str, digits: str) -> str:
    """Puts new digits into the places of the old ones."""
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in spelling)


def _card(f: Feistel, v: str) -> str | None:
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    payload = str(f(f"card{len(d)}", int(d[:-1]), 10 ** (len(d) - 1))).zfill(len(d) - 1)
    return _respell(v, payload + luhn_digit(payload))


def _ten(f: Feistel, d: str) -> str:
    """Ten digits: numbers that can be North American (area and exchange from 200 on) are
    permuted among themselves, and the others among themselves."""
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    if area >= 200 and exchange >= 200:
        x = f("phone", ((area - 200) * 800 + exchange - 200) * 10**4 + line, 800 * 800 * 10**4)
        x, line = divmod(x, 10**4)
        return f"{x // 800 + 200:03d}{x % 800 + 200:03d}{line:04d}"
    low = 200 * 10**7
    x = f("phone-", int(d) if area < 200 else low + ((area - 200) * 200 + exchange) * 10**4 + line, low + 800 * 200 * 10**4)
    if x < low:
        return str(x).zfill(10)
    x, line = divmod(x - low, 10**4)
    return f"{x // 200 + 200:03d}{x % 200:03d}{line:04d}"


def _phone(f: Feistel, v: str) -> str | None:
    d = re.sub(r"\D", "", v)
    if v[0] == "+" and not (d[0] == "1" and len(d) == 11):
        code = 1 if d[0] in ONE_DIGIT else 2 if d[:2] in TWO_DIGITS else 3
        rest = d[code:]
        if not 6 <= len(rest) or len(d) > 15:
            return None
        return _respell(v, d[:code] + str(f("phone" + d[:code], int(rest), 10 ** len(rest))).zfill(len(rest)))
    if v[0] == "0" and len(d) != 10 or v[0] == "0" and not re.match(r"\d{3}[ .-]\d{3}[ .-]", v):
        return _respell(v, "0" + str(f("phone0", int(d[1:]), 10 ** (len(d) - 1))).zfill(len(d) - 1))
    if v.isdigit() and (d[0] in "01" or d[3] in "01"):
        return None
    return _respell(v, d[:-10] + _ten(f, d[-10:]))


def _ssn(f: Feistel, v: str) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = f("ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip6(f: Feistel, v: str) -> str | None:
    """By value; the pseudonym is in the usual short spelling."""
    try:
        x = int(ipaddress.IPv6Address(v))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(f("ip6", x, 2**128))) if x >> 32 else None


def _ip(f: Feistel, v: str) -> str | None:
    octets = v.split(".")
    if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
        return None
    x = f("ip", int.from_bytes(bytes(map(int, octets)), "big"), 2**32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(f: Feistel, v: str) -> str | None:
    plain = v.replace(" ", "")
    number = lambda s: int("".join(str(int(ch, 36)) for ch in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = f.chars("iban" + plain[:2], plain[4:])
    check = 98 - number(account + plain[:2] + "00") % 97
    it = iter(plain[:2] + f"{check:02d}" + account)
    return "".join(ch if ch == " " else next(it) for ch in v)


def new_day(f: Feistel, day: datetime.date) -> datetime.date:
    """Days up to the twelfth of a month, and those after it, are permuted among themselves: so
    a spelling that only reads as day first still does, and every spelling has the same day."""
    if day.day <= 12:
        x = f("early day", ((day.year - FIRST_YEAR) * 12 + day.month - 1) * 12 + day.day - 1, YEARS * 144)
        return datetime.date(FIRST_YEAR + x // 144, x // 12 % 12 + 1, x % 12 + 1)
    late = late_days()
    return datetime.date.fromordinal(late[f("late day", bisect_left(late, day.toordinal()), len(late))])


def _date(f: Feistel, v: str) -> str | None:
    """Year first, or year last: with points day first, else month first unless that can't be."""
    a, mark, b, _, c = re.split(r"([-/.])", v)
    if len(a) == 4:
        order, (y, m, d) = "ymd", (a, b, c)
    elif mark != "." and int(a) <= 12:
        order, (m, d, y) = "mdy", (a, b, c)
    else:
        order, (d, m, y) = "dmy", (a, b, c)
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not FIRST_YEAR <= day.year < FIRST_YEAR + YEARS:
        return None
    wide = len(a) + len(b) + len(c) == 8
    day = new_day(f, day)
    part = {"y": f"{day.year:04d}", "m": f"{day.month:02d}" if wide else str(day.month), "d": f"{day.day:02d}" if wide else str(day.day)}
    return mark.join(part[k] for k in order)


def _named_date(f: Feistel, v: str) -> str | None:
    """A date with a month's name, whole or its first three letters. May counts as a whole name."""
    name, (d, y) = re.search(r"[A-Za-z]{3,}", v)[0], re.findall(r"\d+", v)
    month = next(i for i, m in enumerate(MONTHS) if m[:3].lower() == name[:3].lower())
    try:
        day = new_day(f, datetime.date(int(y), month + 1, int(d)))
    except ValueError:
        return None
    new = MONTHS[day.month - 1]
    new = new[:3] if len(name) == 3 and name[:3].lower() != "may" else new
    new = new.upper() if name.isupper() else new.lower() if name.islower() else new
    numbers = iter((f"{day.day:02d}" if d[0] == "0" else str(day.day), str(day.year)))
    return re.sub(r"\d+", lambda _: next(numbers), re.sub(r"[A-Za-z]{3,}", new, v, count=1))


_LOW = str.maketrans(UPPER, LOWER)


def _email(f: Feistel, v: str) -> str:
    """Without regard to case, which stays as it is, place by place."""
    head, dot, top = v.rpartition(".")
    new = f.chars("email", head.translate(_LOW))
    return "".join(x.upper() if y in UPPER else x for x, y in zip(new, head, strict=True)) + dot + top


def _secret(f: Feistel, v: str) -> str:
    return f.over("hex", v, [HEX] * len(v)) if set(v) <= set(HEX) else f.chars("secret", v)


_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
#: (kind, what a text must hold to be searched, pattern, permutation of group "v" or None if
#: it doesn't validate). Earlier kinds win where matches overlap.
KINDS: list[tuple[str, str | None, re.Pattern, Callable[[Feistel, str], str | None]]] = [
    ("secret", "AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])"), lambda f, v: f.over("akia", v, [UPPER + DIGITS] * len(v))),
    ("secret", None, re.compile(r"(?<![A-Za-z0-9])(?:token|password|passwd|pwd|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9+/_-]{8,})", re.I), _secret),
    ("email", "@", re.compile(r"(?<![\w.%+-])(?P<v>[\w.%+-][\w.%+'-]{0,63}@(?:[^\W_](?:[\w-]{0,62})\.){1,8}[^\W\d_]{2,24})(?![\w-])"), _email),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))(?![A-Za-z0-9])"), _iban),
    ("card", None, re.compile(r"(?<![\w.-])(?P<v>\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?!\w)"), _card),
    ("phone", None, re.compile(r"(?<![\w.])(?P<v>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w)"), _phone),
    ("phone", "+", re.compile(r"(?<![\w.+])(?P<v>\+[1-9]\d{0,4}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,8})){1,6})(?!\w)"), _phone),
    ("phone", None, re.compile(r"(?<![\w.,/+-])(?P<v>0[1-9]\d{1,3}[ /-]\d{5,8}|[2-9]\d{2}[2-9]\d{6})(?![\w/-]|[.,]\d)"), _phone),
    ("ssn", None, re.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])"), _ssn),
    ("ip", None, re.compile(r"(?<![\w.])(?P<v>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"), _ip),
    ("ip", ":", re.compile(r"(?<![\w:.])(?P<v>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![\w:.]*[\w:])"), _ip6),
    ("date", None, re.compile(r"(?<![\w/.-])(?P<v>\d{4}([-/])\d{2}\2\d{2}|\d{1,2}([-/])\d{1,2}\3\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?=T\d\d:|(?![\w/-]))"), _date),
    ("date", None, re.compile(rf"(?<!\w)(?P<v>(?:{_MONTH}) \d{{1,2}},? (?:19|20)\d\d|\d{{1,2}}\.? (?:{_MONTH}) (?:19|20)\d\d)(?!\w)", re.I), _named_date),
]
_KEYWORD = re.compile(r"token|passw|pwd|secret|api[_-]?key", re.I)
_DIGIT = re.compile(r"\d")


def pseudonyms(text: str, f: Feistel) -> tuple[str, list[str]]:
    """The text with its values replaced, and the kinds of the values in text order."""
    digit, word = _DIGIT.search(text) is not None, _KEYWORD.search(text) is not None
    if not digit and not word and "@" not in text and "AKIA" not in text:
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))  # places of values found so far
    for i, (kind, mark, pattern, permute) in enumerate(KINDS):
        if mark is not None and mark not in text or i == 1 and not word or i > 2 and not digit:
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v")
            if taken.find(1, a, b) >= 0:
                continue
            new = permute(f, m["v"])
            if new is not None:
                found.append((a, b, new, kind))
                taken[a:b] = b"\x01" * (b - a)
    out, at = [], 0
    for a, b, new, _ in sorted(found):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [k for *_, k in sorted(found)]


_own_keys: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key: what ``spark.lexspan.pii.secret`` holds (a name that Spark redacts in its logs
    and pages). Without one, a random key of the application: values stay linked within it, and
    nobody can go back or link them with another run's."""
    named = spark.conf.get("spark.lexspan.pii.secret", None)
    if named:
        return named.encode()
    app = spark.sparkContext.applicationId
    if app not in _own_keys:
        logging.getLogger(__name__).warning("spark.lexspan.pii.secret is unset: pseudonyms hold for this application alone")
        _own_keys[app] = secrets.token_bytes(32)
    return _own_keys[app]


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """``docs`` with values in ``text`` replaced, ``n_values`` and ``kinds`` (sorted, distinct,
    comma between). ``inverse`` restores what the same key replaced."""
    own = ("n_values", "kinds")
    kept = [f for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([*kept, T.StructField("n_values", T.LongType()), T.StructField("kinds", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key, inverse)
        for batch in batches:
            found = [(None, []) if t is None else pseudonyms(t, f) for t in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array([t for t, _ in found], pa.string())
            columns["n_values"] = pa.array([len(k) for _, k in found], pa.int64())
            columns["kinds"] = pa.array([",".join(sorted(set(k))) for _, k in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(each, schema)
