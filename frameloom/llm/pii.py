"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their kind's check, e-mail addresses and quoted secrets are replaced by
values of the same format from a keyed Feistel permutation of that format's values. The permutation
depends on kind, format and key only, so equal values stay equal in every document, whatever
separators they are written with; no value maps to itself. What fails its check stays as it is, but for
values that begin inside it, or IBANs and phone numbers that end before its last groups.

Kinds: email, ip (IPv4), card (Luhn), phone, ssn (US), iban (mod 97), date (calendar dates of years
1000 to 9999), secret (16 or more hex digits, 0-9 among them, that follow token, key, secret or password).

Values are found in the whole text and replaced whole, however long they are.

Defined results: a null text stays null with counts 0; empty texts and texts without such values come
back unchanged; a very long text or value is handled whole, in one task; rows are handled one by
one, so ties, repeated rows and other columns don't matter (of those, the counts' columns replace such
as have their names); an empty table gives an empty table. A null or empty key is refused.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "date", "secret")

_PATTERN = re.compile(
    r"""(?P<secret>(?<![A-Za-z])(?:token|key|secret|password|passwd|apikey|api_key)\s*[=:]\s*["']?[0-9a-fA-F]{16,}(?![0-9a-zA-Z]))
    |(?<![0-9A-Za-z])(?P<iban>(?-i:[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?))(?![0-9A-Za-z])
    |(?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])
    |(?<![0-9])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])
    |(?<![0-9])(?P<card>[0-9]{4}(?P<sep>[ \-])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7}|[0-9]{4}(?P<amex>[ \-])[0-9]{6}(?P=amex)[0-9]{5}|[0-9]{13,19})(?![0-9])
    |(?<![0-9])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])
    |(?<![0-9])(?P<phone>(?:\+?[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])""",
    re.VERBOSE | re.IGNORECASE,
)
#: What follows an e-mail address's @. The part before it is found from there, so that a long run is read once.
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")


class Feistel:
    """A keyed permutation of 0..n-1 without fixed points.

    An alternating Feistel network over Z_a x Z_b with a * b just above n, walked until it lands
    below n, is the permutation s; x goes to s(s^-1(x) + k mod n) with a keyed k, 0 < k < n.
    """

    def __init__(self, key: bytes, tweak: str, n: int, rounds: int = 10):
        self.n, self.rounds, self.tweak = n, rounds, tweak.encode()
        self.a = math.isqrt(max(0, n - 1)) + 1
        self.b = -(-n // self.a)
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.shift = 1 + self._f(b"shift", 0, n) % (n - 1) if n > 1 else 0

    def _f(self, name: bytes, value: int, n: int) -> int:
        """A keyed function's value below n; the keys have one length, so no other key's input begins with this one."""
        given = b"|".join([self.key + self.tweak, name, value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")])
        return int.from_bytes(hashlib.shake_256(given).digest((n.bit_length() + 7) // 8 + 8), "big") % n

    def _walk(self, x: int, forward: bool) -> int:
        while True:
            left, right = divmod(x, self.b)
            for r in range(self.rounds) if forward else range(self.rounds - 1, -1, -1):
                name, sign = str(r).encode(), 1 if forward else -1
                if r % 2:
                    right = (right + sign * self._f(name, left, self.b)) % self.b
                else:
                    left = (left + sign * self._f(name, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, False) + self.shift) % self.n, True) if self.n > 1 else x

    def inverse(self, y: int) -> int:
        return self._walk((self._walk(y, False) - self.shift) % self.n, True) if self.n > 1 else y


def _joined(digits: list[int], radix: list[int]) -> tuple[int, int]:
    """The number with these digits, and how many there are. By halves, as values may be very long."""
    if len(digits) > 32:
        half = len(digits) // 2
        (high, n), (low, m) = _joined(digits[:half], radix[:half]), _joined(digits[half:], radix[half:])
        return high * m + low, n * m
    x = 0
    for d, r in zip(digits, radix, strict=True):
        x = x * r + d
    return x, math.prod(radix)


def _spread(x: int, radix: list[int]) -> list[int]:
    """The number's digits."""
    if len(radix) > 32:
        half = len(radix) // 2
        high, low = divmod(x, _joined([0] * (len(radix) - half), radix[half:])[1])
        return _spread(high, radix[:half]) + _spread(low, radix[half:])
    out = []
    for r in reversed(radix):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _permute_text(key: bytes, kind: str, value: str, hexadecimal: bool = False) -> str:
    """Digits go to digits, letters to letters in the case they had; all else stays. Case doesn't tell values apart."""
    classes = ["x" if hexadecimal and c in "0123456789abcdefABCDEF" else "9" if "0" <= c <= "9" else "a" if c.isascii() and c.isalpha() else c.lower() for c in value]
    radix = [{"x": 16, "9": 10, "a": 26}.get(c, 1) if len(c) == 1 else 1 for c in classes]
    if not hexadecimal:
        radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in value]
    x, n = _joined([0 if r == 1 else int(c, 16) if r < 26 else ord(c.lower()) - 97 for c, r in zip(value, radix, strict=True)], radix)
    if n < 2:
        return value
    out = []
    for c, r, d in zip(value, radix, _spread(Feistel(key, f"{kind}:{''.join(classes)}", n)(x), radix), strict=True):
        new = c if r == 1 else "0123456789abcdef"[d] if r < 26 else chr(97 + d)
        out.append(new.upper() if r > 10 and c.isupper() else new)
    return "".join(out).upper() if hexadecimal and value.upper() == value else "".join(out)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(key: bytes, value: str) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    new = str(Feistel(key, f"card:{len(d)}", 10 ** (len(d) - 1))(int(d[:-1]))).zfill(len(d) - 1)
    return _refill(value, new + luhn_digit(new))


def _ip(key: bytes, value: str) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = 0
    for p in parts:
        x = x * 256 + int(p)
    return ".".join(map(str, Feistel(key, "ip", 1 << 32)(x).to_bytes(4, "big")))


def _phone(key: bytes, value: str) -> str | None:
    d = _digits(value)
    if not 9 <= len(d) <= 15:
        return None
    area = re.match(r"\+[0-9]{1,3}(?=[ .\-(])|[0-9]{1,3}(?=[ .\-]?\()", value)
    country = _digits(area[0]) if area else ""
    own = d[len(country) :]
    return _refill(value, country + str(Feistel(key, f"phone:{country}:{len(own)}", 10 ** len(own))(int(own))).zfill(len(own)))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(key: bytes, value: str) -> str | None:
    d = _digits(value)
    if not _ssn_ok(d):
        return None
    permute = Feistel(key, "ssn", 10**9)
    while not _ssn_ok(d := str(permute(int(d))).zfill(9)):
        pass
    return _refill(value, d)


def _mod97(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value)) % 97


def _iban(key: bytes, value: str) -> str | None:
    plain = value.replace(" ", "")
    if plain != plain.upper() or not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    own = _permute_text(key, f"iban:{plain[:2]}", plain[4:])
    new = iter(f"{plain[:2]}{98 - _mod97(own + plain[:2] + '00'):02d}{own}")
    return "".join(c if c == " " else next(new) for c in value)


def _date(key: bytes, value: str) -> str | None:
    parts = re.split("([./-])", value)
    a, b, c = (int(parts[k]) for k in (0, 2, 4))
    if len(parts[0]) == 4:
        orders = [(0, 1, 2)]
    elif parts[1] == ".":
        orders = [(2, 1, 0)]
    else:
        orders = [(2, 0, 1), (2, 1, 0)]  # month first with slashes, unless only day first is a date
    for order in orders:
        y, m, d = ((a, b, c)[k] for k in order)
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        if y < 1000:
            return None
        first, last = datetime.date(y // 100 * 100, 1, 1), datetime.date(y // 100 * 100 + 99, 12, 31)
        n = (last - first).days + 1
        new = first + datetime.timedelta(Feistel(key, f"date:{y // 100}", n)((day - first).days))
        fields = {order[0]: new.year, order[1]: new.month, order[2]: new.day}
        wide = [len(parts[k]) for k in (0, 2, 4)]
        padded = any(parts[k].startswith("0") for k in (0, 2))
        text = [str(fields[k]).zfill(4 if order[0] == k else 2 if wide[k] == 2 and (padded or order[0] == 0) else 1) for k in range(3)]
        return f"{text[0]}{parts[1]}{text[1]}{parts[3]}{text[2]}"
    return None


def _email(key: bytes, value: str) -> str | None:
    local, _, domain = value.rpartition("@")
    labels = domain.split(".")
    own, kept = ".".join(labels[:-2]), ".".join(labels[-2:])
    new = _permute_text(key, f"email:{kept.lower()}", f"{local}@{own}" if own else local)
    return f"{new}.{kept}" if own else f"{new}@{kept}"


def _secret(key: bytes, value: str) -> str | None:
    if not any("0" <= c <= "9" for c in value):
        return None
    head, own = re.fullmatch(r"(.*[=:]\s*[\"']?)([0-9a-fA-F]+)", value, re.DOTALL).groups()
    return head + _permute_text(key, "secret", own, hexadecimal=True)


_BY_KIND: dict[str, Callable[[bytes, str], str | None]] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "ssn": _ssn, "iban": _iban, "date": _date, "secret": _secret}


@lru_cache(maxsize=1 << 16)
def _remembered(key: bytes, kind: str, value: str) -> str | None:
    return _BY_KIND[kind](key, value)


def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    """The value's pseudonym, or None if the value fails its kind's check. Values of an ordinary length are remembered."""
    return _remembered(key, kind, value) if len(value) <= 100 else _BY_KIND[kind](key, value)


_MARKED = re.compile(r"[0-9@]\S*+")
#: More characters than any value but an e-mail address or a secret has. Only these have no greatest length, and neither has a space after its first digit or @.
_LONGEST = 48


def _token_start(text: str, at: int, least: int) -> int:
    """Where what stands between spaces or line ends begins, or ``least``."""
    return max(least, text.rfind(" ", least, at) + 1, text.rfind("\n", least, at) + 1)


def _before_spaces(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def _windows(text: str) -> list[list[int]]:
    """Parts of the text that hold every value with all that its pattern reads, however long it is.

    Every kind has a digit or @. A part goes from the begin of what stands between spaces around one (with the
    name and = or : of a secret before that) to its end and _LONGEST characters on, for groups that follow.
    """
    out: list[list[int]] = []
    for found in _MARKED.finditer(text):
        end = found.end() + _LONGEST
        least = out[-1][1] if out else 0
        if found.start() <= least and out:
            out[-1][1] = end
            continue
        start = _token_start(text, found.start(), least)
        sign = _before_spaces(text, start, least)
        if sign > least and text[sign - 1] in "=:":
            start = _token_start(text, _before_spaces(text, sign - 1, least), least)
        if out and start <= least:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [[s, min(e, len(text))] for s, e in out]


#: Kinds whose pattern may take in groups of letters or digits that follow the value.
_GROUPED = ("iban", "phone")


def _shorter(text: str, key: bytes, kind: str, begin: int, end: int) -> tuple[int, str | None]:
    """The end and the pseudonym of the longest value from ``begin`` that ends before a separator and passes its check."""
    for stop in range(end - 1, begin, -1):
        if text[stop] in " .-":
            found = _PATTERN.fullmatch(text, begin, stop)
            if found and found[kind] is not None and (new := pseudonym(key, kind, found[kind])) is not None:
                return stop, new
    return end, None


def _next_email(text: str, pos: int, stop: int) -> tuple[int, int, int] | None:
    """Begin, @ and end of the first e-mail address."""
    at = text.find("@", pos, stop)
    while at >= 0:
        begin = at
        while begin > pos and ((c := text[begin - 1]).isalnum() or c in "_.%+-"):
            begin -= 1
        if begin < at and (found := _DOMAIN.match(text, at + 1, stop)):
            return begin, at, found.end()
        pos, at = at, text.find("@", at + 1, stop)
    return None


def replace(text: str, key: bytes, windows: list[list[int]] | None = None) -> tuple[str, list[int]]:
    """The text with pseudonyms, and how many of each of KINDS it has. Of values that begin at one place an
    e-mail address comes first."""
    counts, out, at, pos = [0] * len(KINDS), [], 0, 0
    for start, stop in _windows(text) if windows is None else windows:
        pos = max(pos, start)
        mail, found = _next_email(text, pos, stop), _PATTERN.search(text, pos, stop)
        while mail or found:
            if mail and (not found or mail[0] <= found.start()):
                kind, begin, end = "email", mail[0], mail[2]
                new = pseudonym(key, kind, text[begin:end])
            else:
                kind = next(k for k in KINDS[1:] if found[k] is not None)
                begin, end = found.span(kind)
                new = pseudonym(key, kind, found[kind])
                if new is None and kind in _GROUPED:
                    end, new = _shorter(text, key, kind, begin, end)
            if new is not None:
                counts[KINDS.index(kind)] += 1
                out += [text[at:begin], new]
                at = pos = end
            else:
                pos = begin + 1  # another value may begin inside
            if mail and mail[0] < pos:
                mail = (pos, *mail[1:]) if pos < mail[1] else _next_email(text, pos, stop)
            if found and found.start() < pos:
                found = _PATTERN.search(text, pos, stop)
    return "".join([*out, text[at:]]), counts


#: Where a session names the key of its pseudonyms.
KEY_NAME = "spark.frameloom.pii.key"


def session_key(spark: SparkSession) -> str:
    """The key that the session names. Without one, a random key is drawn for this application: pseudonyms are
    linked within its results, and nobody can invert them or link them with another run's."""
    key = spark.conf.get(KEY_NAME, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_NAME, key)
    return key


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` pseudonymised; with ``counts``, also a column n_<kind> for each kind, which
    replaces a column of that name."""
    if not key:
        raise ValueError("pseudonyms need a key")
    names = [f"n_{k}" for k in KINDS] if counts else []
    given = docs.drop(*names) if counts else docs
    schema = T.StructType(list(given.schema.fields))
    for name in names:
        schema = schema.add(name, "long")
    secret = key.encode()
    at = given.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            marked = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
            some = marked.to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            found = [[0] * batch.num_rows for _ in KINDS]
            if some:
                changed = [replace(value, secret) for value in texts.filter(marked).to_pylist()]
                texts = pc.replace_with_mask(texts, marked, pa.array([c[0] for c in changed], texts.type))
                for i, (_, n) in zip(some, changed, strict=True):
                    for k, c in enumerate(n):
                        found[k][i] = c
            columns = [texts if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in found[: len(names)]]], names=[*batch.schema.names, *names])

    return given.mapInArrow(run, schema)


def digest(docs: DataFrame, key: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the new text and the counts by kind."""
    return pseudonymise(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), key)
