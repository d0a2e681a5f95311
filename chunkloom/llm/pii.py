"""Operator 9: format-preserving Feistel pseudonyms for validated personal data.

A found value is checked (Luhn digit, mod-97, calendar, octet ranges, the written form of a phone), turned
into a number of its domain, permuted there by an alternating Feistel network keyed per kind, and written
back in the same format: digits stay digits, letters letters of their script, separators and check digits
stay right. The permutation depends on the value alone, never on place or punctuation, so equal values stay
linked across documents; being a bijection it keeps different values apart (but for ``moved``). Values
outside a domain's valid part are walked past (cycle walking). Names of months are read and written in
English, German, Spanish and French.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm._frames import replacing, slices

KEY = b"replace this key"  #: of the query, whose result must be repeatable; ``pseudonymise`` has no default
ROUNDS = 10
CHUNK = 64  #: signs of a value that are permuted together

_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _digest(message: bytes, size: int, key: bytes) -> int:
    """A keyed digest of any number of bytes: blake2b, by counter beyond its 64."""
    if size <= 64:
        return int.from_bytes(hashlib.blake2b(message, key=key[:64], digest_size=size).digest(), "big")
    return int.from_bytes(b"".join(hashlib.blake2b(b"%d|" % i + message, key=key[:64]).digest() for i in range(-(-size // 64))), "big")


def feistel(x: int, a: int, b: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0 .. a * b - 1 by ROUNDS rounds that alternate between the two parts."""
    left, right = divmod(x, b)
    for r in range(ROUNDS):
        other = right if r % 2 == 0 else left
        f = _digest(f"{kind}|{a}|{b}|{r}|{other}".encode(), 16 + (a * b).bit_length() // 8, key)
        if r % 2 == 0:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left * b + right


def split(n: int) -> tuple[int, int]:
    """Two factors whose product is at least n, near its square root."""
    a = max(2, int(n**0.5) if n < 1 << 52 else 1 << ((n.bit_length() + 1) // 2))
    return a, max(2, -(-n // a))


def permute(x: int, n: int, key: bytes, kind: str, valid=None) -> int:
    """Cycle walking: the first value after x that lies below n and is ``valid``; x must be so itself."""
    a, b = split(n)
    while True:
        x = feistel(x, a, b, key, kind)
        if x < n and (valid is None or valid(x)):
            return x


def moved(x: int, n: int, key: bytes, kind: str, valid=None) -> int:
    """``permute``, once more where it leaves x in its place, by another key; still x only if the domain is tiny.

    Two inputs may then share a pseudonym with the odds of 1 in n; no value is left in the clear for it.
    """
    for again in range(8):
        y = permute(x, n, key, f"{kind}{again or ''}", valid)
        if y != x:
            return y
    return x


def luhn(digits: str) -> int:
    """The check digit of a number without one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _letters(first: int, last: int, lower: bool) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha() and c.islower() == lower)


#: Classes within which signs are exchanged: digits, and per script and case its letters.
_RADIX = ["0123456789", *(_letters(a, b, low) for a, b in ((0x41, 0x7A), (0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x4FF)) for low in (True, False)), _letters(0x4E00, 0x9FFF, False), _letters(0x3040, 0x30FF, False), _letters(0xAC00, 0xD7A3, False)]
_CLASS = {c: s for s in reversed(_RADIX) for c in s}


def by_class(value: str, key: bytes, kind: str, classes=None) -> str:
    """Letters and digits permuted together, each within its class; other signs stay.

    Longer values go by CHUNK signs, each under a key of all that stands before it, which keeps different
    values apart and takes time in proportion to the length.
    """
    if len(value) > CHUNK:
        before, out = hashlib.blake2b(digest_size=16), []
        for a in range(0, len(value), CHUNK):
            part = value[a : a + CHUNK]
            out.append(by_class(part, key, f"{kind}|{before.hexdigest()}" if a else kind, classes))
            before.update(part.encode("utf-8", "surrogatepass"))
        return "".join(out)
    sets = classes or _RADIX
    x, n, places = 0, 1, []
    for c in value:
        s = next((s for s in sets if c in s), None) if classes else _CLASS.get(c)
        places.append(s)
        if s:
            x, n = x * len(s) + s.index(c), n * len(s)
    if n < 2:
        return value
    # letters and separators fix the domain, so that equal shapes only share a permutation
    shape = "".join("." if s is None else str(sets.index(s)) for s in places)
    y, out = moved(x, n, key, f"{kind}|{shape}"), []
    for c, s in zip(reversed(value), reversed(places)):
        if s:
            y, d = divmod(y, len(s))
            c = s[d]
        out.append(c)
    return "".join(reversed(out))


def _card(m, key):
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) < 2:
        return None
    n = 10 ** (len(digits) - 1)
    lead = n // 10
    y = str(moved(int(digits[:-1]), n, key, f"card{len(digits)}", lambda v: v >= lead))
    return _fill(m, y + str(luhn(y)))


def _nanp(x: int) -> bool:
    s = f"{x:010d}"
    return s[0] >= "2" and s[3] >= "2" and s[1:3] != "11" and s[4:6] != "11"


def _phone(m, key):
    digits = re.sub(r"\D", "", m)
    body = digits[-10:]
    if len(digits) in (10, 11) and (len(digits) == 10 or digits[0] == "1") and "+" not in m.replace("+1", "", 1):
        if _nanp(int(body)):
            return _fill(m, digits[:-10] + f"{moved(int(body), 10**10, key, 'phone', _nanp):010d}")
        # written as a phone, though no such area or exchange exists: permuted among its like
        return _fill(m, digits[:-10] + f"{moved(int(body), 10**10, key, 'phone-loose', lambda v: not _nanp(v)):010d}")
    if m.lstrip().startswith("+") and 8 <= len(digits) <= 15:
        cc = 1 if digits[0] in "17" else 2
        rest, n = digits[cc:], 10 ** (len(digits) - cc)
        return _fill(m, digits[:cc] + f"{moved(int(rest), n, key, f'phone{len(digits)}'):0{len(rest)}d}")
    if m[0] == "0" and 9 <= len(digits) <= 12:  # within a country: the first 0 stays
        return _fill(m, "0" + f"{moved(int(digits[1:]), 10 ** (len(digits) - 1), key, f'national{len(digits)}'):0{len(digits) - 1}d}")
    return None


def _ip(m, key):
    parts = m.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, moved(x, 1 << 32, key, "ip").to_bytes(4, "big")))


def _ssn(m, key):
    ok = lambda v: 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 and v % 10**4
    x = int(re.sub(r"\D", "", m))
    return _fill(m, f"{moved(x, 10**9, key, 'ssn', ok):09d}") if ok(x) else None


def _mod97(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(m, key):
    plain = m.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or _mod97(plain[:2], plain[4:]) != plain[2:4]:
        return None
    if m.upper() != m and _IBAN_CHARS.get(plain[:2]) != len(plain):  # words are written like that too
        return None
    body = by_class(plain[4:], key, "iban" + plain[:2])
    it = iter(plain[:2] + _mod97(plain[:2], body) + body)
    return "".join(" " if c == " " else next(it).lower() if c.islower() else next(it) for c in m)


#: Lengths by country, without spaces.
_IBAN_CHARS = {
    k: n
    for n, all_of in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in all_of.split()
}


def _own_iban(m: str) -> str:
    """The part of a match that is as long as its country's IBANs and valid; where there is none, all of it."""
    ends = [i + 1 for i, c in enumerate(m) if c != " "]
    size = _IBAN_CHARS.get(m[:2].upper(), len(ends))
    if len(ends) > size and m[ends[size - 1]] == " ":
        plain = m[: ends[size - 1]].replace(" ", "").upper()
        if _mod97(plain[:2], plain[4:]) == plain[2:4]:
            return m[: ends[size - 1]]
    return m


#: By language, full names and abbreviations in the order of the months.
_NAMES = {
    "en": ("january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec"),
    "de": ("januar februar märz april mai juni juli august september oktober november dezember", "jan feb mär apr mai jun jul aug sep okt nov dez"),
    "es": ("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sep oct nov dic"),
    "fr": ("janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "janv févr mars avr mai juin juil août sept oct nov déc"),
}
#: A month's name -> its number, language and form (0 full, 1 abbreviated) in each language that has it.
_MONTHS: dict[str, list[tuple[int, str, int]]] = {}
for _l, _forms in _NAMES.items():
    for _k, _all in enumerate(_forms):
        for _i, _name in enumerate(_all.split()):
            _MONTHS.setdefault(_name, []).append((_i + 1, _l, _k))
_MONTHS["sept"].insert(0, (9, "en", 1))
_MONTHS["setiembre"] = [(9, "es", 0)]
_NAMED = re.compile(r"(\d{1,2})(\.|er|st|nd|rd|th)?( de | )([^\W\d_]+)(\.?,?)( del? | )(\d{4})|([^\W\d_]+)(\.? )(\d{1,2})(st|nd|rd|th)?(,? )(\d{4})")


def _day(year: int, month: int, day: int) -> int | None:
    try:
        x = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    return x if _FIRST_DAY <= x <= _LAST_DAY else None


def _other_day(x: int, key: bytes) -> datetime.date:
    return datetime.date.fromordinal(_FIRST_DAY + moved(x - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _date(m, key):
    """Any notation of a day gives the same new day in that notation; leading zeros are kept where they were."""
    if named := _NAMED.fullmatch(m):
        g = named.groups()
        day, month, year = (g[0], g[3], g[6]) if g[0] else (g[9], g[7], g[12])
        known = _MONTHS.get(month.lower())
        if not known:
            return None
        # of languages that share a name, the one whose notation it is
        wanted = "es" if " de" in m else "de" if g[1] == "." else "fr" if g[1] == "er" or month.islower() else "en"
        number, language, form = next((k for k in known if k[1] == wanted), known[0])
        x = _day(int(year), number, int(day))
        if x is None:
            return None
        y = _other_day(x, key)
        name = _NAMES[language][form].split()[y.month - 1]
        name = name.upper() if month.isupper() else name.capitalize() if month[0].isupper() else name
        d = f"{y.day:0{len(day)}d}" if day[0] == "0" else str(y.day)
        if not g[0]:
            return f"{name}{g[8]}{d}{_ordinal(y.day) if g[10] else ''}{g[11]}{y.year}"
        mark = g[1] or ""
        mark = _ordinal(y.day) if mark in ("st", "nd", "rd", "th") else ("er" if y.day == 1 else "") if language == "fr" and mark != "." else mark
        return f"{d}{mark}{g[2]}{name}{g[4]}{g[5]}{y.year}"
    a, s1, b, s2, c = re.fullmatch(r"(\d{1,4})([-/.])(\d{1,2})([-/.])(\d{1,4})", m).groups()
    if s1 != s2 or (len(a) < 4) == (len(c) < 4):
        return None
    if len(a) == 4:
        order = "ymd"
    elif s1 == "/" and int(a) <= 12:
        order = "mdy"
    else:
        order = "dmy"
    part = dict(zip(order, (a, b, c)))
    x = _day(int(part["y"]), int(part["m"]), int(part["d"]))
    if x is None:
        return None
    y = _other_day(x, key)
    padded = any(len(part[k]) == 2 and part[k][0] == "0" for k in "md") or len(part["m"]) == len(part["d"]) == 2
    new = {"y": str(y.year), "m": f"{y.month:02d}" if padded else str(y.month), "d": f"{y.day:02d}" if padded else str(y.day)}
    return s1.join(new[k] for k in order)


def _email(m, key):
    local, _, domain = m.rpartition("@")
    # case doesn't tell mailboxes apart
    return by_class(local.lower(), key, "email|" + domain.lower()) + "@" + domain


def _aws(m, key):
    return m[:4] + by_class(m[4:], key, "access key", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0189"])


def _hex(m, key):
    return by_class(m, key, "hex", ["0123456789abcdef", "ABCDEF"])


def _secret(m, key):
    head, value = re.fullmatch(r"(.*?[=:]\s*[\"']?)([^\s\"']+)", m, re.S).groups()
    return head + (_hex(value, key) if re.fullmatch(r"[0-9a-f]+", value) else by_class(value, key, "secret"))


_KINDS = {"email": _email, "secret": _secret, "aws": _aws, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}

#: Every alternative starts at a letter or digit of its own; the scan meets each sign once.
_FINDER = re.compile(
    r"(?<![\w.@+%-])(?P<email>[^\W_][\w.+%-]*+@(?:[^\W_](?:[\w-]{0,62})\.)+[^\W\d_]{2,24})"
    r"|(?<!\w)(?P<secret>(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_.-][^\s\"']{6,}[A-Za-z0-9+/_=-])"
    r"|(?<!\w)(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})(?!\w)"
    r"|(?<!\w)(?P<iban>[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
    r"|(?<![\w./-])(?P<date>\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
    r"|\d{1,2}(?:\.|er|st|nd|rd|th)?(?: de | )[^\W\d_]{3,10}\.?,?(?: del? | )\d{4}|[^\W\d_]{3,10}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4})(?![\w/-])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<!\w)(?P<card>\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\w)"
    r"|(?<!\w)(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"
    r"|0[1-9](?:[ .-]\d{2}){4}|0[1-9]\d{1,3}(?:[ /]|-|/-)\d{3,8}(?:[ -]\d{1,5})?)(?!\w)"
)
_DIGIT = re.compile(r"[0-9@]")  #: any value has one, but for passwords, which have one of the two signs below


@lru_cache(1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value in its place, or None where it isn't valid."""
    return _KINDS[kind](value, key)


def scrub(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with every validated value replaced, and the kinds found in their order."""
    if not text or not ("=" in text or ":" in text or _DIGIT.search(text)):
        return text, []
    out, at, kinds, scan = [], 0, [], 0
    while m := _FINDER.search(text, scan):
        kind, value = m.lastgroup, m.group()
        if kind == "iban":
            value = _own_iban(value)
        new = pseudonym(kind, value, key)
        if new is None:  # what isn't valid as a whole may hold something that is
            scan = m.start() + 1
            continue
        out += text[at : m.start()], new
        kinds.append(kind)
        at = scan = m.start() + len(value)
    out.append(text[at:])
    return "".join(out), kinds


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; rows, order of columns and other columns stay.

    Null and empty texts stay as they are; a value that fails its check (a wrong Luhn digit, 31 February)
    is left alone, what lies within it is still looked at. Repeated rows give the same text again. An empty
    table gives an empty one. Columns of any other name pass through. Whole texts and whole values (addresses
    and secrets of any length) are taken, in time proportional to them.
    """
    return replacing(docs, "text", lambda texts: [scrub(t, key)[0] for t in texts])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document: its text after pseudonymisation, how many values were replaced, and of what kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        for part, texts in slices(batches):
            found = [scrub(t, KEY) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([len(k) for _, k in found], pa.int64()), pa.array([sorted(set(k)) for _, k in found], pa.list_(pa.string()))],
                ["doc_id", "text", "n_replaced", "kinds"],
            )

    return docs.mapInArrow(run, "doc_id bigint, text string, n_replaced bigint, kinds array<string>")
