"""PII: surrogate generation. Every entity found gets a keyed replacement of its own kind.

A surrogate is the image of the entity under a keyed bijection of the set of all strings of its type and
format: equal entities get equal surrogates in every document and every run with the key (coreference),
different ones get different surrogates (distinctness), and no entity is its own surrogate, all without a
table of entities that grows with the corpus. The bijection numbers the strings of the format and steps
once along a keyed cycle through all numbers (a Feistel network, walked past numbers that the format
doesn't allow, conjugating x + 1). What a format keeps: length, separators, letter case, script, vowels
and consonants in names, the last letter of a given name (by which many languages mark gender), the
check digit of cards and IBANs, the class of an IP address, the top-level domain. Given names of the
fixed lists stay within the list of their gender; titles stay.

Numbers are moved without their separators, which are put back: spellings of one number stay one.
Distinctness needs a check only against what a bijection can't see, names of the lists: a made-up
name that falls into a list walks on. ``collisions`` counts what remains over a corpus; ``distinct_key`` tries
derived keys until it is empty.

Found are e-mail addresses, IPv4 and IPv6 addresses, phone numbers (international, with a leading 0, or of the
North American form), cards, social security numbers, IBANs, keys and long hashes, and names after a title or a
listed given name, with their later mentions. Not found are names without either, postal addresses, dates of
birth, and numbers of other kinds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import lean_batches
from critiq.llm.memory import released

# Given names by gender, titles by gender.
FEMALE = "Alice Amelia Anna Barbara Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Eva Hannah Helen Ingrid Isabella Jane Jennifer Jessica Julia Karen Laura Linda Lisa Lucia Maria Marie Mary Michelle Nancy Olivia Patricia Paula Rachel Rosa Sandra Sarah Sofia Sophie Susan Teresa".split()
MALE = "Adam Albert Andrew Anthony Carlos Charles Daniel David Edward Eric Frank George Hans Henry Hugo Jack James John Jorge Jose Juan Karl Kevin Louis Luis Mark Martin Matthew Michael Miguel Oliver Otto Patrick Paul Pedro Peter Philip Pierre Richard Robert Stefan Steven Thomas William".split()
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "", "Professor": ""}

VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
# Alphabets in which a letter stays, by script and kind; other letters stay in place.
ALPHABETS = ["0123456789", VOWELS, CONSONANTS, "áéíóú", "àèìòù", "äöü", "âêîôû", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
ALPHABET_OF = {c: a for a in [*ALPHABETS, *(a.upper() for a in ALPHABETS[1:])] for c in a}

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}(?![\w-])")
NUMBERS = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<phone>(?<!\d)\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,8})){1,6}(?![\d])"  # +44 20 7946 0958
    r"|(?<![\d.,/:-])0\d{1,4}(?:[ -]\d{2,8}){1,5}(?![\d]|[.,:/-]\d)"  # 06 12 34 56 78, 030 12345678
    r"|(?<![\d.])(?:\(\d{2,4}\)[ .-]?|(?!(?:19|20)\d\d )\d{2,4}[ .-])\d{3}[ .-]?\d{3,4}(?!\d))"
)
PHONE_DIGITS = range(8, 16)
DATE = re.compile(r"\d{1,2}[ -]\d{1,2}[ -](?:19|20)\d\d|0?\d[ -]\d{1,2}[ -]\d{2}")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SECRET = re.compile(r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})(?![0-9A-Za-z])")
# a capital letter and what follows it; an apostrophe is part of it unless it makes a possessive
TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
WORD = rf"(?!(?:{TITLE})\b)[A-ZÀ-ÞА-ЯΑ-Ω]\w*(?:['’](?!s\b)\w+)*"
NAME = re.compile(rf"\b({TITLE})(\.?[ \t]+)({WORD}(?:[ -]{WORD}){{0,2}})")
LISTED = {*FEMALE, *MALE}
GIVEN = "|".join(sorted(LISTED))
PERSON = re.compile(rf"\b((?:{GIVEN})(?:-(?:{GIVEN}))?)([ \t])({WORD}(?:-{WORD})?)")
IBAN_LENGTHS = range(15, 35)


class Cycle:
    """x -> the next number of a keyed cycle through 0..n-1; a bijection without a fixed point for n > 1."""

    def __init__(self, key: bytes, label: str, n: int):
        self.key, self.label, self.n = key, label.encode("utf-8", "surrogatepass"), n
        self.a = isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)

    def _round(self, k: int, value: int, n: int) -> int:
        width = (n.bit_length() + 7) // 8 + 8
        out, block = b"", 0
        while len(out) < width:
            seed = hashlib.blake2b(b"%d|%d|%d|%d|" % (k, block, self.n, value) + self.label, key=self.key).digest()
            out, block = out + seed, block + 1
        return int.from_bytes(out[:width], "big") % n

    def _walk(self, x: int, forward: bool) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in range(4) if forward else range(3, -1, -1):
                sign = 1 if forward else -1
                if forward:
                    left = (left + self._round(2 * k, right, self.a)) % self.a
                    right = (right + self._round(2 * k + 1, left, self.b)) % self.b
                else:
                    right = (right + sign * self._round(2 * k + 1, left, self.b)) % self.b
                    left = (left + sign * self._round(2 * k, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        return self._walk((self._walk(x, False) + 1) % self.n, True) if self.n > 1 else x


def move(text: str, key: bytes, label: str, keep: Callable[[int], bool] = lambda i: False, allowed: Callable[[str], bool] = lambda s: True) -> str:
    """The surrogate of text among the strings that have a letter of the same alphabet in each place.

    keep(i): the i-th character stays. allowed: further strings of the format only, text among them.
    """
    places = [(i, ALPHABET_OF[c]) for i, c in enumerate(text) if c in ALPHABET_OF and not keep(i)]
    n, x = 1, 0
    for i, alphabet in places:
        x, n = x * len(alphabet) + alphabet.index(text[i]), n * len(alphabet)
    moved = {i for i, _ in places}
    shape = "".join(ALPHABET_OF[c][0] if i in moved else c for i, c in enumerate(text))
    cycle = Cycle(key, f"{label}|{shape}", n)
    while n > 1:
        x = cycle.next(x)
        out, rest = list(text), x
        for i, alphabet in reversed(places):
            rest, digit = divmod(rest, len(alphabet))
            out[i] = alphabet[digit]
        if allowed(got := "".join(out)):
            return got
    return text if places or not text else _other(text, key, label)


@lru_cache(maxsize=4096)
def _neighbours(c: str) -> str:
    """The letters of one case among the 64 code points around a letter."""
    first = ord(c) // 64 * 64
    return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower())


def _other(text: str, key: bytes, label: str) -> str:
    """The surrogate of a text without a letter of ALPHABETS: letters move among their neighbours; without any
    letter, hexadecimal digits of a keyed hash."""
    alphabets = [(i, a) for i, c in enumerate(text) if c.isalpha() and len(a := _neighbours(c)) > 1]
    if not alphabets:
        return "x" + hashlib.blake2b(f"{label}|{text}".encode("utf-8", "surrogatepass"), key=key, digest_size=8).hexdigest()
    n, x = 1, 0
    for i, a in alphabets:
        x, n = x * len(a) + a.index(text[i]), n * len(a)
    out = list(text)
    shape = "".join(a[0] for _, a in alphabets) + "".join(c for c in text if not c.isalpha())
    x = Cycle(key, f"{label}|other|{shape}", n).next(x)
    for i, a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out[i] = a[k]
    return "".join(out)


def _apart(text: str, image: Callable[[str], str], kept: Callable[[str], bool]) -> str:
    """The image of the kept characters alone, with the others put back in their places."""
    new = iter(image("".join(filter(kept, text))))
    return "".join(next(new) if kept(c) else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) in IBAN_LENGTHS and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def _network_bits(x: int) -> int:
    """Leading bits of an address that stay: those of its private or special network; none of a public one."""
    for network, bits in ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0xA9FE0000, 16), (0x00000000, 8), (0x7F000000, 8), (0xE0000000, 4), (0xF0000000, 4)):
        if x >> (32 - bits) == network >> (32 - bits):
            return bits
    return 0


def _ip(text: str, key: bytes) -> str:
    x = int.from_bytes(bytes(map(int, text.split("."))), "big")
    bits = _network_bits(x)
    network, host = x >> (32 - bits) << (32 - bits), x & ((1 << (32 - bits)) - 1)
    cycle = Cycle(key, f"ip{network}", 1 << (32 - bits))
    while True:
        host = cycle.next(host)
        if _network_bits(network | host) == bits:
            return ".".join(map(str, (network | host).to_bytes(4, "big")))


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.lower().rpartition("@")
    labels = domain.split(".")
    # local part and domain apart: addresses of one domain stay together
    return move(local, key, "local") + "@" + ".".join([*(move(v, key, "domain") for v in labels[:-1]), labels[-1]])


def _given(name: str, gender: str, key: bytes) -> str:
    for mark, names in (("f", FEMALE), ("m", MALE)):
        if name in names:
            return names[Cycle(key, f"given-{mark}", len(names)).next(names.index(name))]
    return move(name, key, f"given-{gender}", keep=lambda i: i == len(name) - 1, allowed=lambda s: s not in FEMALE and s not in MALE)


def _name(words: str, gender: str, key: bytes) -> str:
    """The last word is the family name; words before it are given names, of the title's gender."""
    parts = re.split(r"([ -])", words)
    last = len(parts) - 1
    return "".join(p if k % 2 else move(p, key, "family") if k == last else _given(p, gender, key) for k, p in enumerate(parts))


def _iban(text: str, key: bytes) -> str:
    return _apart(text, lambda s: move(s, key, "iban", keep=lambda i: i < 2, allowed=iban_ok), str.isalnum)


def _card(text: str, key: bytes) -> str:
    valid = luhn(_digits(text))
    return _apart(text, lambda s: move(s, key, "card", keep=lambda i: i == 0, allowed=lambda d: luhn(d) == valid), str.isdigit)


def _phone(text: str, key: bytes) -> str:
    """Of a number with +, the country stays: 1 and 7 have one digit, others are taken to have two."""
    kept = 0 if text[0] != "+" else 1 if text[1] in "17" else 2
    return _apart(text, lambda s: move(s, key, f"phone{kept}", keep=lambda i: i < kept), str.isdigit)


def _ipv6(text: str, key: bytes) -> str:
    """The first 16 bits of a private, local or special address stay."""
    address = IPv6Address(text)
    bits = 128 if address.is_global else 112
    network, host = int(address) >> bits << bits, int(address) & ((1 << bits) - 1)
    cycle = Cycle(key, f"ipv6-{network}", 1 << bits)
    while True:
        host = cycle.next(host)
        new = IPv6Address(network | host)
        if new.is_global == address.is_global:
            return str(new).upper() if text != text.lower() else str(new)


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The keyed surrogate of an entity (for names: title, space and words)."""
    if kind == "name":
        if titled := NAME.fullmatch(text):
            title, gap, words = titled.groups()
            return title + gap + _name(words, TITLES[title], key)
        if person := PERSON.fullmatch(text):
            first, gap, family = person.groups()
            return "-".join(_given(n, "", key) for n in first.split("-")) + gap + _name(family, "", key)
        return _given(text, "", key) if text in FEMALE or text in MALE else move(text, key, "family")
    if kind == "secret":
        prefix = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-", text)
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            cycle = Cycle(key, f"hex{len(text)}", 16 ** len(text))
            out = f"{cycle.next(int(text, 16)):0{len(text)}x}"
            return out.upper() if text != text.lower() else out
        return move(text, key, "secret", keep=lambda i: bool(prefix) and i < prefix.end())
    return {"email": _email, "ip": lambda t, k: _ipv6(t, k) if ":" in t else _ip(t, k), "ssn": lambda t, k: _apart(t, lambda s: move(s, k, "ssn"), str.isdigit), "card": _card, "phone": _phone, "iban": _iban}[kind](text, key)


# What a text must have at least to hold a number, an IBAN, a key or a name: quick looks, as most texts hold none.
SEVEN = re.compile(r"\d[\d ().+/-]{5}|\d\.\d{1,3}\.")
COUNTRY = re.compile(r"[A-Z][A-Z]\d\d")
LONG = re.compile(r"[0-9A-Za-z_-]{15}")
CAPITALS = re.compile(r"([A-ZÀ-ÞА-ЯΑ-Ω]\w*)(?:-[A-Z]\w*)?\.?[ \t]+(?=[A-ZÀ-ÞА-ЯΑ-Ω])")


def _is_phone(text: str) -> bool:
    """Seven digits or more as before; those with + or a leading 0 need PHONE_DIGITS, and aren't dates."""
    if text[0] not in "+0":
        return True
    return len(_digits(text)) in PHONE_DIGITS and not DATE.fullmatch(text)


def _is_ipv6(text: str) -> bool:
    """Three groups at least, so that ``a::b`` of a program is none."""
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return sum(1 for g in text.split(":") if g) >= 3


def _people(text: str) -> list[tuple[int, int, str]]:
    """Names after a title or made of a listed given name and a family name, and wherever they stand alone again
    in the same text: family names of three letters or more, and listed given names."""
    full, again = [], set()
    for first in CAPITALS.finditer(text):
        if first[1] in TITLES and (m := NAME.match(text, first.start())):
            full.append((*m.span(), m[3]))
        elif first[1] in LISTED and (m := PERSON.match(text, first.start())):
            full.append((*m.span(), m[0]))
    for _, _, words in full:
        *given, family = re.split(r"[ \t-]", words)
        again |= {family} if len(family) > 2 else set()
        again |= {g for g in given if g in FEMALE or g in MALE}
    found = [(s, e, "name") for s, e, _ in full]
    if again:
        alone = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(again, key=len, reverse=True))) + r")\b")
        found += [(*m.span(), "name") for m in alone.finditer(text)]
    return found


def canonical(kind: str, text: str) -> str:
    """One spelling for an entity: what its surrogate is made of."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn", "iban", "phone"):
        return "".join(c for c in text if c.isalnum() or c == "+")
    return str(IPv6Address(text)) if kind == "ip" and ":" in text else text


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a whole text, apart from each other and in order."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        begin = max(0, at - 65)
        m = next((m for m in EMAIL.finditer(text, begin, min(len(text), at + 320)) if m.start() < at < m.end()), None)
        if m:
            found.append((*m.span(), "email"))
        at = text.find("@", m.end() if m else at + 1)
    if SEVEN.search(text):
        found += [(*m.span(), m.lastgroup) for m in NUMBERS.finditer(text) if m.lastgroup != "phone" or _is_phone(m[0])]
    if COUNTRY.search(text):
        found += [(*m.span(), "iban") for m in IBAN.finditer(text) if iban_ok(m[0])]
    if LONG.search(text):
        found += [(*m.span(), "secret") for m in SECRET.finditer(text)]
    if "::" in text or text.count(":") > 6:
        found += [(*m.span(), "ip") for m in IPV6.finditer(text) if _is_ipv6(m[0])]
    found += _people(text)
    order = {"secret": 0, "email": 1, "iban": 2, "card": 3, "ssn": 4, "ip": 5, "phone": 6, "name": 7}
    kept: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(found, key=lambda f: (f[0], order[f[2]], -f[1])):
        if kept and s < kept[-1][1]:
            if order[kind] < order[kept[-1][2]]:
                kept[-1] = (s, e, kind)
            continue
        kept.append((s, e, kind))
    return [f for k, f in enumerate(kept) if not k or f[0] >= kept[k - 1][1]]


def replace(text: str | None, key: bytes, known: dict[tuple[str, str], str] | None = None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) of each entity in the original."""
    if not text:
        return text, []
    out, spans, at = [], [], 0
    known = {} if known is None else known
    for s, e, kind in entities(text):
        entity = (kind, text[s:e])
        if entity not in known:
            known[entity] = surrogate(*entity, key)
        out += [text[at:s], known[entity]]
        spans.append((s, e, kind, known[entity]))
        at = e
    return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in its text column, and ``pii``: array of (start, end, kind, surrogate).

    start and end count characters of the original text. All columns and rows are kept, repeated and
    null ids included; only a column named ``pii`` is replaced. Null texts stay null, empty ones empty, both
    without entities. Whole texts are read. An empty table gives an empty result.
    """
    secret = hashlib.sha256(key.encode()).digest()
    names = [c for c in docs.columns if c != "pii"]
    place = names.index(text_col)

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, spans = [], []
            known: dict[tuple[str, str], str] = {}
            for t in batch.column(place):
                new, found = replace(t.as_py(), secret, known)
                texts.append(new)
                spans.append([dict(zip(("start", "end", "kind", "surrogate"), f)) for f in found])
                if len(known) > 50_000:
                    known.clear()
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*names, "pii"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString() if c != text_col else 'string'}" for c in names)
    texts = lean_batches(docs).select(*(F.col(f"`{c}`") if c != text_col else F.col(f"`{c}`").cast("string").alias(c) for c in names))
    return texts.mapInArrow(rows, f"{schema}, pii array<struct<start: bigint, end: bigint, kind: string, surrogate: string>>")


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, entities): surrogates that stand for more than one entity of docs; must be empty.

    Spellings of one entity (``canonical``) count as one. Entities are told apart by hashes of 128 bits.
    """
    secret = hashlib.sha256(key.encode()).digest()

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            known: dict[tuple[str, str], str] = {}
            for text in batch.column(0):
                text = text.as_py()
                for s, e, kind, new in replace(text, secret, known)[1]:
                    old = canonical(kind, text[s:e])
                    found.add((kind, canonical(kind, new), hashlib.blake2b(old.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()))
                if len(known) > 50_000:
                    known.clear()
            yield pa.RecordBatch.from_pydict({k: pa.array([f[j] for f in found], pa.string()) for j, k in enumerate(("kind", "surrogate", "entity"))})

    pairs = lean_batches(docs).select(F.col(text_col).cast("string").alias("t")).mapInArrow(rows, "kind string, surrogate string, entity string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def distinct_key(docs: DataFrame, key: str, text_col: str = "text", tries: int = 8) -> str:
    """key, or the first key derived from it under which no two entities of docs share a surrogate.

    Reads the texts once for each key tried; as surrogates are images of bijections, that is nearly always once.
    """
    for k in range(tries):
        now = f"{key}|{k}" if k else key
        if collisions(docs, now, text_col).isEmpty():
            return now
    raise ValueError("every key tried gives two entities one surrogate")
