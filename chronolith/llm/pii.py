"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

Entities are found by patterns in texts that hold a digit of any script, an at sign, a title or the key word of a
secret: addresses (e-mail, version 4 and 6), cards, accounts, phones with separators or of ten digits, and secrets in quotes
after a key word, or bare ones of letters and digits. A person is found after a title; its full name, first and last word are then replaced without one, too, and
a short form after a title ("Dr Smith") is the person of the text that it fits. An entity's canonical form (digits
of a number, an address in lower case, a name and the gender of its titles) has one surrogate, so that all mentions
of it, in any document and format, get the same one; a mention keeps its own punctuation and case. Checksums stay
valid where they were, private networks stay private, countries stay.

Surrogates are a keyed permutation of all forms of the same type and format (a Feistel network over their numbers, a
shift in the middle, and a walk on to the next form that is valid like the original): two entities never have
the same surrogate and none is its own, however full a format is. :func:`assign` checks that over the whole corpus.
A surrogate may be the real entity of another document, as it must be once all forms of a format occur. Names that only
neutral titles have take the gender that other texts tell; these few are joined to the documents that hold them, all
others need no exchange.

Defined cases: null and empty texts stay; repeated rows are treated alike; a null id is carried through; an
empty table gives an empty result; other columns are passed through (``n_entities`` and ``kinds`` are replaced).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Titles before names, by gender.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Doña"), "n": ("Dr", "Prof")}
_TITLE = "|".join(x for group in TITLES.values() for t in group for x in (t, t.upper()))
_GENDER = {x: g for g, group in TITLES.items() for t in group for x in (t, t.upper())}


def _ranges(*kinds: str) -> str:
    """A pattern class of the letters of some Unicode categories."""
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c)) in kinds]
    runs = [[c, c] for c in codes[:1]]
    for c in codes[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


#: A name begins with a capital, or with a letter of a script without case; it may hold an apostrophe, or be an initial.
_CAPITAL = rf"[{_ranges('Lu', 'Lt', 'Lo')}]"
_NAME = rf"(?:{_CAPITAL}(?:['’]?[^\W\d_])+|{_CAPITAL}\.(?= {_CAPITAL}))"
#: What a secret is given to: the name, a sign, and the secret in quotes, or bare if it is long and of letters and digits.
_GIVEN = r"(?i:token|key|secret|password)(?: = |=|: ?)"
PATTERNS = {
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": rf"{_GIVEN}(?:\"(?P<double>[^\"\s]{{8,}})\"|'(?P<single>[^'\s]{{8,}})'|(?P<naked>(?=[\w+/=.~-]{{0,200}}\d)(?=[\w+/=.~-]{{0,200}}[^\W\d_])[\w+/=~-][\w+/=.~-]{{8,}}[\w+/=~-]))|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{{32,}}\b",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*:)(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]*[0-9A-Fa-f](?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d-])(?:\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|3[47]\d{2}(?P<gap>[ -])\d{6}(?P=gap)\d{5})(?![\d-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{2,4}[.-]\d{3}[.-]\d{4}|(?<=\d[ .-])\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|[2-9]\d{2}[2-9]\d{6}(?![\w.-]*\d))(?!\d)",
    "person": rf"(?:(?<=\s)|(?<=^)|(?<=[(\"']))(?:{_TITLE})\.? {_NAME}(?:[ -]{_NAME}){{0,2}}",
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: The part of an e-mail address after the sign; that before it is found from the sign backwards, in linear time.
HOST = re.compile(r"[^\W_][\w-]*(?:\.[^\W_][\w-]*)*\.[^\W\d_]{2,}")
#: What every pattern needs a part of.
ANCHOR = re.compile(rf"[\d@]|{_GIVEN}[\"']|\b(?:{_TITLE})\b")
DIGITS = re.compile(r"\d")
FOUND = "type string, canonical string"


def _ascii_digits(text: str) -> str:
    """The digits of a text, whatever their script."""
    return "".join(str(unicodedata.decimal(c)) for c in DIGITS.findall(text))


def _address6(text: str) -> str | None:
    """The 32 digits of an address of version 6; None if it is none."""
    try:
        return ipaddress.IPv6Address(text).exploded.replace(":", "")
    except ValueError:
        return None


def canonical(kind: str, text: str) -> str:
    if kind == "ip6":
        return _address6(text)
    if kind == "email":
        return text.lower()
    if kind == "person":
        title, _, name = text.partition(" ")
        return f"{_GENDER[title.rstrip('.')]}|{name.lower()}"
    if kind == "phone":
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        digits = _ascii_digits(text)
        return f"{digits[:len(code[1])]}|{digits[len(code[1]):]}" if code else f"|{digits}"
    if kind in ("card", "ssn"):
        return _ascii_digits(text)
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.replace(" ", "") if kind == "iban" else text


def mentions(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of the entities of a text, left to right, without overlap."""
    if not text or not ANCHOR.search(text):
        return []
    found = _addresses(text)
    if found:
        cuts = [0, *(x for start, end, _ in found for x in (start, end)), len(text)]
        text = "".join(text[a:b] if k % 2 == 0 else chr(1) * (b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    others = []
    for m in FINDER.finditer(text):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m[k] is not None)
        part = next((k for k in ("double", "single", "naked") if m[k] is not None), kind) if kind == "secret" else kind
        if kind != "ip6" or _address6(m[0]):
            others.append((*m.span(part), kind))
    if not found:
        return others
    ends = [x[1] for x in found]
    apart = [x for x in others if (k := bisect.bisect_right(ends, x[0])) == len(ends) or found[k][0] >= x[1]]
    return sorted([*found, *apart])


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """E-mail addresses from left to right; each character is looked at a few times, however long the runs of letters are."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        host = HOST.match(text, at + 1) if start < at and text[at - 1].isalnum() else None
        if host:
            out.append((start, host.end(), "email"))
        last = host.end() if host else at + 1
        at = text.find("@", last)
    return out


@dataclass
class Mention:
    """An entity in a text; of a person ``word`` is the one that stands for it (0 first, -1 last), None the whole name."""

    start: int
    end: int
    kind: str
    known: str
    word: int | None = None
    titled: bool = True


def read(text: str) -> list[Mention]:
    """The mentions of a text in order, persons resolved within the text and with their bare repeats."""
    spans = [Mention(s, e, kind, canonical(kind, text[s:e])) for s, e, kind in mentions(text)]
    persons = [m for m in spans if m.kind == "person"]
    if not persons:
        return spans
    named = [(m, *m.known.split("|", 1)) for m in persons]
    genders: dict[str, str] = {}
    for _, gender, name in named:
        if gender != "n":
            genders.setdefault(name, gender)
    for m, gender, name in named:
        if gender == "n":
            m.known = f"{genders.get(name, 'n')}|{name}"
    whole = [(m.start, m.known, m.known.partition("|")[2].split(" "), text[m.start : m.end].partition(" ")[2].split(" ")) for m in persons]
    full = [w for w in whole if len(w[2]) > 1]
    # A neutral title of a full name is the gender that a short form in the text tells, if one fits.
    told = {}
    for _, known, words, _ in full:
        if known[0] == "n":
            other = {g for _, g, name in named if g != "n" and name == words[-1]}
            if len(other) == 1 and not any(w[1][0] in other and w[2][-1] == words[-1] for w in full):
                told[known] = f"{other.pop()}{known[1:]}"
    for m in persons:
        m.known = told.get(m.known, m.known)
    full = [(at, told.get(known, known), words, own) for at, known, words, own in full]

    def whose(word: str, at: int, gender: str = "n") -> tuple[str, int] | None:
        """The person with such a last or else first word, the latest one before ``at`` or else the first after it."""
        for k in (-1, 0):
            fits = [w for w in full if w[2][k] == word and (gender == "n" or w[1][0] in (gender, "n"))]
            if fits:
                return max((w for w in fits if w[0] <= at), default=fits[0], key=lambda w: w[0])[1], k
        return None

    for m, gender, name in named:
        if " " not in name and (person := whose(name, m.start, gender)):
            m.known, m.word = person
    forms: dict[str, None] = {}
    for *_, own in whole:
        for form in dict.fromkeys([" ".join(own), *(w for w in (own[-1], own[0]) if not w.endswith("."))]):
            for cased in (form, form.upper(), " ".join("-".join(x[:1].upper() + x[1:].lower() for x in w.split("-")) for w in form.split(" "))):
                forms[cased] = None
    bare = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(x) for x in sorted(forms, key=len, reverse=True))})(?!\w)")
    ends, bares = [m.end for m in spans], []
    for found in bare.finditer(text):
        k = bisect.bisect_right(ends, found.start())
        if k < len(ends) and spans[k].start < found.end():
            continue
        name = found[0].lower()
        before = [m for m in persons if m.known.partition("|")[2] == name and m.word is None]
        if before:
            known, word = max((m for m in before if m.start <= found.start()), default=before[0], key=lambda m: m.start).known, None
        elif person := whose(name, found.start()):
            known, word = person
        else:
            continue
        bares.append(Mention(found.start(), found.end(), "person", known, word, False))
    return sorted([*spans, *bares], key=lambda m: m.start)


#: Characters that are permuted together; a longer text is permuted block by block, which keeps forms distinct, too.
BLOCK = 48


@functools.lru_cache(1 << 12)
def _tag(key: bytes, form: str) -> bytes:
    return hashlib.blake2b(len(key).to_bytes(4, "big") + key + form.encode("utf-8", "surrogatepass"), digest_size=32).digest()


def _prf(tag: bytes, turn: int, x: int, bits: int) -> int:
    """A keyed function of up to 512 bits."""
    size = -(-bits // 8)
    seed = turn.to_bytes(1, "big") + x.to_bytes(-(-x.bit_length() // 8), "big")
    return int.from_bytes(hashlib.blake2b(seed, key=tag, digest_size=size).digest(), "big") >> (8 * size - bits)


def _feistel(tag: bytes, n: int, x: int, back: bool) -> int:
    """A keyed permutation of 0..n-1, or its inverse. Values of n or more are walked over."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        low, high = x & mask, x >> half
        for turn in range(7, -1, -1) if back else range(8):
            if back:
                low, high = high, low ^ _prf(tag, turn, high, half)
            else:
                low, high = high ^ _prf(tag, turn, low, half), low
        x = high << half | low
        if x < n:
            return x


def moved(tag: bytes, n: int, x: int) -> int:
    """Another number below ``n`` (if there is one): the permutation, a keyed shift, and the way back, which has no fixed point."""
    if n < 2:
        return x
    shift = 1 + _prf(tag, 255, n, min(512, n.bit_length() + 64)) % (n - 1)
    return _feistel(tag, n, (_feistel(tag, n, x, False) + shift) % n, True)


def permuted(key: bytes, form: str, text: str, choices: list[str], valid=None) -> str:
    """A text of the same length of which each character is one of its ``choices``; ``valid`` texts stay so, others too."""
    if len(text) > BLOCK:
        cuts = range(0, len(text), BLOCK)
        return "".join(permuted(key, f"{form} {at // BLOCK}", text[at : at + BLOCK], choices[at : at + BLOCK], valid) for at in cuts)
    n, x = 1, 0
    for c, some in zip(text, choices):
        x, n = x * len(some) + some.index(c), n * len(some)
    tag = _tag(key, f"{form}|{'|'.join(choices)}")
    while True:
        y, out = (x := moved(tag, n, x)), []
        for some in reversed(choices):
            y, k = divmod(y, len(some))
            out.append(some[k])
        new = "".join(reversed(out))
        if valid is None or valid(new) == valid(text):
            return new


DIGIT, LOWER, UPPER, VOWELS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiou"
CONSONANTS = "".join(c for c in LOWER if c not in VOWELS)


@functools.lru_cache(4096)
def _alike(char: str) -> str:
    """Characters of the same kind in the same stretch of 16 code points, 128 in scripts without case: script and case stay."""
    if char.isascii():
        return next((x for x in (DIGIT, LOWER, UPPER) if char in x), char)
    if not char.isalnum():
        return char
    kind = unicodedata.category(char)
    many = 128 if kind == "Lo" else 16
    start = ord(char) // many * many
    same = "".join(chr(c) for c in range(start, start + many) if unicodedata.category(chr(c)) == kind and chr(c).lower().upper() == chr(c).upper())
    return same if char in same else char


#: Signs that stand for each other in secrets; double quotes stay, as they may end one.
SIGNS, APOSTROPHES = "!#$%&()*+,-./:;<=>?@[\\]^_{|}~", "'`"


@functools.lru_cache(4096)
def _any_sign(char: str) -> str:
    """As :func:`_alike`, and signs by signs: in ASCII by those of a list, elsewhere by those of a category near by."""
    if char.isalnum():
        return _alike(char)
    if char.isascii():
        return next((x for x in (SIGNS, APOSTROPHES) if char in x), char)
    kind, start = unicodedata.category(char), ord(char) // 128 * 128
    return "".join(chr(c) for c in range(start, start + 128) if unicodedata.category(chr(c)) == kind and not chr(c).isalnum())


def scramble(key: bytes, form: str, text: str, valid=None) -> str:
    """Letters by letters of their script and case, digits by digits; everything else stays."""
    return permuted(key, form, text, [_alike(c) for c in text], valid)


def _luhn(digits: str) -> int:
    """What is left by 10 of a number's Luhn sum."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _name(key: bytes, name: str, gender: str) -> str:
    """A name of vowels and consonants as they were, in the script that it has; Latin first names end as their gender's often do."""
    made = permuted(key, "name", name, [VOWELS if c in VOWELS else CONSONANTS if c in CONSONANTS else _alike(c) for c in name])
    if not name[0].isascii() and "LATIN" not in unicodedata.name(name[0], ""):
        return made
    first, gap, rest = made.partition(" ")
    return first + {"f": "a", "m": "n", "n": "e"}[gender] + gap + rest


def _check_digits(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _ip_class(ip: str) -> tuple:
    octets = ip.split(".")
    private = 2 if octets[:2] == ["192", "168"] else 1 if octets[0] in ("10", "127") else 0
    return (*octets[:private], private or 0 < int(octets[0]) < 224)


@functools.lru_cache(1 << 14)
def surrogate(key: bytes, kind: str, known: str) -> str:
    """The canonical form of an entity's replacement: a permutation of the canonical forms of its type and format."""
    if kind == "person":
        gender, _, name = known.partition("|")
        return f"{gender}|{_name(key, name, gender)}"
    if kind == "email":
        local, _, domain = known.rpartition("@")
        *labels, top = domain.split(".")
        return f"{scramble(key, 'local', local)}@{'.'.join([*(scramble(key, 'label', x) for x in labels), top])}"
    if kind == "phone":
        code, _, digits = known.partition("|")
        return f"{code}|{permuted(key, f'phone {code}', digits, [DIGIT] * len(digits))}"
    if kind == "card":
        if _luhn(known):
            return known[0] + permuted(key, f"card {known[0]}", known[1:], [DIGIT] * (len(known) - 1), lambda x: bool(_luhn(known[0] + x)))
        body = known[0] + permuted(key, f"valid card {known[0]}", known[1:-1], [DIGIT] * (len(known) - 2))
        return body + str(-_luhn(body + "0") % 10)
    if kind == "ssn":
        usual = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        return permuted(key, "ssn", known, [DIGIT] * 9, usual)
    if kind == "ip":
        octet, packed = "".join(map(chr, range(256))), "".join(chr(int(x)) for x in known.split("."))
        fixed = len(_ip_class(known)) - 1
        plain = lambda x: ".".join(str(ord(c)) for c in x)
        kept = packed[:fixed]
        return plain(kept + permuted(key, f"ip {fixed} {plain(kept)}", packed[fixed:], [octet] * (4 - fixed), lambda x: _ip_class(plain(kept + x)) == _ip_class(known)))
    if kind == "ip6":
        return known[:4] + permuted(key, f"ip6 {known[:4]}", known[4:], ["0123456789abcdef"] * 28)
    if kind == "iban":
        country, check, bban = known[:2], known[2:4], known[4:]
        if check == _check_digits(country, bban):
            made = scramble(key, f"iban {country}", bban)
            return country + _check_digits(country, made) + made
        return country + scramble(key, f"odd iban {country}", known[2:], lambda x: x[:2] == _check_digits(country, x[2:]))
    if re.fullmatch("[0-9a-f]+", known):
        mixed = lambda x: bool(re.search("[0-9]", x) and re.search("[a-f]", x))
        return permuted(key, "hex", known, ["0123456789abcdef"] * len(known), mixed)
    return permuted(key, "secret", known, [_any_sign(c) for c in known], lambda x: bool(re.fullmatch("[0-9a-f]+", x)))


def render(kind: str, mention: str, new: str, word: int | None = None, titled: bool = True) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new.replace("|", ""))
        return "".join(_in_script(next(chars), c) if c.isalnum() else c for c in mention)
    if kind == "person":
        title, gap, name = mention.partition(" ") if titled else ("", "", mention)
        made = new.partition("|")[2]
        made = made if word is None else made.split(" ")[word]
        return title + gap + (made.upper() if name.isupper() else " ".join("-".join(x[:1].upper() + x[1:] for x in w.split("-")) for w in made.split(" ")))
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind == "ip6":
        made = str(ipaddress.IPv6Address(int(new, 16)))
        return made.upper() if mention.isupper() else made
    return new


def _in_script(digit: str, like: str) -> str:
    """A digit in the script of the one that it replaces."""
    return chr(ord(like) - unicodedata.decimal(like) + int(digit)) if not like.isascii() and like.isdecimal() and digit.isdecimal() else digit


def replace(text: str, key: bytes, others: dict[tuple[str, str], str] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the types of the mentions replaced; ``others`` has entities known by another form."""
    out, at, kinds = [], 0, []
    for m in read(text):
        new = surrogate(key, m.kind, (others or {}).get((m.kind, m.known), m.known))
        out += [text[at : m.start], render(m.kind, text[m.start : m.end], new, m.word, m.titled)]
        at = m.end
        kinds.append(m.kind)
    return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``print, type, canonical`` of the entities of each text; ``print`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mark, text in zip(batch.column("print").to_pylist(), batch.column("text").to_pylist()):
                rows += sorted({(mark, m.kind, m.known) for m in read(text)})
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["print", "type", "canonical"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"print long, {FOUND}")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """``type, canonical, surrogate`` of every entity; raises an error if two of a type have the same or one has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *row) for row in zip(*(batch.column(c).to_pylist() for c in ("type", "canonical")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("type", "canonical")), pa.array(made, pa.string())], names=["type", "canonical", "surrogate"])

    made = stage(found.select("type", "canonical").distinct().mapInArrow(run, f"{FOUND}, surrogate string"), "surrogates")
    shared = made.groupBy("type", "surrogate").agg(F.count("canonical").alias("n")).where("n > 1").select("type", "surrogate")
    if bad := shared.first():
        raise ValueError(f"two entities have the same surrogate of type {bad['type']}")
    if own := made.where("canonical = surrogate").select("type").first():
        raise ValueError(f"an entity of type {own['type']} has no other form than its own")
    return made


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, ``n_entities`` (mentions) and ``kinds`` (their sorted types)."""
    docs = docs.drop("n_entities", "kinds")
    found = stage(entities(docs, text_col), "mentions")
    # A name under neutral titles only is, if other texts tell its gender, the entity of that gender.
    person = found.where("type = 'person'").select("canonical").distinct()
    gendered = person.where("canonical not like 'n|%'").groupBy(F.expr("substr(canonical, 3)").alias("name")).agg(F.min("canonical").alias("becomes"))
    neutral = person.where("canonical like 'n|%'").withColumn("name", F.expr("substr(canonical, 3)"))
    told = stage(neutral.join(gendered, "name").select(F.lit("person").alias("type"), "canonical", "becomes"), "told")
    entity = found.select("type", "canonical").distinct().join(told, ["type", "canonical"], "left").select("type", F.coalesce("becomes", "canonical").alias("canonical"))
    drop_stage(assign(entity, key))
    kind = "array<struct<type:string,canonical:string,becomes:string>>"
    whole, at, columns = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col), len(docs.columns)
    if told.isEmpty():
        whole = whole.withColumn("others", F.lit(None).cast(kind))
    else:
        own = found.join(told, ["type", "canonical"]).groupBy("print").agg(F.collect_set(F.struct("type", "canonical", "becomes")).alias("others"))
        whole = whole.withColumn("print", F.xxhash64(F.col("row").getField(text_col))).join(stage(own, "told-by-text"), "print", "left").drop("print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            row = batch.column("row")
            for text, others in zip(row.field(at).to_pylist(), batch.column("others").to_pylist()):
                new, seen = (text, []) if text is None else replace(text, key, {(a["type"], a["canonical"]): a["becomes"] for a in others or ()})
                texts.append(new)
                counts.append(len(seen))
                kinds.append(sorted(set(seen)))
            parts = [pa.array(texts, pa.string()) if k == at else row.field(k) for k in range(columns)]
            changed = pa.StructArray.from_arrays(parts, fields=list(row.type))
            yield pa.RecordBatch.from_arrays([changed, pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["row", "n_entities", "kinds"])

    out = whole.select("row", "others").mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, n_entities long, kinds array<string>")
    return out.select("row.*", "n_entities", "kinds")
