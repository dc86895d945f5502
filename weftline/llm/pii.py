"""Replace personal data and secrets by keyed surrogates of the same type.

Detected: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, card numbers, social
security numbers, IBANs, access keys, passwords and tokens in assignments, and
personal names (a gazetteer's first name followed by a capitalised word, or a title
and a name).  A surrogate is the image of the entity under a keyed permutation of all
strings of its type and format: digits stay digits, letters keep case and script,
hexadecimal stays hexadecimal, an octet stays an octet, a card keeps its issuer digit
and the validity of its check digit, an IBAN its country and the validity of its check
digits, and a name becomes a name of the same gender and script.

``permute`` is P(P'(x) + s), with P a Feistel network with cycle walking over the
mixed-radix number that the string spells, P' its inverse, and s a keyed step without a
common divisor with the number of strings: one cycle through all of them, so no string
is its own image.  Where only some strings of a format are of the entity's kind (valid
cards, names that aren't in the gazetteer), the cycle is walked on to the next of that
kind.  So a surrogate depends on key, type and entity alone: the same entity has the
same surrogate in every document and task (coreference), and different entities never
share one (distinctness), with no table of entities to gather, join or check.  A
surrogate may happen to be another entity of the corpus; that one has its own surrogate.

There is no default key.  ``session_key`` reads ``spark.weftline.pii.key``, and where
none is set makes a random one for the session, which nobody else can invert.

Only rows with a digit, ``@``, ``=``, ``:``, the start of an access key, a word of the
gazetteer or a rare symbol are decoded; the rest pass through as Arrow buffers.  No shuffle, one scan.

Defined results: null text stays null, empty text empty; very long texts are searched
whole; repeated rows get the same text; other columns pass through, whatever their
names; an empty table gives an empty table; of overlapping entities the first in the
order of ``PATTERNS`` is replaced.  ``n_chars`` is set anew where the text changed.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import picked

KEY_SETTING = "spark.weftline.pii.key"

_F = """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Margaret Sarah Nancy Katherine Dorothy Emily
Charlotte Camille Juliette Ingrid Gisela Brigitte Carmen Dolores Pilar Francisca Anna Maria Karen Lisa Betty Sandra Ashley
Kimberly Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy Angela Shirley
Brenda Pamela Emma Nicole Helen Samantha Christine Debra Rachel Carolyn Janet Catherine Diane Olivia Julie Joyce
Kelly Lauren Christina Joan Evelyn Judith Andrea Hannah Megan Cheryl Jacqueline Martha Teresa Gloria Sara Janice
Ann Kathryn Abigail Sophia Frances Jean Alice Judy Isabella Julia Denise Danielle Marilyn Beverly Diana Theresa
Natalie Brittany Doris Kayla Alexis Lori Marie Eva Ruth Claire Sophie Isabelle Nathalie Valérie Sylvie Élodie Chloé Hélène
Ursula Monika Sabine Petra Heike Renate Helga Birgit Katrin Anke Greta Lena Lucía Isabel Elena Cristina Marta Beatriz
Rocío Inés Silvia Raquel Giulia Chiara Francesca Paola Sofia Agnieszka Katarzyna Fatima Aisha Priya Ananya Mei Yuki""".split()
_M = """James Robert Michael William David Richard Joseph Thomas Christopher Daniel Matthew Anthony Kenneth Gregory
Laurent Philippe Thierry Wolfgang Heinrich Dietmar Javier Alejandro Francisco Santiago John Charles Steven Paul Andrew
Joshua Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin
Brandon Benjamin Samuel Raymond Patrick Alexander Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Henry Douglas
Zachary Peter Kyle Ethan Walter Noah Jeremy Keith Roger Terry Sean Gerald Carl Harold Dylan Arthur
Jesse Bryan Billy Bruce Gabriel Joe Albert Willie Alan Eugene Russell Vincent Philip Bobby Johnny
Bradley Frank Jean-Pierre Pierre Jacques François Guillaume Nicolas Julien Antoine Étienne Stéphane Hans Klaus Jürgen
Stefan Andreas Matthias Sebastian Florian Tobias Günter Helmut Dieter Uwe Carlos Manuel Antonio Miguel Pedro Luis José
Jorge Fernando Pablo Sergio Diego Rafael Giovanni Marco Luca Alessandro Matteo Piotr Krzysztof Mohammed Ahmed Rajesh Arjun
Hiroshi Kenji""".split()
NAMES = {
    ("f", "latin"): _F,
    ("m", "latin"): _M,
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Юлия".split(),
    ("m", "cyrillic"): "Александр Дмитрий Сергей Андрей Алексей Максим Владимир Николай Михаил Павел Юрий Виктор".split(),
    ("f", "greek"): "Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης".split(),
}
_GENDER = {n: group for group, names in NAMES.items() for n in names}
_FIRST = "|".join(sorted(_GENDER, key=len, reverse=True))
_UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
_LOWER = "a-zß-öø-ÿά-ώа-я"
_CAP = rf"[{_UPPER}](?:'[{_UPPER}])?[{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_QUAD = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.[0-9])"
_CARD = r"[0-9](?:[0-9]{12,18}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![\w-])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
#: (type, pattern, the group that is replaced); a phone number doesn't run on into an address, card or social security number after it
PATTERNS = (
    ("email", re.compile(r"[\w.%+-]*[\w%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0),
    ("secret", re.compile(r"""(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*["']?((?=[+/_.~-]*[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,})"""), 1),
    ("access_key", re.compile(r"\b(?:AKIA|ASIA)([0-9A-Z]{16})\b"), 1),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), 0),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.[0-9])"), 0),
    ("phone", re.compile(rf"(?<![\w+])\+[0-9]{{1,3}}[ .-]?(\(?[0-9]{{2,4}}\)?(?:(?: (?!{_QUAD})|[.-]?)[0-9]{{2,4}}){{2}}(?:(?: (?!{_QUAD}|{_CARD}|{_SSN})|[.-]?)[0-9]{{2,4}}){{0,2}})(?!\w)"), 1),
    ("phone", re.compile(r"(?<![\w(])(\([0-9]{3}\) ?[0-9]{3}-[0-9]{4})(?!\w)"), 1),
    ("phone", re.compile(r"(?<![\w.+-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![\w-]|\.[0-9])"), 0),
    ("card", re.compile(rf"(?<![\w.-]){_CARD}"), 0),
    ("ssn", re.compile(rf"(?<![\w-]){_SSN}"), 0),
    ("ipv4", re.compile(rf"(?<![\w.]){_QUAD}"), 0),
    ("name", re.compile(rf"\b(?:{_FIRST})(?: {_CAP})+"), 0),
    ("name", re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? ({_CAP}(?: {_CAP})*)"), 1),
)
TYPES = tuple(dict.fromkeys(t for t, _, _ in PATTERNS))

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_HEX_CLASSES = ("0123456789", "abcdef", "ABCDEF")
_HEX, _ALNUM = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For surnames vowels stay vowels.
_SOUNDS = tuple(x for c in _CLASSES[1:] for v in ("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿаеиоуыэюяαεηιουω",) for x in ("".join(k for k in c if k.lower() in v), "".join(k for k in c if k.lower() not in v)) if x)


@lru_cache(maxsize=4096)
def _feistel(size: int, key: bytes, tweak: str) -> tuple[int, int, bytes]:
    """Half the bits, the step, and the key of the rounds."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    inner = hashlib.blake2b(f"{tweak}|{size}".encode(), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=32).digest()
    step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=inner, digest_size=64).digest(), "big") % (size - 1)
    while math.gcd(step, size) > 1:
        step = step % (size - 1) + 1
    return half, step, inner


def _round(r: int, b: int, half: int, inner: bytes) -> int:
    width = (half + 7) // 8
    head, out, n = r.to_bytes(1, "big") + b.to_bytes(width, "big"), b"", 0
    while len(out) < width:
        out += hashlib.blake2b(head + n.to_bytes(4, "big"), key=inner, digest_size=min(64, max(8, width))).digest()
        n += 1
    return int.from_bytes(out[:width], "big") & ((1 << half) - 1)


def _network(x: int, size: int, half: int, inner: bytes, back: bool) -> int:
    """Eight rounds on the least even number of bits, walking until inside range(size)."""
    while True:
        a, b = x >> half, x & ((1 << half) - 1)
        for r in range(8):
            if back:
                a, b = b ^ _round(7 - r, a, half, inner), a
            else:
                a, b = b, a ^ _round(r, b, half, inner)
        x = a << half | b
        if x < size:
            return x


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) that is one cycle, so that nothing of two or more stays in its place."""
    if size < 2:
        return x
    half, step, inner = _feistel(size, key, tweak)
    return _network((_network(x, size, half, inner, True) + step) % size, size, half, inner, False)


def respell(s: str, alphabets: list[str | None], key: bytes, tweak: str) -> str:
    """The string's image among all strings with the same alphabets at each place (None: the place is kept)."""
    x, size = 0, 1
    for c, a in zip(s, alphabets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join("-" if a is None else chr(65 + len(a) % 58) for a in alphabets)
    fixed = "".join(c for c, a in zip(s, alphabets, strict=True) if not a)
    x = permute(x, size, key, f"{tweak}|{shape}|{fixed}")
    out = []
    for c, a in zip(reversed(s), reversed(alphabets), strict=True):
        if a:
            x, d = divmod(x, len(a))
            out.append(a[d])
        else:
            out.append(c)
    return "".join(reversed(out))


def by_class(s: str, classes: tuple[str, ...] = _CLASSES) -> list[str | None]:
    return [next((a for a in classes if c in a), None) for c in s]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    """The check digits are those that the account gives, 02 to 98."""
    s = s.replace(" ", "")
    return 2 <= int(s[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _spelling(secret: str) -> int:
    """0 of digits alone, 1 of hexadecimal digits, 2 any other."""
    return 0 if secret.isdigit() else 1 if not set(secret) - set(_HEX) else 2


def _walked(s: str, step: Callable[[str], str], kind: Callable[[str], object]) -> str:
    """The next string of the cycle that is of the same kind."""
    same, s = kind(s), step(s)
    while kind(s) != same:
        s = step(s)
    return s


class Surrogates:
    """Entity to surrogate under one key: a function of key, type and entity, whatever else was seen."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key
        self.of = lru_cache(maxsize=200_000)(self._of)

    def _of(self, kind: str, s: str) -> str:
        if kind == "email":
            local, _, domain = s.partition("@")
            name, _, top = domain.rpartition(".")
            return f"{respell(local, by_class(local), self.key, 'local')}@{respell(name, by_class(name), self.key, 'domain')}.{top}"
        if kind == "ipv4":
            octets = [int(x) for x in s.split(".")]
            x = permute(sum(o << 8 * (3 - k) for k, o in enumerate(octets)), 1 << 32, self.key, "ipv4")
            return ".".join(str(x >> 8 * (3 - k) & 255) for k in range(4))
        if kind == "card":
            issuer = next(k for k, c in enumerate(s) if c.isdigit())
            alphabets = [_CLASSES[0] if c.isdigit() and k > issuer else None for k, c in enumerate(s)]
            return _walked(s, lambda x: respell(x, alphabets, self.key, "card"), lambda x: luhn(re.sub(r"\D", "", x)))
        if kind == "iban":
            return self._iban(s)
        if kind == "ipv6":
            return respell(s, by_class(s, _HEX_CLASSES), self.key, kind)
        if kind == "access_key":
            return respell(s, [_ALNUM if c in _ALNUM else None for c in s], self.key, kind)
        if kind == "secret":
            alphabets = [_HEX] * len(s) if _spelling(s) == 1 else by_class(s)
            return _walked(s, lambda x: respell(x, alphabets, self.key, kind), _spelling)
        if kind == "name":
            return " ".join(self.name_part(p) for p in s.split(" "))
        return respell(s, by_class(s), self.key, kind)

    def _iban(self, s: str) -> str:
        """The account is respelled and the check digits computed; where they are wrong, both are respelled and stay wrong."""
        free = by_class(s)
        if not iban_valid(s):
            return _walked(s, lambda x: respell(x, [None] * 2 + free[2:], self.key, "iban"), iban_valid)
        bare = s[:2] + "00" + s[4:]
        out = respell(bare, [None] * 4 + free[4:], self.key, "iban account")
        rest = int("".join(str(int(c, 36)) for c in out.replace(" ", "")[4:] + out[:4])) % 97
        return out[:2] + f"{98 - rest:02d}" + out[4:]

    def name_part(self, part: str) -> str:
        """A first name of the gazetteer becomes one of its group, in any place; another name one that isn't in the gazetteer."""
        if part in _GENDER:
            names = NAMES[_GENDER[part]]
            return names[permute(names.index(part), len(names), self.key, "first" + "".join(_GENDER[part]))]
        alphabets = by_class(part, _SOUNDS)
        return _walked(part, lambda x: respell(x, alphabets, self.key, "surname"), lambda x: x in _GENDER)


@lru_cache(maxsize=1)
def _random_key() -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else a random one for the life of the driver."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _random_key()


def _is_ipv6(s: str) -> bool:
    if sum(bool(g) for g in s.split(":")) < 3:
        return False
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the entities of a text; of overlapping ones the first in the order of PATTERNS."""
    at, eq, digit = "@" in text, "=" in text or ":" in text, any(c in text for c in "0123456789")
    spans: list[tuple[int, int, str]] = []
    for kind, pattern, group in PATTERNS:
        if (kind == "email" and not at) or (kind == "secret" and not eq) or (kind in ("iban", "phone", "card", "ssn", "ipv4", "ipv6") and not digit):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "ipv6" and not _is_ipv6(text[a:b]):
                continue
            if all(b <= x or a >= y for x, y, _ in spans):
                spans.append((a, b, kind))
    return sorted(spans)


def scrub(text: str, surrogates: Surrogates) -> tuple[str, list[str]]:
    """The text with its entities replaced, and their types in order."""
    spans = find(text)
    if not spans:
        return text, []
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], surrogates.of(kind, text[a:b])]
        last = b
    return "".join([*out, text[last:]]), [k for _, _, k in spans]


@lru_cache(maxsize=1)
def _gazetteer() -> K.Lookup:
    words = [*_GENDER, "Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
    return K.Lookup(np.concatenate(K.words_of(words)))


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows of a block hold what some pattern needs: a digit, ``@``, ``=``, ``:``, ``AKIA``, ``ASIA``, a word of the gazetteer, or a symbol that hides where a word begins."""
    mark = np.zeros(256, bool)
    mark[[64, 61, 58, *range(48, 58), *range(0xEA, 256)]] = True
    found = mark[data]
    if len(data) > 3:
        second = data[1:-2]
        found[:-3] |= (data[:-3] == 65) & ((second == 75) | (second == 83)) & (data[2:-1] == 73) & (data[3:] == 65)
        found[:-1] |= (data[:-1] == 0xE2) & (data[1:] != 0x80)
    at = np.flatnonzero(found)
    w = K.Words(data, offs)
    hit, _ = _gazetteer().find(w.hash)
    flag = np.zeros(len(offs) - 1, bool)
    flag[np.searchsorted(offs, at, "right") - 1] = True
    flag[w.doc[hit]] = True
    return flag


def replaced(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None, types: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count`` and ``types`` name columns to add for the number of entities and their types."""
    columns = docs.columns
    at = columns.index(text)
    n_chars = columns.index("n_chars") if "n_chars" in columns and columns.count("n_chars") == 1 else None
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count, T.IntegerType())] if count else []), *([T.StructField(types, T.ArrayType(T.StringType()))] if types else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for b in batches:
            col = b.column(at)
            data, offs = K.utf8(col)
            flag = np.zeros(b.num_rows, bool)
            for i, j in K.blocks(offs):
                flag[i:j] = suspects(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            rows = np.flatnonzero(flag)
            done = [scrub(t, s) if t is not None else (None, []) for t in col.take(pa.array(rows)).to_pylist()]
            changed = [k for k, (_, kinds) in enumerate(done) if kinds]
            mask = np.zeros(b.num_rows, bool)
            mask[rows[changed]] = True
            new = pa.array([done[k][0] for k in changed], col.type)
            out = list(b.columns)
            if len(new):
                out[at] = pc.replace_with_mask(col, pa.array(mask), new)
                if n_chars is not None:
                    out[n_chars] = pc.replace_with_mask(b.column(n_chars), pa.array(mask), pc.utf8_length(new).cast(b.column(n_chars).type))
            n = np.zeros(b.num_rows, np.int32)
            n[rows] = [len(k) for _, k in done]
            if count:
                out.append(pa.array(n))
            if types:
                kinds: list[list[str]] = [[] for _ in range(b.num_rows)]
                for r, (_, k) in zip(rows, done, strict=True):
                    kinds[r] = k
                out.append(pa.array(kinds, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(out, names=[f"c{k}" for k in range(len(out))])

    flat = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])
    return flat.mapInArrow(run, plain).toDF(*schema.names)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the text with surrogates, the number of entities and their types, of every document."""
    return replaced(picked(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text")), key, count="n_entities", types="entity_types")
