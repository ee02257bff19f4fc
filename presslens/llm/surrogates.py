"""Personal data replaced by keyed surrogates.

Detected entities (e-mail, IPv4 and IPv6 addresses, telephone numbers, payment cards, bank accounts, social
security numbers, secret tokens and keys, persons after a form of address and their names elsewhere in the same
text) receive replacements of their own kind: letters for letters, digits for digits, separators, case, script
and check digits kept, first names of the same gender and script, one last name for all who share it.  A replacement is a keyed hash of the entity in canonical form, so that the same entity has the same
replacement everywhere in the corpus, however it is written, and nothing can be reversed without the key.

Replacements of different entities could meet, or hit an entity that really occurs.  The distinct entities
of the whole corpus are therefore checked with two joins; whoever loses a collision draws again (``attempt``)
until no collision is left.  Only entities that had to draw again travel to the texts: by value while they are
fewer than ``MOST_SHIPPED``, by a join on the document otherwise.

Defined results: a null text stays null and an empty one empty; texts without an entity come back unchanged;
repeated rows are treated alike; an empty table gives an empty table; other columns are untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import small_batches, staged, unused

#: Overruled entities that are sent along with the code (each below 200 bytes); more are joined by document.
MOST_SHIPPED = 20_000
#: Key of the replacements; a caller with real data passes one of its own.
KEY = b"presslens"

# --- fixed values: forms of address and name parts ------------------------------------------------------
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Señor", "Monsieur", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа"],
    "n": ["Dr", "Prof", "Doctor", "Professor"],
}
FIRST = {
    ("latin", "m"): ["Adam", "Bruno", "Carlo", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Oscar", "Paul", "Simon", "Victor"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nora", "Sofia", "Vera"],
    ("latin", "n"): ["Alex", "Charlie", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sascha"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев", "Павел", "Роман"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя"],
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "du", "fa", "fi", "ga", "go", "ha", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "ti", "to", "va", "vi"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "ка", "ко", "ла", "ле", "ли", "ма", "ми", "мо", "на", "не", "но", "па", "по", "ра", "ре", "ро", "са", "се", "та", "те", "то"],
}
ENDING = {("latin", g): "n" for g in "mfn"} | {("cyrillic", "m"): "в", ("cyrillic", "f"): "ва", ("cyrillic", "n"): "ко"}
# --- end of fixed values --------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX4 = r"[0-9A-Fa-f]{1,4}"
#: Secrets that begin with the mark of their issuer, and what follows it; the mark stays.
PREFIXES = {
    "sk_live_": r"\w{16,}", "sk_test_": r"\w{16,}", "rk_live_": r"\w{16,}", "rk_test_": r"\w{16,}", "pk_live_": r"\w{16,}", "pk_test_": r"\w{16,}",
    "whsec_": r"[\w+/=]{16,}", "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}",
    "ghp_": r"[A-Za-z0-9]{20,}", "gho_": r"[A-Za-z0-9]{20,}", "ghu_": r"[A-Za-z0-9]{20,}", "ghs_": r"[A-Za-z0-9]{20,}", "ghr_": r"[A-Za-z0-9]{20,}",
    "github_pat_": r"\w{22,}", "glpat-": r"[\w-]{20,}", "xoxa-": r"[\w-]{10,}", "xoxb-": r"[\w-]{10,}", "xoxp-": r"[\w-]{10,}", "xoxr-": r"[\w-]{10,}", "xoxs-": r"[\w-]{10,}",
    "AIza": r"[\w-]{35}", "ya29.": r"[\w-]{20,}", "npm_": r"[A-Za-z0-9]{36}", "pypi-": r"[\w-]{32,}", "hf_": r"[A-Za-z0-9]{30,}",
    "SG.": r"[\w-]{16,}\.[\w-]{16,}", "dop_v1_": r"[0-9a-f]{64}", "shpat_": r"[0-9a-f]{32}", "sk-": r"(?=[\w-]*[A-Za-z0-9]{16})[\w-]{20,}",
    "eyJ": r"[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]*)?",
}
_PREFIX = re.compile(rf"(?<![\w-])(?:{'|'.join(f'{re.escape(m)}{rest}' for m, rest in PREFIXES.items())})(?![\w-])", re.ASCII)
_MARK = re.compile("|".join(map(re.escape, PREFIXES)))
_HEX = re.compile(r"[0-9A-Fa-f]{32,64}")
#: Words that introduce a secret, and the value behind them; a value made of words is no secret.
_WORDY = re.compile(r"[A-Za-z]+\d{0,2}(?:[_/=-][A-Za-z]*\d{0,2})*")
_KEYWORD = re.compile(
    r"(?<![a-z])(?:secret|token|passw(?:or)?d|passwort|passphrase|pwd|credentials?|(?:api|access|auth|private|signing|encryption|account)[_ -]?key)"
    r"(?:[_-][a-z]+){0,2}[\"'`]?\s{0,3}(?:=>|:=|=|:|(?<=\s)is(?=\s))\s{0,3}[\"'`]?((?![/~$.*&])[\w+/=~!@#$%^&*?-]{11,4000}[\w+/=~!*-])(?![\w.(\[])"
    r"|(?<![a-z])bearer\s{1,3}([\w.~+/=-]{15,4000}[\w+/=-])", re.IGNORECASE | re.ASCII)
#: The body of a private key in its armour; without an end, all that looks encoded.
_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
                     r"(?:((?:(?!-----)[\s\S]){16,20000})(?=-----END )|((?:(?:\s|\\[nr])*[A-Za-z0-9+/]{20,}={0,2})+(?:(?:\s|\\[nr])+[A-Za-z0-9+/]+={1,2})?))")
#: Words that introduce a telephone number, and the number in any grouping.
_TALK = re.compile(r"(?<![a-z])(?:tel|telephone|telefon|téléphone|teléfono|phone|mobile|mobil|cell|fax|handy|whatsapp|call)(?: (?:number|no|nr|me|us|at|on))*[.:#]*(?: is)?[.:]?\s{0,3}"
                   r"((?!\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4})(?:\+|\()?\d(?:[ ./()-]{0,2}\d){6,14})(?![\w]|[.,/:-]\d)", re.IGNORECASE)
_NAME = r"(?:[^\W\d_]\.(?!\w)|[^\W\d_][\w'’-]{0,100})"
_PERSON = re.compile(rf"\b({'|'.join(t for ts in TITLES.values() for t in ts)})\b(\.? )({_NAME}(?: {_NAME}){{0,3}})")
_INITIAL = re.compile(r"[^\W\d_]\.")


class _Email:
    """Addresses around each ``@``: looked for within the lengths that their syntax allows, so that time stays linear."""

    whole = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    left, right = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")

    def finditer(self, text: str) -> Iterator[re.Match[str]]:
        done, at = 0, text.find("@")
        while at >= 0:
            domain = self.right.match(text, at, at + 256)
            local = self.left.match(text[max(done, at - 254):at][::-1]) if domain else None
            if local and domain:
                found = self.whole.fullmatch(text, at - local.end(), domain.end())
                if found:
                    yield found
                    done = found.end()
            at = text.find("@", at + 1)
#: In order of precedence: of overlapping finds the earlier kind stays.  A find is the group that matched, if there is
#: one; the last entry says what a text must hold for the pattern to be tried ("0" any digit, or one of several marks).
KINDS: list[tuple[str, re.Pattern[str] | _Email, str | tuple[str, ...]]] = [
    ("email", _Email(), "@"),
    ("secret", _ARMOUR, "PRIVATE KEY"),
    ("secret", _PREFIX, tuple(PREFIXES)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"), "0"),
    ("secret", _KEYWORD, "0"),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), "0"),
    ("phone", re.compile(r"(?<![\w+.,-])(?:\+|00(?=[1-9]\d{9,12}(?!\d)))[1-9]\d{7,14}(?!\w|[.,]\d)"), ("+", "00")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"), "0"),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "0"),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"), "0"),
    ("ipv6", re.compile(rf"(?<![\w:.])(?:{_HEX4}(?::{_HEX4}){{7}}|{_HEX4}(?::{_HEX4}){{0,6}}::(?:{_HEX4}(?::{_HEX4}){{0,6}})?)(?![\w:]|\.\d)"), ":"),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)"), "+"),
    # with a country code: eleven digits behind +1, up to 15 in any grouping behind others
    ("phone", re.compile(r"(?<![\w+.,-])(?:\+1(?:[ ./-]?[()]? ?\d){10}(?!\w|[.,]\d)"
                         r"|(?:\+|00(?=[1-9]\d{0,2}[ ./(-]))[1-9](?:[ ./-]?[()]? ?\d){7,14}(?!\w|[.,:/-]\d))"), ("+", "00")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\(\d{3}\) ?\d{3}[-.]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d)"), "0"),
    # area code in brackets or before blanks, or with a leading zero
    ("phone", re.compile(r"(?<![\w+.,-])(?:\(\d{3}\) ?\d{3} ?\d{4}|(?<!\d\d )(?<![02-9] )[2-9]\d{2} \d{3} \d{4}"
                         r"|(?<!\d )(?:\(0[1-9]\d{1,4}\) ?\d{3,4}[ -]?\d{2,5}|0[1-9]\d{1,4}[ /-]\d{5,8}|0[1-9]\d{1,3}(?:[ -]\d{3,4}){2}"
                         r"|0[1-9](?: \d\d){4}|0[1-9](?:\.\d\d){4}|0[1-9](?:-\d\d){4}))(?!\w|[ .,:/-]\d)"), "0"),
    ("phone", _TALK, "0"),
]
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """Weighted digit sum modulo 10; 0 for a valid card number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def mod97(account: str) -> int:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _valid(kind: str, found: str, pattern: re.Pattern[str] | _Email | None = None) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", found)) == 0
    if kind == "iban":
        return mod97(found.replace(" ", "")) == 1
    if pattern is _KEYWORD:
        return _entropy(found) >= 3 and bool(re.search(r"\d", found) and re.search("[A-Za-z]", found)) and not _WORDY.fullmatch(found)
    if kind == "secret" and pattern not in (_PREFIX, _ARMOUR):
        return any(c.isdigit() for c in found) and any(c.isalpha() for c in found)
    if kind == "ipv6":  # slices and scopes of program text are not addresses
        try:
            ipaddress.IPv6Address(found)
        except ValueError:
            return False
        return "::" not in found or len(found.split(":")[0]) == 4 and any(c.isdigit() for c in found)
    return True


def _entropy(s: str) -> float:
    """Bits per character of the string's own letters."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[:1] <= "ӿ" else "latin"


def canonical(kind: str, found: str) -> str:
    """The same string for every way of writing an entity (persons are found with their gender in front)."""
    if kind == "phone":
        return "".join(c for c, stays in _phone_digits(found) if stays)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded.replace(":", "")
    if kind == "secret" and not _HEX.fullmatch(found):
        return found
    return found.lower()


def _phone_digits(found: str) -> list[tuple[str, bool]]:
    """The characters of a number, and whether they are its digits: no separators, no 00 or (0) for dialling."""
    abroad = found.startswith(("+", "00"))
    skip = {0, 1} if found.startswith("00") else set()
    if abroad and "(0)" in found:
        skip.add(found.index("(0)") + 1)
    return [(c, c.isdigit() and i not in skip) for i, c in enumerate(found)]


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of the whole text, in order, without overlaps."""
    if not text:
        return []
    digits = _DIGIT.search(text) is not None
    spans: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, kind: str, form: str) -> None:
        at = bisect.bisect(spans, (start,))
        if start < end and (not at or spans[at - 1][1] <= start) and (at == len(spans) or end <= spans[at][0]):
            spans.insert(at, (start, end, kind, form))

    for kind, pattern, mark in KINDS:
        if digits if mark == "0" else mark in text if isinstance(mark, str) else any(x in text for x in mark):
            for m in pattern.finditer(text):
                group = m.lastindex or 0
                if _valid(kind, m[group], pattern):
                    add(*m.span(group), kind, canonical(kind, m[group]))
    named: list[tuple[int, str, str]] = []
    m = _PERSON.search(text) if any(t in text for ts in TITLES.values() for t in ts) else None
    while m:
        words = []
        for w in m[3].split(" "):  # a name is made of capitalised words
            if not w[0].isupper() or any(w in ts for ts in TITLES.values()):
                break
            words.append(w)
        while len(words) > 1 and _INITIAL.fullmatch(words[-1]):  # "Mr. Smith. A." ends before what begins a sentence
            words.pop()
        name = re.sub(r"(?:['’]s)?['’.-]{0,3}$", "", " ".join(words))
        if name:
            gender = next(g for g, ts in TITLES.items() if m[1] in ts)
            named.append((m.start(3), name, gender))
        m = _PERSON.search(text, m.start(3) + len(name))  # "Frau Dr. Weber": a second form of address
    if named:
        # one gender for a name of this text: a neutral form of address takes that of another one
        genders: dict[str, str] = {}
        for _, name, gender in named:
            if genders.get(name.lower(), "n") == "n":
                genders[name.lower()] = gender
        for start, name, gender in named:
            add(start, start + len(name), "person", _person(name, genders[name.lower()] if gender == "n" else gender))
        # the same names, or their last words, elsewhere in the text
        bare = {n for _, name, _ in named for n in (name, name.split(" ")[-1]) if len(n) > 1 and n[0].isupper()}
        every = sorted({x for n in bare for x in (n, n.upper())} | {x.title() for x in bare if x.isupper()}, key=lambda x: (-len(x), x))
        for m in re.finditer(rf"(?<![\w-])(?:{'|'.join(map(re.escape, every))})(?!\w|-\w)", text) if every else ():
            add(m.start(), m.end(), "person", _person(m[0], genders.get(m[0].lower(), "n")))
    return spans


def _person(name: str, gender: str) -> str:
    """A last name alone has no gender: it is the same name after every form of address."""
    return f"{gender if ' ' in name else 'n'}:{name.lower()}"


def _parts(kind: str, form: str) -> list[tuple[str, str, str]]:
    """(kind, form, gender) of what is drawn for an entity: a person's last name, shared by all who have it, and the words before it.

    The gender is no part of who it is: John Smith is one person behind every form of address.
    """
    if kind != "person":
        return [(kind, form, "")]
    gender, name = form.split(":", 1)
    return [("surname", name.split(" ")[-1], "")] + ([("person", name, gender)] if " " in name else [])


class _Draw:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.seed, self.block, self.left = f"{kind}|{attempt}|{form}".encode(), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key[:64], digest_size=64).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def like(self, s: str) -> str:
        """Digits for digits, letters for letters; a leading zero only where there was one."""
        out = []
        for i, c in enumerate(s):
            if c.isdigit():
                out.append(str(self.below(10) if i or c == "0" else 1 + self.below(9)))
            elif c.isalpha():
                out.append(chr(ord("a") + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def replacement(kind: str, form: str, attempt: int = 0, key: bytes = KEY, gender: str = "n") -> str:
    """The canonical form of the surrogate of a canonical entity."""
    draw = _Draw(key, kind, form, attempt)
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        # a reserved name in place of the registered one; short names grow when they keep colliding
        host = [draw.like(x) for x in labels[:-2]] + ["example", labels[-1]]
        return draw.like(local) + "".join(chr(ord("a") + draw.below(26)) for _ in range(attempt // 4)) + "@" + ".".join(host)
    if kind == "card":
        body = form[0] + "".join(str(draw.below(10)) for _ in form[1:-1])
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        body = form[:2] + "00" + "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in form[4:])
        return f"{body[:2]}{98 - mod97(body):02d}{body[4:]}"
    if kind == "ip":
        low, high = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 100, 3: 255}
        if attempt >= 12:  # any address, when even the longest octets keep colliding
            return ".".join(str(draw.below(256)) for _ in range(4))
        sizes = [min(3, len(o) + attempt // 4) for o in form.split(".")]
        return ".".join(str(low[n] + draw.below(high[n] - low[n])) for n in sizes)
    if kind == "ipv6":
        return _like_ipv6(draw, form, attempt)
    if kind == "phone":
        keep = 1 if form[0] in "017" else max(0, min(2, len(form) - 7))
        return form[:keep] + draw.like(form[keep:])
    if kind == "secret" and not _HEX.fullmatch(form):
        return _like_secret(draw, form)
    if kind == "secret":
        return "".join("0123456789"[draw.below(10)] if c.isdigit() else "abcdef"[draw.below(6)] for c in form)
    if kind == "surname":
        script = _script(form)
        gender = "f" if form[-1] in "ая" else "n" if form.endswith("ко") else "m"
        some = SYLLABLES[script]
        return "".join(some[draw.below(len(some))] for _ in range(3 + attempt // 4)) + ENDING[script, gender]
    if kind == "person":  # new words before the real last name: they must differ among those who share it
        *first, last = form.split(" ")
        script = _script(form)
        some, more = FIRST[script, gender or "n"], SYLLABLES[script]
        words = []
        for old in first:
            if _INITIAL.fullmatch(old) and attempt < 8:  # an initial stays one while letters are left
                letters = "абвгдеиклмнопрст" if script == "cyrillic" else "abcdefghijklmnoprstvw"
                new = [x for x in letters if x != old[0]]
                words.append(new[draw.below(len(new))] + ".")
                continue
            new = [x.lower() for x in some if x.lower() != old]
            words.append(new[draw.below(len(new))] + "".join(more[draw.below(len(more))] for _ in range(attempt // 4)))
        return " ".join([*words, last])
    return draw.like(form)


def _like_secret(draw: _Draw, form: str) -> str:
    """Characters of the same class; the issuer's mark and written line ends stay."""
    mark = _MARK.match(form)
    out = [mark[0] if mark else ""]
    letters = "abcdef" if re.fullmatch("[0-9a-fA-F]+", form) else "abcdefghijklmnopqrstuvwxyz"
    for part in re.split(r"(\\[nr])", form[len(out[0]):]):
        for c in part if not part.startswith("\\") else ():
            some = "0123456789" if c in "0123456789" else letters.upper() if "A" <= c <= "Z" else letters if c.isalpha() else c
            out.append(some[draw.below(len(some))])
        out.append(part if part.startswith("\\") else "")
    return "".join(out)


def _like_ipv6(draw: _Draw, form: str, attempt: int) -> str:
    """Groups of as many digits, the first two digits kept; groups grow, and empty ones fill, when they keep colliding."""
    out = []
    for i in range(0, 32, 4):
        size = len(form[i:i + 4].lstrip("0"))
        size = min(4, size + attempt // 4) if size or attempt >= 16 else 0
        group = "".join("0123456789abcdef"[draw.below(16) if j else 1 + draw.below(15)] for j in range(size)).rjust(4, "0")
        out.append(group if i or form[:2] == "00" else form[:2] + group[2:])
    return "".join(out)


def _written_ipv6(found: str, new: str) -> str:
    groups = [new[i:i + 4].lstrip("0") for i in range(0, 32, 4)]
    head, gap, tail = found.partition("::")
    left, right = (x.split(":") if x else [] for x in (head, tail))
    shaped = [g.rjust(max(1, len(old)), "0") for g, old in zip(groups, left + [""] * (8 - len(left) - len(right)) + right, strict=True)]
    if not gap or any(groups[len(left):8 - len(right)]):
        return ":".join(shaped)
    return ":".join(shaped[:len(left)]) + "::" + ":".join(shaped[8 - len(right):])


def written(kind: str, found: str, new: str) -> str:
    """``new`` in the way in which the entity was written: separators and case."""
    if kind == "secret" and not _HEX.fullmatch(found):
        return new
    if kind == "phone":
        fill = iter(new)
        return "".join(next(fill) if stays else c for c, stays in _phone_digits(found))
    if kind == "ipv6":
        new = _written_ipv6(found, new)
    if kind in ("card", "ssn", "iban"):
        fill = iter(new)
        return "".join(next(fill) if c.isalnum() else c for c in found)
    if kind == "person":
        new = " ".join(w[0].upper() + w[1:] for w in new.split(" "))
    letters = [c for c in found if c.isalpha()]
    capitals = bool(letters) and all(c.isupper() for c in letters)
    if kind == "person":  # initials alone say nothing of the case
        capitals = capitals and any(len(w.strip(".'’-")) > 1 for w in found.split(" "))
    return new.upper() if capitals else new


def replace(text: str | None, overruled: dict[tuple[str, str], tuple[int, str]], key: bytes = KEY) -> tuple[str | None, int]:
    """The text with surrogates and the number of entities; ``overruled`` has the draw and the gender that the corpus settled."""
    spans = find(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for start, end, kind, form in spans:
        new = []
        for k, f, gender in _parts(kind, form):
            attempt, known = overruled.get((k, f), (0, gender))
            new.append(replacement(k, f, attempt, key, known))
        # a person: the last name, behind the words before it if there are any
        out += [text[at:start], written(kind, text[start:end], " ".join([*new[1].split(" ")[:-1], new[0]]) if new[1:] else new[0])]
        at = end
    return "".join(out) + text[at:], len(spans)


def entities(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, form, gender: the distinct entities of every document (no text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(d, *p) for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)
                   for p in sorted({p for _, _, k, f in find(t) for p in _parts(k, f)})]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], batch.schema.field(0).type), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2, 3))],
                names=["doc_id", "kind", "form", "gender"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, kind string, form string, gender string")


def settle(found: DataFrame, key: bytes = KEY, rounds: int = 50) -> DataFrame:
    """kind, form, attempt, gender of the entities that collided and drew again, or whose documents differ in gender."""

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, form: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([replacement(k, f, a, key, g) for k, f, a, g in zip(kind, form, attempt, gender, strict=True)], dtype=object)

    # one gender in the whole corpus: that of the forms of address which tell one, none if they disagree
    told = F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender")))
    known = staged(found.groupBy("kind", "form").agg(
        F.when(F.size(told) == 1, told[0]).otherwise(F.when(F.col("kind") == "person", "n").otherwise("")).alias("gender"),
        (F.count_distinct("gender") > 1).alias("mixed")), "entities")
    table = staged(known.withColumn("attempt", F.lit(0)).withColumn("new", drawn("kind", "form", "attempt", "gender")), "draws")
    columns = ["kind", "form", "gender", "mixed"]
    real = known.select("kind", F.col("form").alias("new"))
    for _ in range(rounds):
        shared = table.groupBy("kind", "new").agg(F.count("*").alias("c"), F.min("form").alias("first")).filter("c > 1")
        doubled = table.join(shared, ["kind", "new"]).filter("form <> first").select("kind", "form")
        lost = staged(doubled.union(table.join(real, ["kind", "new"], "left_semi").select("kind", "form")).distinct()
                      .withColumn("again", F.lit(1)), "lost")
        if not lost.head(1):
            return table.filter("attempt > 0 OR mixed").select("kind", "form", "attempt", "gender")
        table = staged(table.join(lost, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
                       .select(*columns, "attempt", F.when(F.col("again").isNull(), F.col("new")).otherwise(
                           drawn("kind", "form", "attempt", "gender")).alias("new")), "draws")
    raise RuntimeError(f"surrogates still collide after {rounds} draws")


def with_surrogates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", key: bytes = KEY,
                    count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` (and the number of entities in ``count_col``, if named)."""
    small_batches(docs.sparkSession)
    found = staged(entities(docs, id_col, text), "found")
    again = settle(found, key)
    columns = docs.columns
    made, owner, mine = unused(docs, "new", "owner", "own")

    def shaped(df: DataFrame) -> DataFrame:
        out = [F.col(made)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in columns]
        return df.select(*out, *([F.col(made)["n"].alias(count_col)] if count_col else []))

    if again.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED:
        overruled = {(r["kind"], r["form"]): (r["attempt"], r["gender"]) for r in again.collect()}

        @F.pandas_udf("struct<text: string, n: bigint>")
        def run(texts: pd.Series) -> pd.DataFrame:
            got = [replace(t, overruled, key) for t in texts]
            return pd.DataFrame({"text": pd.Series([g[0] for g in got], dtype=object), "n": [g[1] for g in got]})

        return shaped(docs.withColumn(made, run(F.col(text).cast("string"))))

    @F.pandas_udf("struct<text: string, n: bigint>")
    def run_joined(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        got = [replace(t, {(o["kind"], o["form"]): (o["attempt"], o["gender"]) for o in (own[i] if own[i] is not None else ())}, key)
               for i, t in enumerate(texts)]
        return pd.DataFrame({"text": pd.Series([g[0] for g in got], dtype=object), "n": [g[1] for g in got]})

    by_doc = found.drop("gender").join(again, ["kind", "form"]).groupBy(F.col("doc_id").alias(owner)).agg(
        F.collect_set(F.struct("kind", "form", "attempt", "gender")).alias(mine))
    joined = docs.join(by_doc, F.col(id_col).eqNullSafe(F.col(owner)), "left")
    return shaped(joined.withColumn(made, run_joined(F.col(text).cast("string"), F.col(mine))))


def surrogate_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", key: bytes = KEY) -> DataFrame:
    """doc_id, text, n_entities: every document with its personal data replaced."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_surrogates(rows, "doc_id", "text", key, "n_entities")
