"""PII: detected entities are replaced by keyed surrogates of the same kind, format, script and gender.

Each kind's surrogates come from a keyed permutation of the entities of one shape, in which nothing stays where it is: a
Feistel network takes an entity to a number, the next number is taken, and the network's inverse leads back. The names of
one script and gender are a list in a keyed order, each standing for the one before it. The same entity thus has the same
surrogate everywhere, without a table or a shuffle, in whatever layout it is written (an IBAN with or without spaces, a
phone number with or without brackets), and different entities never share one. A second pass checks this against the
corpus: a surrogate that stands for two entities, or for itself, stops the job.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import math
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tune

#: Given names by script and gender; another table may be passed instead.
NAMES: dict[tuple[str, str], list[str]] = {
    ("latin", "f"): """Aisha Alice Amina Ana Ananya Anna Barbara Camille Carmen Charlotte Chloe Claire Elena Elizabeth Emily Emma Fatima Greta Hannah Ingrid
        Isabel Jennifer Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Mary Mei Monika Nancy Olivia Patricia Petra Priya Rosa Sabine Sakura Sarah
        Sofia Sophie Susan Teresa Ursula Yuki""".split(),
    ("latin", "m"): """Ahmed Alexander Ali Andrew Antonio Arjun Carlos Charles Daniel David Diego Felix François George Hans Henri Hiroshi Ibrahim James Javier Jean
        John José Joseph Juan Jürgen Karl Kenji Klaus Louis Luis Mark Michael Miguel Mohammed Omar Pablo Paul Peter Pierre Raj Richard Robert Stefan Steven Thomas
        Wei William Wolfgang Yusuf""".split(),
    ("cyrillic", "f"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Сергей"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία", "Χριστίνα"],
    ("greek", "m"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Ιωάννης", "Κώστας", "Νίκος"],
}
#: Titles that tell a gender, before a family name.
TITLES = ["Mr", "Mrs", "Ms", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame"]
#: Letters that stand for each other: a surrogate keeps case, script and vowels.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äöü", "ñç", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "ъь", "йё"]
_CLASS = {c: (k, i) for k, letters in enumerate([*LETTERS, *(x.upper() for x in LETTERS), "0123456789"]) for i, c in enumerate(letters)}
_SETS = [*LETTERS, *(x.upper() for x in LETTERS), "0123456789"]
#: IPv4 networks whose addresses stay inside (private, shared, loopback, link-local, multicast, reserved).
NETWORKS = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")]
#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT = {"1", "7"}
TWO_DIGITS = {"20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}

PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk-"]
_UPPER = "".join(x.upper() for x in LETTERS)
_LOWER = "".join(LETTERS) + "ßς"
_FAMILY = f"[{_UPPER}][{_LOWER}]{{1,30}}"
_HEX = "[0-9A-Fa-f]"
_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,5}[A-Za-z]{2,24}(?![\w-])",
    "mac": rf"(?<![\w:-]){_HEX}{{2}}(?P<colon>[:-])(?:{_HEX}{{2}}(?P=colon)){{4}}{_HEX}{{2}}(?![\w:-])",
    "ip6": rf"(?<![\w:])(?={_HEX}*:[0-9A-Fa-f:]*)(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,6}})?::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,6}})?)(?![\w:])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:ghp_|gho_|sk_live_|sk-)[A-Za-z0-9]{16,}(?![A-Za-z0-9])",
    "credential": r"(?<!\w)(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|secret[_-]?key)[\"']?\s?[=:]\s?[\"']?(?P<value>[A-Za-z0-9+/_.~-]{7,}[A-Za-z0-9+/])(?![A-Za-z0-9+/])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}(?P<dash>[- ])\d{2}(?P=dash)\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])",
}

#: Characters that one permutation covers: both halves of its network then fit into a hash.
BLOCK = 100


class Surrogates:
    """Keyed surrogates of entities. ``key`` is a secret; another key gives unrelated surrogates."""

    def __init__(self, key: bytes, names: Mapping[tuple[str, str], list[str]] = NAMES) -> None:
        self.key = key
        self.kinds: dict[str, Callable[[str], str]] = {"email": self.email, "mac": self.mac, "ip6": self.ip6, "ip": self.ip, "secret": self.secret, "credential": self.credential, "iban": self.iban, "card": self.card, "ssn": self.ssn, "phone": self.phone, "name": self.name}
        self.next_name: dict[str, str] = {}
        for group, own in names.items():
            ring = sorted(own, key=lambda name: (self._prf("names", group, name), name))
            self.next_name |= dict(zip(ring, ring[1:] + ring[:1], strict=True))

    def _prf(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, repr(parts).encode(), hashlib.sha256).digest(), "little")

    def number(self, salt: object, value: int, size: int) -> int:
        """A keyed permutation of 0 to size - 1 in one single cycle, so that nothing stands for itself (but for size 1).

        With P a Feistel network over a x b >= size that is walked on until inside, it takes x to P'(P(x) + 1).
        """
        if size < 2:
            return value
        b = math.isqrt(size - 1) + 1
        a = -(-size // b)

        def walk(value: int, back: bool) -> int:
            while True:
                left, right = divmod(value, b)
                for turn in range(6, -2, -2) if back else range(0, 8, 2):
                    if back:
                        right = (right - self._prf(salt, size, turn + 1, left)) % b
                        left = (left - self._prf(salt, size, turn, right)) % a
                    else:
                        left = (left + self._prf(salt, size, turn, right)) % a
                        right = (right + self._prf(salt, size, turn + 1, left)) % b
                value = left * b + right
                if value < size:
                    return value

        return walk((walk(value, False) + 1) % size, True)

    @staticmethod
    def blocks(salt: str, text: str, one: Callable[[object, str], str]) -> str:
        """``one`` on each block of a text: the salt of a later block holds all that stands before it, so that different
        texts stay different."""
        out, before = [], hashlib.sha256()
        for a in range(0, len(text), BLOCK):
            part = text[a : a + BLOCK]
            out.append(one((salt, before.hexdigest()) if a else salt, part))
            before.update(part.encode())
        return "".join(out)

    def spell(self, salt: str, text: str) -> str:
        """A keyed permutation of all texts with the same classes of letters and digits at the same places."""
        return self.blocks(salt, text, self._spell)

    def _spell(self, salt: object, text: str) -> str:
        classes = [_CLASS.get(c) for c in text]
        shape = "".join(c if k is None else chr(0xE000 + k[0]) for c, k in zip(text, classes, strict=True))
        size, value = 1, 0
        for k in classes:
            if k is not None:
                value, size = value * len(_SETS[k[0]]) + k[1], size * len(_SETS[k[0]])
        value, out = self.number((salt, shape), value, size), []
        for c, k in zip(reversed(text), reversed(classes), strict=True):
            if k is None:
                out.append(c)
            else:
                value, at = divmod(value, len(_SETS[k[0]]))
                out.append(_SETS[k[0]][at])
        return "".join(reversed(out))

    def digits(self, salt: str, text: str) -> str:
        """A number of as many digits; zeros that lead stay."""
        lead = len(text) - len(text.lstrip("0"))
        n = len(text) - lead
        return text[:lead] + (str(self.number((salt, lead, n), int(text[lead:]) - 10 ** (n - 1), 9 * 10 ** (n - 1)) + 10 ** (n - 1)) if n else "")

    def email(self, text: str) -> str:
        """Letters and digits before the last dot of the domain; the top-level domain stays. Case tells no addresses
        apart, so that the surrogate is made of the lower case."""
        head, _, top = text.lower().rpartition(".")
        return f"{self.spell('email', head)}.{top}"

    def ip(self, text: str) -> str:
        """An address of a special network stays inside, and one outside of them all stays outside."""
        value = _ipv4(text)
        net = next((n for n in NETWORKS if value >> 32 - n.prefixlen == int(n.network_address) >> 32 - n.prefixlen), None)
        if net:
            size = 1 << 32 - net.prefixlen
            value = int(net.network_address) + self.number(("ip", str(net)), value % size, size)
        else:
            while True:
                value = self.number("ip", value, 1 << 32)
                if not any(value >> 32 - n.prefixlen == int(n.network_address) >> 32 - n.prefixlen for n in NETWORKS):
                    break
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def ip6(self, text: str) -> str:
        """The first group, which tells the kind of address, and groups of zeros stay."""
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        own = [i for i in range(1, 8) if groups[i]]
        value = 0
        for i in own:
            value = value * 65535 + groups[i] - 1
        value = self.number(("ip6", groups[0], tuple(own)), value, 65535 ** len(own))
        for i in reversed(own):
            value, groups[i] = value // 65535, value % 65535 + 1
        new = ":".join(f"{g:04x}" for g in groups)
        if "::" in text:
            new = ipaddress.IPv6Address(new).compressed
        elif any(len(g) < 4 for g in text.split(":")):
            new = ":".join(f"{g:x}" for g in groups)
        return new.upper() if text != text.lower() else new

    def mac(self, text: str) -> str:
        """The two bits that tell groups and local addresses stay."""
        value, flags = int(re.sub("[:-]", "", text), 16), 3 << 40
        free = self.number("mac", (value >> 42) << 40 | value & ((1 << 40) - 1), 1 << 46)
        digits = f"{(free >> 40) << 42 | value & flags | free & ((1 << 40) - 1):012x}"
        new = text[2].join(digits[i : i + 2] for i in range(0, 12, 2))
        return new.upper() if text != text.lower() else new

    def card(self, text: str) -> str:
        """The first digit, which tells the network, stays, and so does what the check digit says: right or wrong by as
        much."""
        digits = _digits(text)
        off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
        body = digits[0] + self.spell("card", digits[1:-1])
        return _laid_out(text, body + str((_luhn(body) + off) % 10))

    def iban(self, text: str) -> str:
        """The country stays, and what the check digits say: right or wrong by as much."""
        plain = text.replace(" ", "")
        country, check, account = plain[:2], int(plain[2:4]), plain[4:]
        new = self.spell(f"iban {country}", account)
        if 2 <= check <= 98:  # others are never right, and stay
            check = (_mod97(country, new) + check - _mod97(country, account) - 2) % 97 + 2
        return _laid_out(text, f"{country}{check:02d}{new}")

    def ssn(self, text: str) -> str:
        return _laid_out(text, self.spell("ssn", _digits(text)))

    def secret(self, text: str) -> str:
        """The issuer's prefix stays."""
        head = next(p for p in PREFIXES if text.startswith(p))
        return head + self.spell(f"secret {head}", text[len(head) :])

    def phone(self, text: str) -> str:
        """The country's code stays, and a zero that leads a number within a country; with either or without, the rest has
        the same surrogate."""
        code, rest = _phone(text)
        return _laid_out(text, code + self.digits("phone", rest))

    def credential(self, text: str) -> str:
        """A value in hexadecimal digits stays one."""
        if re.fullmatch("[0-9a-f]+", text):
            return self.blocks("hex", text, lambda salt, part: f"{self.number(salt, int(part, 16), 16 ** len(part)):0{len(part)}x}")
        while True:  # walk on: other values never turn into hexadecimal ones
            text = self.spell("credential", text)
            if not re.fullmatch("[0-9a-f]+", text):
                return text

    def name(self, text: str) -> str:
        """Given name to one of the same script and gender, family name to letters of the same classes; titles stay. A
        part of a name alone has the surrogate that it has in the whole name."""
        first, _, family = text.rpartition(" ")
        if family in self.next_name:
            family = self.next_name[family]
        else:
            while True:  # walk on: other names never turn into given ones
                family = self.spell("family", family)
                if family not in self.next_name:
                    break
        return f"{self.next_name.get(first, first)} {family}" if first else family

    def __call__(self, kind: str, text: str) -> str:
        return self.kinds[kind](text)


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _laid_out(text: str, new: str) -> str:
    """The letters and digits of ``text`` replaced by those of ``new``, in order."""
    letters = iter(new)
    return "".join(next(letters) if c.isalnum() else c for c in text)


def _ipv4(text: str) -> int:
    value = 0
    for part in text.split("."):
        value = value << 8 | int(part)
    return value


def _phone(text: str) -> tuple[str, str]:
    """The digits that stay (a country's code, or a zero before a number within a country) and the others."""
    digits = _digits(text)
    if text.startswith("+"):
        n = 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
    else:
        n = int(digits.startswith("0"))
    return digits[:n], digits[n:]


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _mod97(country: str, account: str) -> int:
    """The check digits of an account."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def canonical(kind: str, text: str) -> str:
    """What tells two entities of a kind apart, whatever their layout."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "mac":
        return re.sub("[:-]", "", text).lower()
    if kind in ("iban", "card", "ssn"):
        return re.sub("[ -]", "", text)
    if kind == "phone":
        return ("+" if text.startswith("+") else "") + _digits(text)
    return text


class Detector:
    """Finds entities; ``names``: given names by script and gender."""

    def __init__(self, names: Mapping[tuple[str, str], list[str]] = NAMES) -> None:
        self.given = {name for own in names.values() for name in own}
        given = "|".join(map(re.escape, sorted(self.given, key=lambda x: (-len(x), x))))
        first = "|".join([*([given] if given else []), *(rf"{t}\.?" for t in TITLES)])
        every = _PATTERNS | {"name": rf"(?<!\w)(?=\w)(?=[{_UPPER}{''.join({n[0] for n in self.given})}])(?:{first}) {_FAMILY}(?!\w)"}
        self.find, self.plain = (re.compile("|".join(f"(?P<{kind}>{every[kind]})" for kind in every if kind not in left)) for left in ((), ("mac", "ip6")))
        self.hexed = re.compile(rf"{_HEX}::?{_HEX}|{_HEX}{{2}}-{_HEX}{{2}}-{_HEX}{{2}}-")  # in every MAC or IPv6 address
        # a text without a digit, an at sign, two groups of hexadecimal letters and all of these has no entity of any kind
        self.marked = re.compile(r"[@\d]|[A-Fa-f]{2}[:-][A-Fa-f]{2}")
        self.words = [*sorted(self.given), *(t + end for t in TITLES for end in " ."), *PREFIXES]

    def may_have(self, text: str) -> bool:
        if self.marked.search(text) or any(w in text for w in self.words):
            return True
        lower = text.lower()
        return any(w in lower for w in ("passw", "pwd", "token", "secret", "key"))

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """Kind, start and end of each entity, in order; of a credential only the value is one. Given and family names that
        the text has as part of a whole name are entities also where they stand alone."""
        out, parts = [], set()
        for m in (self.find if self.hexed.search(text) else self.plain).finditer(text):
            kind = m.lastgroup  # the outer group closes last
            if kind == "ip6" and not _is_host(m[kind]):
                continue
            if kind == "name":
                first, _, family = m[0].rpartition(" ")
                parts |= {family, first} & (self.given | {family})
            out.append((kind, *m.span("value" if kind == "credential" else kind)))
        if not parts:
            return out
        alone, found, at = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=lambda x: (-len(x), x))))})(?!\w)"), [], 0
        for kind, start, stop in [*out, ("", len(text), len(text))]:
            found += [("name", *m.span()) for m in alone.finditer(text, at) if m.end() <= start] if at < start else []
            if kind:
                found.append((kind, start, stop))
            at = stop
        return sorted(set(found), key=lambda e: e[1])


def _is_host(text: str) -> bool:
    """An IPv6 address with more to it than its first group and a last one of 1 (the loopback address)."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text) and int(address) % (1 << 112) > 0 and int(address) != 1


def replace(text: str | None, make: Callable[[str, str], str], detector: Detector | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each entity in order."""
    detector = detector or _DETECTOR
    if not text or not detector.may_have(text):
        return text, []
    out, found, end = [], [], 0
    for kind, start, stop in detector.scan(text):
        entity = text[start:stop]
        new = make(kind, entity)
        out += (text[end:start], new)
        found.append((kind, entity, new))
        end = stop
    return "".join((*out, text[end:])), found


_DETECTOR = Detector()
#: Of an entity: its kind, how it is written, its surrogate, and both without their layout.
_FIELDS = ("kind", "entity", "surrogate", "identity", "stands_in")
ENTITY = f"array<struct<{','.join(f'{n}:string' for n in _FIELDS)}>>"


def surrogates(docs: DataFrame, key: bytes, names: Mapping[tuple[str, str], list[str]] = NAMES) -> DataFrame:
    """``docs`` with the text replaced and _entities: kind, entity and surrogate of each detected entity, in order, and both
    without their layout (identity, stands_in).

    A null text stays null and an empty one empty; both have no entity. Repeated rows get the same text. Other columns
    are left as they are, null ids too; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    memo: dict[tuple[str, str], tuple[str, str, str]] = {}

    @F.arrow_udf(f"struct<text:string,entities:{ENTITY}>")
    def run(text: pa.Array) -> pa.Array:
        own, detector = Surrogates(key, names), Detector(names)

        def told(kind: str, entity: str) -> tuple[str, str, str]:
            """Surrogate, and both without their layout."""
            if (kind, entity) not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                new = own(kind, entity)
                memo[kind, entity] = new, canonical(kind, entity), canonical(kind, new)
            return memo[kind, entity]

        out, found = [], []
        for t in text.to_pylist():
            new, entities = replace(t, lambda kind, entity: told(kind, entity)[0], detector)
            out.append(new)
            found.append([dict(zip(_FIELDS, (k, e, *told(k, e)), strict=True)) for k, e, _ in entities])
        kind = pa.list_(pa.struct([(n, pa.string()) for n in _FIELDS]))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(found, kind)], ["text", "entities"])

    return docs.withColumn("_new", run("text")).withColumns({"text": F.col("_new.text"), "_entities": F.col("_new.entities")}).drop("_new")


def collisions(replaced: DataFrame) -> DataFrame:
    """kind and stands_in of the surrogates that stand for several entities of the corpus, or for themselves: none, if all
    is well."""
    entities = replaced.select(F.explode("_entities").alias("e")).select("e.kind", "e.stands_in", "e.identity")
    found = entities.groupBy("kind", "stands_in").agg(F.min("identity").alias("a"), F.max("identity").alias("b"), F.bool_or(F.col("identity") == F.col("stands_in")).alias("own"))
    return found.filter("a < b OR own").select("kind", "stands_in")


def anonymise(docs: DataFrame, key: bytes, names: Mapping[tuple[str, str], list[str]] = NAMES) -> DataFrame:
    """``docs`` with surrogates and _entities; fails if two entities of the corpus share a surrogate, or one has itself."""
    replaced = Scratch(docs.sparkSession).keep(surrogates(docs, key, names), "replaced")
    if not (found := collisions(replaced).limit(5)).isEmpty():
        raise ValueError(f"surrogates that stand for several entities, or for themselves: {found.collect()}")
    return replaced


#: Of the registered query; a real run brings its own secret.
DEMO_KEY = b"a key for tests"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: each whole text with surrogates, and how many entities of which kinds it had."""
    done = anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return done.select("doc_id", "text", F.size("_entities").alias("n_entities"), F.array_sort(F.array_distinct("_entities.kind")).alias("kinds"))
