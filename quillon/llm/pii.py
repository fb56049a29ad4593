"""Personal data and secrets, replaced by keyed, type-consistent surrogates.

Patterns find entities: e-mail addresses, IPv4 and IPv6 addresses, payment cards,
phone numbers, social security numbers, IBANs, secrets after their names, and
persons (a title or a listed given name before a surname, or any name after words
that introduce one). A surrogate has its entity's type and form: letters stay
letters of the same script and case, digits stay digits of the same script, a
valid card stays valid, a listed given name becomes another one of the same gender
and script. It comes from the key alone, so an entity has the same surrogate
wherever it occurs (coreference).

Numbers and codes go through a keyed permutation of all values of the same form,
which keeps distinct entities distinct. Surnames are spelled from a hash, which
may collide, and any surrogate may happen to be another entity of the corpus, or
the entity itself. So all entities are collected once and their surrogates
compared; those that collide get another try, until none does, and the exceptions
are joined to their documents. After ``WIDEN`` tries a surrogate gets longer with
each, so that every entity finds one even where a form has no value left. Given
names are few and listed; none stands for itself, but they may stand for one
another.

Defined results: a null text stays null with no entities; a null doc_id is
carried; repeated rows are treated each for itself, and alike; an empty table
gives an empty one; other columns are carried, whatever their names, but text and
n_entities are replaced. A text of any length is searched whole, in time
proportional to its length; digits and letters of any script are handled.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_batches, named, read_table, saved, sized, slices

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): (
        "Maria Anna Emma Julia Laura Sophie Claire Camille Elena Carmen Lucia Isabel Hannah Katharina Ingrid Greta Alice Emily Sarah Jessica Olivia Charlotte Margaret Elizabeth Jennifer Patricia Linda Susan Karen Nancy "
        "Priya Ananya Svetlana Natasha Olga Irina Yuki Sakura Aiko Fatima Aisha Amina Leila Zainab Ngozi Giulia Chiara Francesca Beatriz Joana Katarzyna Agnieszka Zofia Astrid Freja"
    ).split(),
    ("latin", "m"): (
        "John James Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Hans Karl Friedrich Wolfgang Jean Pierre Antoine Nicolas Carlos Miguel Javier Diego Pablo Henry George Edward Oliver "
        "Hiroshi Kenji Takashi Mohammed Ahmed Omar Hassan Arjun Vikram Sanjay Rajesh Dmitri Sergei Vladimir Luca Marco Giovanni Alessandro Pedro Piotr Lars Sven Erik Kwame Chinedu"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Андрей Алексей Владимир Николай Михаил Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ειρήνη Αθηνά".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος Αλέξανδρος Πέτρος".split(),
}
#: Titles before names, by gender; "n" says nothing of it.
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Sra Señora Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Господин Κύριος".split(), "n": "Dr Prof".split()}
#: Syllables that surnames are spelled with, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ha he ho ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wa we".split(),
    "cyrillic": "ба бе бо ва ве во га ге го да де до за зе зо ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
SURNAME_END = {"latin": ("nd", "ll", "rt"), "cyrillic": ("нов", "рин", "ский"), "greek": ("κης", "δης", "πουλος")}

GENDER_OF = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
#: What a text has to hold for a person with a title or a listed name.
STARTS = (*GENDER_OF, *(title + " " for titles in TITLES.values() for title in titles), *(title + "." for titles in TITLES.values() for title in titles))
TITLE_OF = {title: gender for gender, titles in TITLES.items() for title in titles}

#: Words that make a place, an institution or a form of address of a name before or after them.
NO_NAME = frozenset("Street Avenue Road Lane Square Park Bridge Hall House University College School Institute Academy Union Party Company Corporation Group Bank Church Cathedral Hospital Airport Station Island Islands River Lake Mountain County City State States National International Day Week Prize Award Museum Library Hotel Sir Madam Customer Team All Everyone Colleagues Friends".split())

# letters of scripts without blanks don't join the word before an address
_unspaced = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_word = rf"[^\W{_unspaced}]"
_label = r"[^\W_](?:[\w-]{0,62}[^\W_])?"
EMAIL = re.compile(rf"(?:(?<!\S)[{_unspaced}]{{1,64}}|(?<!{_word})(?<![.+-])(?!_){_word}(?:(?:{_word}|[.+-]){{0,62}}{_word})?)@{_label}(?:\.{_label})*\.[^\W\d_]{{2,24}}(?![\w-])")
SECRET = re.compile(
    r"""(?i)(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)s?(?:[_-][A-Za-z0-9]+){0,3}(?![\w])"""
    r"""(?P<sign>[^\w\n=:]{0,8}[=:][^\w\n]{0,8})(?P<value>[A-Za-z0-9](?:[^\s"'`,;<>()\[\]{}|\\]{6,})[A-Za-z0-9+/=_@$%^&*#!~-])"""
)
#: What a text has to hold, in small letters, to be searched for secrets and introduced names.
SECRET_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
INTRODUCTIONS = ("name is", "dear", "signed by", "sincerely,", "regards,", "wishes,", "je m'appelle", "ich heiße", "me llamo", "mi chiamo", "меня зовут", "με λένε", "name:", "author:", "from:", "to:", "cc:", "attn:", "contact:")
SECRET_SIGN = re.compile(r"[=:]")
#: What tells a secret from a word: a digit, a sign inside, a capital after a small letter.
SECRETIVE = re.compile(r"[0-9+/_@$%^&*#!~=]|[a-z][A-Z]")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
NUMBERS = re.compile(
    r"(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\w]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<card>(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
    r"|(?<![\w.,+-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\w-]| \d))"
)
DIGIT = re.compile(r"\d")
_capital = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ"
_name = rf"(?:[{_capital}]['’])?[{_capital}][^\W\d_]+(?:[-'’][{_capital}][^\W\d_]+)?"
_titles = "|".join(sorted(TITLE_OF, key=len, reverse=True))
PERSON = re.compile(rf"\b(?:(?P<title>{_titles})\.? )?(?P<first>{_name})\b(?:(?= (?P<last>{_name})\b)|)")
#: Words after which any two names are a person's.
INTRODUCED = re.compile(rf"(?:\b(?i:name is|dear|signed by|sincerely,|regards,|wishes,|je m'appelle|ich heiße|me llamo|mi chiamo|меня зовут|με λένε)\s{{1,2}}|\b(?i:name|author|from|to|cc|attn|contact):\s{{0,2}})(?P<first>{_name}) (?P<last>{_name})\b")
#: What a person's name can start with: two words with capitals, or a title before one.
MAYBE_PERSON = re.compile(rf"[{_capital}][^\W\d_]+\.? [{_capital}]")
#: From this try on, surrogates get longer.
WIDEN = 12


def folded(text: str) -> str:
    """Small letters, character by character: as long as the text."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def cased(text: str, like: str) -> str:
    """The text with capitals where another one has them."""
    return "".join(up if o.isupper() and len(up := c.upper()) == 1 else c for c, o in zip(text, like, strict=False)) + text[len(like) :]


def is_ipv6(value: str) -> bool:
    """Whether it is an address; so short a one that it may be names with colons is none."""
    if len(value) < 6 or not DIGIT.search(value):
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


@lru_cache(4096)
def alphabet_of(c: str) -> str:
    """The characters that may stand for one: digits of its script, or letters near it of its case; a sign stands for itself."""
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return c
    kind, start = unicodedata.category(c), ord(c) & ~63
    return "".join(x for x in map(chr, range(start, start + 64)) if unicodedata.category(x) == kind)


def luhn_check(digits: str) -> int:
    """The digit that makes a card number of these digits and it valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


@cache
def _starts() -> ahocorasick.Automaton:
    """Finds the titles and listed names, so that few texts are searched for persons."""
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for word in STARTS:
        found.add_word(word)
    found.make_automaton()
    return found


def is_card(digits: str) -> bool:
    """Whether the first digits are an issuer's and the last one checks."""
    first = int(digits[:2])
    return (30 <= first < 70 or 22 <= first <= 27) and int(digits[-1]) == luhn_check(digits[:-1])


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities, in order, none inside another.

    A person's given name and surname are entities of their own, so that a
    surname alone after a title is the same entity; kinds "given:script:gender"
    and "surname:script".
    """
    spans: list[tuple[int, int, str, str]] = []
    if "@" in text:
        spans += [(*m.span(), "email", m.group()) for m in EMAIL.finditer(text)]
    low = text.lower()
    if SECRET_SIGN.search(text):
        spans += [(*m.span("value"), "secret", m["value"]) for m in (SECRET.finditer(text) if any(map(low.__contains__, SECRET_WORDS)) else ()) if ("=" in m["sign"] or SECRETIVE.search(m["value"])) and not m["value"].startswith("http")]
        if text.count(":") > 1:
            spans += [(*m.span(), "ipv6", m.group()) for m in IPV6.finditer(text) if is_ipv6(m.group())]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            digits = "".join(c for c in m.group() if c.isdecimal())
            if m.lastgroup == "phone" and len(digits) < 7 or m.lastgroup == "card" and not is_card(digits):
                continue  # too short for a phone; no card
            spans.append((*m.span(), m.lastgroup, m.group()))
    if MAYBE_PERSON.search(text):
        for m in PERSON.finditer(text) if next(_starts().iter(text), None) else ():
            title, first, last = m.group("title", "first", "last")
            known = GENDER_OF.get(first)
            if last in NO_NAME:
                last = None
            if known and (title or last):
                spans.append((*m.span("first"), "given:" + ":".join(known), first))
            if known and last and last not in GENDER_OF:
                spans.append((*m.span("last"), "surname:" + script_of(last), last))
            elif title and not known:
                spans.append((*m.span("first"), "surname:" + script_of(first), first))
        for m in INTRODUCED.finditer(text) if any(map(low.__contains__, INTRODUCTIONS)) else ():
            for part in ("first", "last") if m["first"] not in NO_NAME and m["last"] not in NO_NAME and m["first"] not in TITLE_OF else ():
                known = GENDER_OF.get(m[part])
                spans.append((*m.span(part), "given:" + ":".join(known) if known else "surname:" + script_of(m[part]), m[part]))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


class Surrogates:
    """Keyed surrogates; try 0 is the usual one, others are for entities whose surrogate collides."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.names: dict[tuple[str, str], dict[str, str]] = {}

    def number(self, label: str, value: int, size: int, back: bool = False) -> int:
        """A keyed permutation of range(size), or its inverse: a Feistel network over pairs of half numbers, walked until inside."""
        if size <= 1:
            return value
        half = max(1, (size - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1

        def mixed(part: int, k: int) -> int:
            mix = hashlib.shake_256(self.key + part.to_bytes(half // 8 + 1, "big") + b"%d" % k + label.encode())
            return int.from_bytes(mix.digest(half // 8 + 16), "big") & mask

        while True:
            left, right = value >> half, value & mask
            if back:
                for k in reversed(range(self.ROUNDS)):
                    left, right = right ^ mixed(left, k), left
            else:
                for k in range(self.ROUNDS):
                    left, right = right, left ^ mixed(right, k)
            value = left << half | right
            if value < size:
                return value

    def another(self, label: str, value: int, size: int) -> int:
        """A keyed permutation of range(size) that leaves nothing in its place: the next one in a keyed order."""
        return self.number(label, (self.number(label, value, size) + 1) % size, size, back=True)

    def form(self, label: str, text: str, hexadecimal: bool = False) -> str:
        """A text of the same form: each character becomes one of its alphabet.

        Hexadecimal texts stay hexadecimal.
        """
        hexadecimal = hexadecimal or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None and not text.isdecimal()
        digits = "0123456789ABCDEF" if text.upper() == text else "0123456789abcdef"
        alphabets = [(digits if c in digits else c) if hexadecimal else alphabet_of(c) for c in text]
        value, size = 0, 1
        for c, alphabet in zip(text, alphabets, strict=True):
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        value = self.another(f"{label}|{''.join(a[-1] for a in alphabets)}", value, size)
        out = []
        for alphabet in reversed(alphabets):
            value, at = divmod(value, len(alphabet))
            out.append(alphabet[at])
        return "".join(reversed(out))

    def given(self, script: str, gender: str) -> dict[str, str]:
        """Each given name's surrogate: the next one in a keyed order, so none stands for itself."""
        if (script, gender) not in self.names:
            names = GIVEN[script, gender]
            order = sorted(names, key=lambda n: self.number(f"given:{script}:{gender}", names.index(n), len(names)))
            self.names[script, gender] = dict(zip(order, order[1:] + order[:1], strict=True))
        return self.names[script, gender]

    def of(self, kind: str, value: str, attempt: int = 0) -> str:
        label, extra = f"{kind}#{attempt}", max(0, attempt - WIDEN)
        if kind == "email":
            local, _, domain = value.partition("@")
            host, _, top = domain.rpartition(".")
            # one host, one surrogate host: addresses at it stay neighbours
            return f"{self.form(label + '@' + domain, local + 'a' * extra)}@{self.form('host', host)}.{top}"
        if kind == "ipv4":
            a, *rest = map(int, value.split("."))
            low, high = (0, 1) if a == 0 else (1, 224) if a < 224 else (224, 256)
            number, rest = a - low, rest + [0] * extra
            for part in rest:
                number = number * 256 + part
            number = self.another(f"{label}|{low}", number, (high - low) << 8 * len(rest))
            out = []
            for _ in rest:
                number, part = divmod(number, 256)
                out.append(part)
            return ".".join(map(str, [number + low, *reversed(out)]))
        if kind == "ipv6":
            return self.form(label, value + ":0" * extra, True)
        if kind == "card":
            digits = [c for c in value if c.isdecimal()]
            off = (int(digits[-1]) - luhn_check("".join(digits[:-1]))) % 10
            new = digits[0] + self.form(f"{label}|{digits[0]}", "".join(digits[1:-1]) + digits[1] * extra)
            new += alphabet_of(digits[-1])[(luhn_check(new) + off) % 10]
            source = iter(new)
            return "".join(next(source) if c.isdecimal() else c for c in value) + "".join(source)
        if kind == "phone" and value.startswith("+"):
            country = re.match(r"\+\d{1,3}(?=\D)|\+\d", value).group()
            return country + self.form(label + country, value[len(country) :] + value[-1] * extra)
        if kind == "iban":
            return value[:2] + self.form(label + value[:2], value[2:] + value[-1] * extra)
        if kind.startswith("given:"):
            _, script, gender = kind.split(":")
            return self.given(script, gender)[value]
        if kind.startswith("surname:"):
            return self.surname(label, value, kind.split(":")[1], attempt)
        return self.form(label, value + next(c for c in reversed(value) if c.isalnum()) * extra)

    def surname(self, label: str, value: str, script: str, attempt: int = 0) -> str:
        raw = hashlib.blake2b(f"{label}|{folded(value)}".encode(), key=self.key, digest_size=min(8 + attempt, 64)).digest()
        number, syllables, ends = int.from_bytes(raw, "big"), SYLLABLES[script], SURNAME_END[script]
        out = ""
        # a syllable more with each try: there are always more surnames than entities left
        for _ in range((3 if len(value) < 9 else 4) + attempt):
            number, at = divmod(number, len(syllables))
            out += syllables[at]
        out += ends[number % len(ends)]
        return out.upper() if value.isupper() else out.capitalize()


@lru_cache(4)
def surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


def entity(value: str, kind: str) -> str:
    """What counts as one entity: addresses and surnames in any case are the same."""
    return folded(value) if kind in ("email", "ipv6") or kind.startswith("surname") else value


def _entities(docs: DataFrame) -> DataFrame:
    """row, kind and value of every entity found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [(row, kind, entity(value, kind)) for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for kind, value in {(s[2], s[3]) for s in find(text)}]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["row", "kind", "value"])

    return docs.select(F.xxhash64("text").alias("row"), "text").where("text is not null").mapInArrow(run, "row long, kind string, value string")


def collisions(entities: DataFrame, key: bytes, *like: Scratch) -> DataFrame:
    """kind, value and attempt of the entities that need another try than the first.

    ``entities`` are distinct. Of those with one surrogate the smallest keeps it,
    unless it is an entity of the corpus itself. Each round leaves a small share
    of the one before, and widened surrogates always find room, so rounds end.
    ``like`` are tables as large as the entities.
    """

    def tried(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = surrogates(key)
            for batch in batches:
                new = [entity(s.of(kind, value, attempt), kind) for kind, value, attempt in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

        return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")

    own = entities.where("not startswith(kind, 'given:')")
    real = own.select("kind", F.col("value").alias("surrogate"))
    state = Scratch(tried(own.withColumn("attempt", F.lit(0))), "surrogates", *like)
    while True:
        taken = state.df.join(real, ["kind", "surrogate"], "left_semi").select("kind", "surrogate", F.lit(None).cast("string").alias("keeper"))
        # the keeper of a surrogate is whoever has had it longest, then the smallest
        shared = state.df.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("first")).where("n > 1").select("kind", "surrogate", F.col("first.value").alias("keeper"))
        bad = Scratch(shared.unionAll(taken.distinct()).groupBy("kind", "surrogate").agg(F.when(F.count("*") == F.count("keeper"), F.min("keeper")).alias("keeper")), "collisions", *like)
        if bad.df.isEmpty():
            break
        again = F.col("hit").isNotNull() & ~F.coalesce(F.col("keeper") == F.col("value"), F.lit(False))
        marked = state.df.join(sized(bad).withColumn("hit", F.lit(1)), ["kind", "surrogate"], "left").withColumn("again", again)
        fine = marked.where(~F.col("again")).select("kind", "value", "attempt", "surrogate")
        next_tries = tried(marked.where("again").withColumn("attempt", (F.col("attempt") + 1).cast("int")))
        after = Scratch(fine.unionAll(next_tries), "surrogates", *like)
        state.drop()
        state = after
    return state.df.where("attempt > 0").select("kind", "value", "attempt")


def replaced(text: str, key: Surrogates, tries: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    """The text with surrogates, and each entity's span in it."""
    out: list[str] = []
    spans: list[dict] = []
    at = length = 0
    for start, end, kind, value in find(text):
        new = key.of(kind, value, tries.get((kind, entity(value, kind)), 0))
        if kind in ("email", "ipv6") and value != folded(value):
            new = cased(key.of(kind, folded(value), tries.get((kind, folded(value)), 0)), value)
        out += [text[at:start], new]
        length += start - at
        spans.append({"kind": kind.split(":")[0], "start": length, "end": length + len(new)})
        length += len(new)
        at = end
    out.append(text[at:])
    return "".join(out), spans


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with surrogates in text, and n_entities (long) and entities (kind, start, end in the new text)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    table = Scratch(_entities(texts), "entities")
    found = table.df
    entities = saved(found.select("kind", "value").distinct(), "distinct-entities", table)
    exceptions = Scratch(collisions(entities, key, table), "exceptions", table)
    tries = found.join(sized(exceptions), ["kind", "value"]).groupBy("row").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("__pii_tries"))
    patches = Scratch(tries.withColumnRenamed("row", "__pii_row"), "patches", table)
    own = [c for c in docs.columns if c not in ("n_entities", "entities")]
    for used in (table, exceptions):
        used.drop()
    carried = docs.select(*[F.col("text").cast("string").alias("text") if c == "text" else named(c) for c in own])
    joined = carried.join(sized(patches), F.xxhash64("text") == F.col("__pii_row"), "left").drop("__pii_row")
    at = joined.columns.index("text")
    tries_at = joined.columns.index("__pii_tries")
    schema = T.StructType([carried.schema[c] for c in own]).add("n_entities", "long").add("entities", T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = surrogates(key)
        for batch in slices(batches):
            new, spans = [], []
            for text, some in zip(batch.column(at).to_pylist(), batch.column(tries_at).to_pylist(), strict=True):
                if text:
                    text, found = replaced(text, s, {(t["kind"], t["value"]): t["attempt"] for t in some or ()})
                else:
                    found = []
                new.append(text)
                spans.append(found)
            columns = [c for k, c in enumerate(batch.columns) if k != tries_at]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(f) for f in spans], pa.int64()), pa.array(spans, spans_type)], names=[*own, "n_entities", "entities"])

    return map_batches(joined, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return pseudonymise(docs, b"public test key").select("doc_id", "text", "n_entities", kinds.alias("kinds"))
