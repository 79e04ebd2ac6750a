"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Entities are e-mail addresses, phone numbers, payment cards (with a valid check digit), network addresses,
social-security numbers, secrets, and names that a title introduces, with their bare repeats in the same document.
Given and last names are entities of their own, so that a person's parts stay the same under every title. A surrogate
is a keyed permutation of the entity's own format: each letter or digit becomes one of the same kind (vowels and
consonants apart in names), by a Feistel network over the whole string, so that different entities of a format never
meet. Given names of known gender become others of that gender, or end as such names do; the gender is the one that
most titles give it over the whole corpus. Surrogates that equal a real entity or another surrogate are found by joins
over all entities of the corpus and drawn again, from formats that grow where one is full. The same entity has the
same surrogate in every document. Only entities drawn again, and given names of unlisted gender, are looked up; all
others are computed where they stand. Whoever holds the key can compute surrogates, so it is never part of the code.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import batches as batch_rows
from sluice.plans import scratch

#: The session's setting that holds the key, where none is passed.
KEY_SETTING = "spark.sluice.surrogate.key"
#: Draws after which a format counts as full and grows.
FULL = 12
#: Redrawn entities up to so many are broadcast (about 100 bytes each); more are joined.
LOOKED_UP = 100_000

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# fixed values: titles by gender, and given names by gender
TITLES = {"m": "Mr Herr Señor Sr Don Monsieur Sir", "f": "Mrs Ms Miss Frau Señora Sra Doña Madame Mme Lady", "n": "Dr Prof"}
GIVEN = {
    "m": "Adam Albert Anton Bruno Carlos Daniel David Diego Emil Felix Georg Henri Hugo Ivan Jack James John Jonas Juan Karl Luis Marc Max Michael Noah Oliver Oscar Pablo Paul Peter Pierre Rafael Robert Simon Thomas Tomas Victor Walter William Xavier",
    "f": "Alice Anna Berta Carmen Clara Diana Elena Emma Eva Flora Greta Hannah Helena Irene Isabel Jane Julia Karla Laura Lea Lena Louise Lucia Maria Marie Mary Nina Nora Olga Olivia Paula Petra Rosa Sarah Silvia Sofia Susan Teresa Vera Zoe",
}
_GENDER = {name.lower(): g for g in "mf" for name in GIVEN[g].split()}
_TITLE = {t.lower(): g for g, names in TITLES.items() for t in names.split()}
#: Endings of given names that are no known ones.
ENDINGS = {"m": "o", "f": "a", "n": "e"}

DIGITS = re.compile(
    rf"(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<card>(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\5\d{4}\5\d{4}|\d{4}([ -])\d{6}\6\d{5})(?!\d))"
)
_START, _RUN = re.compile(r"[+(\d]"), re.compile(r"[+(]*\d*")
_KEYWORD = re.compile(r"(?i)(?<![^\W_])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passw(?:or)?d|pwd)[\"']?\s{0,3}\Z")
_VALUE = re.compile(r"\s{0,3}[\"']?(?P<secret>[A-Za-z0-9_\-+/.]{8,})")
_BARE = {"AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?!\w)"), "gh": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?!\w)"), "sk-": re.compile(r"sk-[A-Za-z0-9]{20,}(?!\w)")}
_HINTS = {"AKIA": ("AKIA",), "gh": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "sk-": ("sk-",)}
NAME = re.compile(rf"(?P<title>{'|'.join(sorted(t for names in TITLES.values() for t in names.split()))})\.?[ ](?:(?P<given>[^\W\d_a-zß-ÿ][\w'’-]+) )?(?P<last>[^\W\d_a-zß-ÿ][\w'’-]+)")
_LOCAL = re.compile(r"[\w.+%-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")


def luhn(digits: str) -> bool:
    """Whether a string of digits has a valid check digit."""
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _titled(text: str) -> list[re.Match[str]]:
    return [m for m in NAME.finditer(text) if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"))]


def genders(text: str) -> list[tuple[str, str]]:
    """(given name, gender) as titles of a text tell it."""
    return [(m["given"].lower(), g) for m in _titled(text) if m["given"] and (g := _TITLE[m["title"].lower()]) != "n"]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(first, end, kind, what it stands for) of each entity of a text, in order, without overlaps."""
    found = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 64), at), _HOST.match(text, at + 1, at + 255)
        if left and right:
            first = left.start() + len(left[0]) - len(left[0].lstrip(".-"))
            if first < at:
                found.append((first, right.end(), "email", text[first : right.end()].lower()))
        at = text.find("@", at + 1)
    at = 0
    while start := _START.search(text, at):
        m = DIGITS.match(text, start.start())
        at = m.end() if m else max(start.end(), _RUN.match(text, start.start()).end())
        if m:
            kind = next(k for k in ("ip", "ssn", "phone", "card") if m[k])
            what = m[0] if kind == "ip" else "".join(c for c in m[0] if c.isdigit())
            if kind != "card" or luhn(what):
                found.append((*m.span(), kind, what))
    for mark in "=:":
        at = text.find(mark)
        while at >= 0:
            if _KEYWORD.search(text, max(0, at - 24), at) and (m := _VALUE.match(text, at + 1)):
                found.append((*m.span("secret"), "secret", m["secret"]))
            at = text.find(mark, at + 1)
    for bare, hints in _HINTS.items():
        for hint in hints:
            at = text.find(hint)
            while at >= 0:
                if (m := _BARE[bare].match(text, at)) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                    found.append((*m.span(), "secret", m[0]))
                at = text.find(hint, at + 1)
    forms: dict[str, str] = {}
    for m in _titled(text):
        for kind in ("given", "last"):
            if m[kind]:
                found.append((*m.span(kind), kind, m[kind].lower()))
                forms |= {m[kind]: kind, m[kind].upper(): kind}
    if forms:  # bare repeats of the names that titles introduced
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(forms, key=len, reverse=True)))})(?!\w)", text):
            found.append((*m.span(), forms[m[0]], m[0].lower()))
    out, end = [], 0
    for f in sorted(found, key=lambda f: (f[0], -f[1])):  # of equal spans, the kind found first
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permute(spots: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the strings whose i-th letter has sizes[i] values: a Feistel network over two halves."""
    half = (len(spots) + 1) // 2
    sides, spans = [], []
    for part in (slice(0, half), slice(half, None)):
        value, span = 0, 1
        for s, n in zip(spots[part], sizes[part], strict=True):
            value, span = value * n + s, span * n
        sides.append(value)
        spans.append(span)
    for turn in range(8):
        a = turn % 2
        sides[a] = (sides[a] + _number(key, tweak, turn, sides[1 - a], *sizes)) % spans[a]
    out: list[int] = []
    for value, part in zip(sides, (sizes[:half], sizes[half:]), strict=True):
        back = []
        for n in reversed(part):
            value, s = divmod(value, n)
            back.append(s)
        out += reversed(back)
    return out


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"


@cache
def _alphabet(c: str, spoken: bool = False) -> str:
    """The letters or digits that may stand for one: of its script and case, and in names of its sound."""
    if spoken and c in _VOWELS + _CONSONANTS:
        return _VOWELS if c in _VOWELS else _CONSONANTS
    if c.isascii():
        return next((x for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in x), c)
    if c in _ACCENTED:
        return _ACCENTED
    if not c.isalnum():
        return c
    base, kind = ord(c) // 128 * 128, unicodedata.category(c)
    return "".join(x for x in map(chr, range(base, base + 128)) if unicodedata.category(x) == kind)


def shuffled(text: str, key: bytes, tweak: str, hexadecimal: bool = False, spoken: bool = False) -> str:
    """A string of the same format: letters and digits permuted within their alphabets, all else kept."""
    held = ["0123456789abcdef" if hexadecimal and c in "0123456789abcdef" else _alphabet(c, spoken) for c in text]
    where = [i for i, letters in enumerate(held) if len(letters) > 1]
    out = list(text)
    for i, s in zip(where, permute([held[i].index(text[i]) for i in where], [len(held[i]) for i in where], key, tweak), strict=True):
        out[i] = held[i][s]
    return "".join(out)


def _more(draw: int) -> int:
    """How far a full format grows."""
    return max(0, draw - FULL)


def _email(what: str, key: bytes, draw: int) -> str:
    local, _, host = what.partition("@")
    labels = host.split(".")
    keep = 2 if labels[-2] == "example" else 1
    new = ".".join([shuffled(".".join(labels[:-keep]), key, "host"), *labels[-keep:]]) if labels[:-keep] else host
    return f"{shuffled(local + 'x' * _more(draw), key, f'email|{draw}|{host}')}@{new}"


def _ip(what: str, key: bytes, draw: int) -> str:
    first, *rest = map(int, what.split("."))
    if _more(draw):
        return ".".join(map(str, permute([first, *rest], [256] * 4, key, f"ip|{draw}")))
    return ".".join(map(str, [first, *permute(rest, [256] * 3, key, f"ip|{draw}|{first}")]))


def _card(what: str, key: bytes, draw: int) -> str:
    keep = 0 if _more(draw) else 1
    body = what[:keep] + shuffled(what[keep:-1], key, f"card|{draw}|{what[:keep]}|{len(what)}")
    return body + next(d for d in string.digits if luhn(body + d))


def _phone(what: str, key: bytes, draw: int) -> str:
    keep = max(1, len(what) - 10)
    return what[:keep] + shuffled(what[keep:] + "0" * _more(draw), key, f"phone|{draw}|{what[:keep]}")


def _ssn(what: str, key: bytes, draw: int) -> str:
    return shuffled(what + "0" * _more(draw), key, f"ssn|{draw}")


def _secret(what: str, key: bytes, draw: int) -> str:
    prefix = next((p for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if what.startswith(p)), "")
    rest = what[len(prefix) :] + "0" * _more(draw)
    return prefix + shuffled(rest, key, f"secret|{draw}", hexadecimal=not rest.strip("0123456789abcdef"))


def _longer(what: str, draw: int) -> str:
    """A name with a syllable more for each draw: names have short formats, of which many are real."""
    return what + ("an" * draw if what[-1:].isascii() else what[-1] * draw)


def _last(what: str, key: bytes, draw: int) -> str:
    return shuffled(_longer(what, draw), key, f"last|{draw}", spoken=True)


def _given(what: str, key: bytes, draw: int, gender: str) -> str:
    names = GIVEN[gender].lower().split() if gender in GIVEN else []
    if not draw and what in names:
        return names[permute([names.index(what)], [len(names)], key, f"given|{gender}")[0]]
    new = shuffled(_longer(what, draw), key, f"given|{draw}", spoken=True)
    return new + ENDINGS[gender] if what.isascii() else new


_MAKERS: dict[str, Callable[[str, bytes, int], str]] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "ssn": _ssn, "secret": _secret, "last": _last}


def surrogate(kind: str, what: str, key: bytes, draw: int = 0, gender: str | None = None) -> str:
    """What stands for an entity; another ``draw`` gives another one. Genders are m, f and n, for given names."""
    if kind == "given":
        return _given(what, key, draw, gender or _GENDER.get(what, "n"))
    return _MAKERS[kind](what, key, draw)


def _written(kind: str, seen: str, new: str) -> str:
    """A surrogate in the spelling of the entity: its punctuation, spaces and capitals."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        return "".join([*(next(digits) if c.isdigit() else c for c in seen), *digits])
    if kind in ("given", "last"):
        return new.upper() if seen.isupper() and len(seen) > 1 else new.title()
    if kind == "email" and len(seen) == len(new):
        return "".join(n.upper() if s.isupper() else n for s, n in zip(seen, new, strict=True))
    return new


def replace(text: str, key: bytes, drawn: dict[tuple[str, str], tuple[int, str | None]] | None = None) -> tuple[str, list[str]]:
    """A text with surrogates, and the kinds of its entities in order. ``drawn`` has (draw, gender) where not (0, None)."""
    parts, at, kinds = [], 0, []
    for first, end, kind, what in detect(text):
        new = surrogate(kind, what, key, *(drawn or {}).get((kind, what), (0, None)))
        parts += [text[at:first], _written(kind, text[first:end], new)]
        kinds.append(kind)
        at = end
    return "".join([*parts, text[at:]]), kinds


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entities of a batch, and how often titles call them male and female."""
    for batch in batches:
        found: dict[tuple[str, str], list[int]] = {}
        for text in filter(None, batch.column(0).to_pylist()):
            for _, _, kind, what in detect(text):
                found.setdefault((kind, what), [0, 0])
            for given, gender in genders(text):
                if ("given", given) in found:
                    found["given", given]["mf".index(gender)] += 1
        columns = [[k for k, _ in found], [w for _, w in found], [n for n, _ in found.values()], [n for _, n in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "what", "male", "female"])


def _drawn(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, w, key, d, g) for k, w, g, d in rows], pa.string())], ["kind", "what", "gender", "draw", "new"])


def drawn_again(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, what, draw, gender) of the entities of ``docs`` that are not drawn once, by their own look.

    Two entities of a kind never share a surrogate, nor does a surrogate equal a real entity: such entities are drawn
    again, all but one of those that share one, until none is left. Formats that are full grow, so this ends.
    """
    schema = "kind string, what string, gender string, draw int, new string"
    seen = docs.select("text").mapInArrow(_entities, "kind string, what string, male long, female long")
    real = seen.groupBy("kind", "what").agg(F.sum("male").alias("male"), F.sum("female").alias("female"))
    gender = F.when(F.col("male") > F.col("female"), "m").when(F.col("female") > F.col("male"), "f")
    real = scratch.keep(real.select("kind", "what", gender.alias("gender")), "entities")
    names = real.select("kind", F.col("what").alias("new"))
    drawn = scratch.keep(real.withColumn("draw", F.lit(0)).mapInArrow(partial(_drawn, key=key), schema), "drawn")
    while True:
        shared = drawn.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min_by("what", F.struct("draw", "what")).alias("first")).where("n > 1")
        bad = drawn.join(shared, ["kind", "new"]).where("what <> first").select("kind", "what")
        bad = scratch.keep(bad.union(drawn.join(names, ["kind", "new"], "left_semi").select("kind", "what")).distinct(), "bad")
        if bad.isEmpty():
            break
        again = drawn.join(bad, ["kind", "what"], "left_semi").select("kind", "what", "gender", F.col("draw") + 1)
        drawn = scratch.keep(drawn.join(bad, ["kind", "what"], "left_anti").union(again.mapInArrow(partial(_drawn, key=key), schema)), "drawn")
    return drawn.where("draw > 0 OR gender IS NOT NULL").select("kind", "what", "draw", "gender")


def _replaced(batches: Iterator[pa.RecordBatch], key: bytes, draws, at: int, joined: bool, label: str) -> Iterator[pa.RecordBatch]:
    """Texts in column ``at``; redrawn entities in the last column if ``joined``, else in ``draws``."""
    for batch in batches:
        texts, kinds = [], []
        own = batch.column(batch.num_columns - 1).to_pylist() if joined else None
        for i, text in enumerate(batch.column(at).to_pylist()):
            table = {(x["kind"], x["what"]): (x["draw"], x["gender"]) for x in own[i] or ()} if joined else draws.value
            new, found = replace(text, key, table) if text else (text, [])
            texts.append(new)
            kinds.append(found)
        rest = batch.columns[: batch.num_columns - joined]
        rest[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*rest, pa.array(kinds, pa.list_(pa.string()))], [*batch.schema.names[: len(rest)], label])


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's KEY_SETTING holds; raises where there is none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"surrogates need a key: pass one, or set {KEY_SETTING}")
    return key.encode()


def pseudonymise(docs: DataFrame, key: bytes | None = None, kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with surrogates in its column text, and the kinds replaced in order in a new column ``kinds``.

    ``key`` has 1 to 64 bytes; without one, the session's setting is taken (``key_of``). Null and empty texts stay as
    they are, with no kinds; repeated rows get equal results; all other columns pass unchanged (one named as ``kinds`` is
    replaced). No rows give none. Two passes over the texts, no shuffle of them unless more than LOOKED_UP entities are
    looked up.
    """
    spark = docs.sparkSession
    key = key or key_of(spark)
    batch_rows.bound(spark)
    docs = docs.drop(kinds)
    again = scratch.keep(drawn_again(docs, key), "again")
    names = docs.columns
    rows, draws, joined = docs, None, False
    if again.count() <= LOOKED_UP:
        draws = spark.sparkContext.broadcast({(r["kind"], r["what"]): (r["draw"], r["gender"]) for r in again.collect()})
    else:
        joined = True
        row, held = (batch_rows.free(names, x) for x in ("row", "again"))
        keyed = docs.withColumn(row, F.xxhash64("text"))
        found = keyed.select(row, "text").mapInArrow(_row_entities, f"`{row}` long, kind string, what string").distinct()
        found = found.join(again, ["kind", "what"]).groupBy(row).agg(F.collect_list(F.struct("kind", "what", "draw", "gender")).alias(held))
        rows = keyed.join(found, row, "left").select(*(F.col(f"`{n}`") for n in names), held)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(partial(_replaced, key=key, draws=draws, at=names.index("text"), joined=joined, label=kinds), f"{schema}, `{kinds}` array<string>")


def _row_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(row, kind, what) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for _, _, kind, what in detect(text)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["row", "kind", "what"])
