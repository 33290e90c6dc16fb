"""Personal information in free text (problem 5).

An Aho-Corasick automaton finds anchors: at-signs, the shapes of telephone numbers (with every digit read as 0),
words that introduce identifiers and names, street words, and the names of a lexicon. A small parser for each
kind of anchor expands it to the whole item and validates it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"person_name": "[PERSON]", "phone": "[PHONE]", "email": "[EMAIL]", "id_number": "[ID]", "street_address": "[ADDRESS]"}
#: The lexicon is a dimension table; a larger one is refused instead of being sent to every worker.
MOST_NAMES = 1_000_000

# Words that introduce each kind of item.
AT = ("@", "[at]", "(at)")
PHONE_SHAPES = ("000-000-0000", "000.000.0000", "000 000 0000", "(000)", "0000000000", "00000 000 000", "+0", "000-0000", "00 00 00")
CARD_SHAPES = ("0000 0000 0000 0000", "0000-0000-0000-0000", "0000000000000000", "0000 000000 00000", "0000-000000-00000", "000000000000000")
PHONE_CUES = ("tel", "phone", "fax", "mobile", "cell", "voicemail", "call", "reached", "paged", "pager", "refill from", "number", "contact")
ID_CUES = (
    "mrn", "medical record", "patient id", "member id", "passport", "ssn", "social security", "driver licence",
    "driver license", "driver's licen", "licence no", "license no", "national id", "identity number", "identity card",
    "insurance id", "insurance no", "policy no", "policy number", "health card", "nhs number", "subscriber id",
    "account number", "id number", "id no",
)
STREET_WORDS = (
    "street", "row", "court", "lane", "drive", "avenue", "road", "way", "close", "terrace", "place", "crescent",
    "boulevard", "square", "gardens", "mews", "parkway", "walk", "hill",
)
STREET_STEMS = ("weg", "straße", "strasse", "gasse", "platz", "allee", "rue ", "calle ", "avenida ", "plaza ", "paseo ", "chemin ", "place ", "via ")
BOXES = ("po box", "p.o. box", "p. o. box", "post box", "postfach", "boîte postale", "apartado")
NAME_BEFORE = (
    "dr.", "mr.", "mrs.", "ms.", "mx.", "miss", "prof.", "signed by", "next of kin", "emergency contact", "interpreter",
    "mother,", "father,", "mother", "father", "sister", "brother", "daughter", "son", "wife", "husband", "spouse",
    "given by", "provider:", "reviewed with", "accompanied by", "patient:", "patient name", "spoke with", "seen by",
    "attending", "referred by", "caregiver", "guardian", "dictated by", "witnessed by", "name:",
)
NAME_AFTER = ("states that", "was counselled", "'s brother", "'s sister", "'s mother", "'s father", "'s son", "'s daughter", "'s wife", "'s husband", "’s brother", "’s sister", "recommends", "who agrees")
ROLES = (
    "the an her his their this that no not with who and or to of in on at for from by is was has had can should patient "
    "mother father sister brother daughter son wife husband spouse caregiver nurse doctor provider interpreter family "
    "care team visiting clinic hospital centre center group medical health services infirmary regional klinik clinique "
    "physician specialist parent guardian child neighbour neighbor friend pharmacy laboratory staff contact kin tel phone "
    "unknown none pending see chart review history notes note lives home plan mr mrs ms mx miss dr prof if denies"
)
PARTICLE_WORDS = tuple("van von de del della di da la le den der dos el al bin ter zu".split())
PARTICLES = rf"(?:(?:{'|'.join(PARTICLE_WORDS)})\s+){{0,3}}"
_ROLES = frozenset(ROLES.split())
_W = r"[^\W\d_]"
_CAP = rf"(?:O['’])?(?=[^\W\d_a-zß-öø-ÿ]){_W}(?:{_W}|['’](?={_W}{{2}}))*(?:-(?:O['’])?(?=[^\W\d_a-zß-öø-ÿ]){_W}+)*"
_SP = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"
_PART = rf"(?:[A-Z]\.|{_CAP})"
_NAME = re.compile(rf"{PARTICLES}{_PART}(?:,?{_SP}{PARTICLES}{_PART}){{0,3}}")
_LOWER_NAME = re.compile(rf"{_W}[\w'’.-]+(?:\s+{_W}[\w'’.-]+){{1,3}}?(?=\s+(?:regarding|about|on|by|today|who)\b)")
_NAME_END = re.compile(rf"(?<![\w.'’-]){_PART}(?:{_SP}{PARTICLES}{_PART}){{0,3}}\s*$")
_CREDENTIALS = frozenset("md do rn np pa pa-c phd msn mbbs frcp lpn cna dds".split())
_GAP = re.compile(r"[\s:,]*(?:(?:Dr|Mr|Mrs|Ms|Mx|Prof|Miss)\.?\s+)?")
_DOMAIN = re.compile(r"\s?[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_PHONE = re.compile(
    r"(?:\+\d{1,3}[\s.-]?(?:\(\d+\)[\s.-]?)?\d{1,5}(?:[\s.-]?\d{2,6}){1,5}"
    r"|(?:1[\s.-])?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}"
    r"|0\d{2,5}[\s.-]\d{2,4}(?:[\s.-]\d{2,4}){1,3}|\d{10,11}|\d{3}-\d{4})(?:\s*(?:x|ext\.?)\s*\d{1,5})?"
)
_ID = re.compile(r"(?:\s*(?:no\.?|number|#|is|:|nr\.?))*[\s:#]*([A-Za-z]{0,4}-?\d[A-Za-z\d]*(?:[-\s]?\d[A-Za-z\d]*){0,4})")
_BOX = re.compile(r"\W*(?:no\.?\s*)?\d{1,6}(?:,\s*" + _CAP + r")?")
_NUMBERED = re.compile(rf"(?:(?:Flat|FLAT|Apt\.?|APT\.?|Unit|UNIT|Suite|SUITE)\s+\w+,\s*)?\d{{1,5}}[A-Za-z]?,?\s+(?:{_CAP}\s+){{1,3}}$")
_TAIL = re.compile(rf"(?:,\s*(?:Apt\.?|APT\.?|Flat|FLAT|Unit|UNIT|Suite|SUITE|#)\s*\w+)?(?:,\s*{_CAP})?(?:,?\s+[A-Z]{{2}}\s?\d{{1,5}}(?:\s\d[A-Z]{{2}})?)?")
_STEM_TAIL = re.compile(rf"\s*\d{{1,4}}[a-z]?(?:,\s*\d{{4,5}}\s+{_CAP})?")
_STEM_NAME = re.compile(rf"(?:d[eu]s?\s+|la\s+|del\s+|l['’])*(?:{_CAP}[\s,]*){{1,3}}(?:\d{{1,4}})?")
_AFTER_GIVEN = re.compile(rf"\s+(?:[A-Z]\.\s+)?{PARTICLES}{_CAP}")
_DOUBLE = re.compile(rf"(?:-{_CAP})*")
_CARD = re.compile(r"[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5}")
#: Characters before a telephone number in which a word may announce it.
CUE_REACH = 40
_DIGITS = str.maketrans("123456789", "000000000")
_NOT_PHONE = re.compile(r"(?:lot|order|model|ndc|ref|batch|invoice|product|part)\W*(?:no\W*)?$")


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Finder:
    """The anchors of all parsers as one automaton, and the family names; one anchor may start several parsers."""

    def __init__(self, names: tuple[tuple[str, str], ...]):
        found: dict[str, set[str]] = {}
        for group, words in (
            ("email", AT), ("phone", PHONE_SHAPES), ("card", CARD_SHAPES), ("id", ID_CUES), ("box", BOXES),
            ("street", STREET_WORDS), ("stem", STREET_STEMS), ("before", NAME_BEFORE), ("after", NAME_AFTER),
        ):
            for w in words:
                found.setdefault(w, set()).add(group)
        for name, kind in names:
            found.setdefault(_lower(name), set()).add(kind)
        a = ahocorasick.Automaton()
        for w, groups in found.items():
            a.add_word(w, (len(w), tuple(sorted(groups))))
        a.make_automaton()
        self.anchors, self.families = a, frozenset(n.lower() for n, k in names if k == "family")


@lru_cache(maxsize=2)
def finder(names: tuple[tuple[str, str], ...]) -> Finder:
    """The finder of a lexicon, built once in each worker. Batches ask for it, texts don't."""
    return Finder(names)


def _back(text: str, at: int, words: int) -> int:
    """Where the last ``words`` words before ``at`` begin."""
    for _ in range(words):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def _local_start(text: str, at: int) -> int | None:
    """Where the local part of an e-mail address before ``at`` begins, with one blank allowed between."""
    end = at - 1 if at and text[at - 1].isspace() else at
    begin = end
    while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%-'’"):
        begin -= 1
    while begin < end and text[begin] in "'’":
        begin += 1
    return begin if begin < end else None


def _checksum(number: str) -> bool:
    """The check digit of payment cards (Luhn)."""
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


def _is_name(s: str) -> bool:
    words = [w for w in re.split(r"[\s,.]+", s) if len(w) > 1]
    return bool(words) and not any(w.lower() in _ROLES for w in words) and any(len(w) > 2 for w in words)


def _name_at(text: str, at: int) -> tuple[int, int] | None:
    """A name that starts at ``at``, without words that are no part of names."""
    m = _NAME.match(text, at)
    if not m:
        return None
    end = m.end()
    end = None
    for w in re.finditer(r"[^\s,]+", text[at : m.end()]):
        low = w.group().rstrip(".").lower()
        if (low in _ROLES and low not in PARTICLE_WORDS) or low in _CREDENTIALS:
            break
        end = at + w.end()
    return (at, end) if end and _is_name(text[at:end]) else None


def spans(text: str, names: Finder | tuple[tuple[str, str], ...]) -> list[tuple[int, int, str]]:
    """Items of a text as (start, end, kind), without overlaps, in order."""
    known = names if isinstance(names, Finder) else finder(names)
    low = _lower(text).replace("\n", " ").replace("\t", " ")
    out: list[tuple[int, int, str]] = []
    lexicon = []
    for last, (size, groups) in known.anchors.iter(low.translate(_DIGITS)):
        start, end = last - size + 1, last + 1
        open_left = start == 0 or not (text[start - 1].isalnum())
        open_right = end == len(text) or not (text[end].isalnum())
        for g in groups:
            if g == "email":
                a, b = _local_start(text, start), _DOMAIN.match(text, end)
                if a is not None and b and "." in b.group():
                    out.append((a, b.end(), "email"))
            elif g == "card" and open_left and open_right:
                m = _CARD.fullmatch(text, start, end)
                if m and text[start - 1 : start] not in ("-", ".") and text[end : end + 1] != "-" and _checksum(m.group()):
                    out.append((start, end, "id_number"))
            elif g == "phone":
                at = start
                while at > 0 and (text[at - 1].isdigit() or (text[at - 1] in "+( .-" and at > 1 and (text[at - 2].isdigit() or text[at - 1] in "+("))) and start - at < 8:
                    at -= 1
                m = next((m for k in range(at, start + 1) if (k == 0 or not (text[k - 1].isalnum() or text[k - 1] in "-.")) and (m := _PHONE.match(text, k))), None)
                if m and m.end() >= end - 1 and (m.end() == len(text) or not (text[m.end()].isalnum() or (text[m.end()] == "-" and text[m.end() + 1 : m.end() + 2].isdigit()))):
                    digits = sum(c.isdigit() for c in re.split(r"x|ext", m.group())[0])
                    back = low[max(0, m.start() - CUE_REACH) : m.start()]
                    cue = any(c in back for c in PHONE_CUES)
                    plain = m.group().isdigit() or digits < 10
                    if 7 <= digits <= 15 and not _NOT_PHONE.search(back) and (cue or not plain):
                        out.append((m.start(), m.end(), "phone"))
            elif g == "id" and open_left:
                m = _ID.match(text, end)
                if m and sum(c.isdigit() for c in m.group(1)) >= 5:
                    out.append((m.start(1), m.end(1), "id_number"))
            elif g == "box" and open_left:
                if m := _BOX.match(text, end):
                    out.append((start, m.end(), "street_address"))
            elif g == "street" and open_left and open_right:
                if m := _NUMBERED.search(text, _back(text, start, 6), start):
                    out.append((m.start(), max(end, _TAIL.match(text, end).end()), "street_address"))
            elif g == "stem":
                if text[end - 1].isspace():
                    m = _STEM_NAME.match(text, end) if open_left else None
                    number = re.search(r"\d{1,4}\s?(?:bis|ter)?,?\s*$", text[_back(text, start, 2) : start])
                    if m and (number or m.group().rstrip()[-1:].isdigit()):
                        out.append((start - (len(number.group()) if number else 0), m.end(), "street_address"))
                elif open_right and (m := _STEM_TAIL.match(text, end)):
                    word = re.search(r"[^\W\d_]+$", text[_back(text, start, 1) : start])
                    if word and word.group()[0].isupper():
                        out.append((start - len(word.group()), m.end(), "street_address"))
            elif g == "before" and open_left:
                at = _GAP.match(text, end).end()
                if at > end or text[end - 1] in ".:,":
                    if span := _name_at(text, at):
                        relation = low[start:end] in ("mother", "father", "sister", "brother", "daughter", "son", "wife", "husband", "spouse", "caregiver")
                        if not relation or "\n" not in text[end:at]:
                            out.append((*span, "person_name"))
                    elif low[start:end] == "spoke with" and (m := _LOWER_NAME.match(text, at)) and not any(w in _ROLES for w in m.group().lower().split()):
                        out.append((m.start(), m.end(), "person_name"))
            elif g == "after":
                m = _NAME_END.search(text, _back(text, start, 16), start)
                if m and _is_name(m.group().strip()):
                    out.append((m.start(), m.start() + len(m.group().rstrip()), "person_name"))
            elif g in ("given", "family") and open_left and open_right and not text[start].islower():
                lexicon.append((start, end, g))
    # Family names stand for themselves; a given name needs a family name or an initial and another name after it.
    for start, end, g in lexicon:
        if g == "family":
            end += len(_DOUBLE.match(text, end).group())
            a = _NAME_END.search(text, _back(text, start, 8), start)
            words = [(w.start(), w.group()) for w in re.finditer(r"\S+", a.group())] if a else []
            left = start
            for at, w in reversed(words):
                if w.rstrip(".").lower() in _ROLES or "\n\n" in text[a.start() + at : start]:
                    break
                left = a.start() + at
            if start and text[start - 1] in "-'’" and (b := _back(text, start, 1)) < start:
                left = min(left, b)
            out.append((left, end, "person_name"))
        elif m := _AFTER_GIVEN.match(text, end):
            last = m.group().split()[-1].lower()
            # After "patient" the family name need not be known.
            if last in known.families or (last not in _ROLES and low[_back(text, start, 1) : start].strip() in ("patient", "pt", "pt.")):
                out.append((start, m.end(), "person_name"))
    out.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if kept and s[0] < kept[-1][1]:
            if s[2] == kept[-1][2]:
                kept[-1] = (kept[-1][0], max(s[1], kept[-1][1]), s[2])
            elif kept[-1][2] == "phone" and s[2] == "id_number":
                kept[-1] = s
            continue
        kept.append(s)
    return kept


def lexicon_names(lexicon: DataFrame) -> tuple[tuple[str, str], ...]:
    """The distinct names of the lexicon; a lexicon above ``MOST_NAMES`` is an error."""
    rows = lexicon.where("name is not null and name_kind in ('given', 'family')").select("name", "name_kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the name lexicon has more than {MOST_NAMES} names")
    return tuple(sorted((r.name, r.name_kind) for r in rows))


def _shared(names: tuple[tuple[str, str], ...]):
    """The names as a broadcast, fetched once by each executor."""
    return SparkSession.active().sparkContext.broadcast(names)


def kinds(text: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """Distinct kinds of items in a text; none for null and empty texts."""
    shared = _shared(names)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def find(col: pa.Array) -> pa.Array:
        known = finder(shared.value)
        return pa.array([sorted({k for _, _, k in spans(t, known)}) if t else [] for t in col.to_pylist()], pa.list_(pa.string()))

    return find(text)


def redacted(text: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """The text with each item replaced by the placeholder of its kind; null stays null."""
    shared = _shared(names)

    @F.arrow_udf(T.StringType())
    def replace(col: pa.Array) -> pa.Array:
        known = finder(shared.value)
        return pa.array([_replace(t, known) if t else t for t in col.to_pylist()], pa.string())

    return replace(text)


def _replace(text: str, names: Finder | tuple[tuple[str, str], ...]) -> str:
    parts, at = [], 0
    for start, end, kind in spans(text, names):
        parts += [text[at:start], KINDS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def pages_with_items(pages: DataFrame, blocks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct (document_id, page_number, pii_kind) over the pages' clean_text and the blocks' text.

    Rows without chart or page are left out; null and empty texts have no items; repeated rows count once.
    """
    names = lexicon_names(lexicon)
    texts = pages.select("document_id", "page_number", F.col("clean_text").alias("text")).unionByName(blocks.select("document_id", "page_number", "text"))
    return (
        texts.where("document_id is not null and page_number is not null and text <> ''")
        .select("document_id", "page_number", F.explode(kinds(F.col("text"), names)).alias("pii_kind"))
        .distinct()
    )
