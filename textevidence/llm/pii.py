"""Personal information inside free text (problem 4).

Anchor expansion: one Aho-Corasick automaton finds at-signs, number prefixes, identifier and address cues, and
the parts and endings of person names; deterministic local parsers then expand each hit and validate its
boundaries, however far they lie: no parser stops at a fixed distance.  The automaton is built from fixed cues and
the table of name parts (a few hundred rows; checked) and broadcast as its word list.  Number plans are data: digits
by identity cue, one national plan of telephone numbers, and any number with its international prefix.  Texts stay
in their partition; there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .lookfold import FOLD, INVISIBLE

#: Kinds of personal data, the one that wins an overlap first.
KINDS = ["EMAIL", "IDNUM", "PHONE", "ADDRESS", "NAME"]

#: Most rows of the table of name parts; it is collected and broadcast.
MOST_NAMES = 100_000

#: Cues of identity numbers, of addresses and before names.
ID_CUES = ["ssn", "social security", "aadhaar", "nid", "national id", "passport", "identity card", "id card", "পরিচ\u09dfপত্র", "পরিচ\u09af\u09bcপত্র", "এনআইডি", "পাসপোর্ট", "ausweis", "reisepass", "carte d", "dni", "pasaporte", "passeport"]
ADDRESS_CUES = ["house", "flat ", "h-", "vill", " lane", " street", "rue ", "calle ", "weg ", "straße ", "strasse ", "বা\u09dcি", "বা\u09a1\u09bcি", "হোল্ডিং", "লেন", "ফ্ল্যাট", "গ্রাম", "holding", "apt"]
NAME_CUES = ["mr.", "mrs.", "ms.", "dr.", "prof.", "engr.", "mme ", "mlle ", "frau ", "herr ", "sr.", "sra.", "dra.", "জনাব", "ড.", "ডা.", "অধ্যা.", "name:", "নাম:", "proprietor:", "মালিক", "আমার নাম", "my name is", "signed by", "appelle", "me llamo", "ich heiße", "amar nam", "i spoke with"]
NUMBER_CUES = ["01", "০১", "+", "0088", "০০৮৮", "880", "৮৮০", "zero"]

#: Digits of identity numbers without letters, by cue; "" for all other cues.
ID_DIGITS = {"": (10, 13, 17), "ssn": (9,), "social security": (9,), "aadhaar": (12,)}

#: Digits of a telephone number with its international prefix.
WORLD_DIGITS = range(8, 16)

_SPACE = r"[\s ]"
_DIGITS = {c: str(i % 10) for base in (0x09E6, 0x0966, 0x0660, 0x06F0) for i, c in enumerate(range(base, base + 10))}
_MAP = {c: to for c, to in {**FOLD, **_DIGITS}.items() if len(to) <= 1}
for _c in [0x2010, 0x2011, 0x2012, 0x2013, 0x2212]:
    _MAP[_c] = "-"
_SPECIAL = re.compile("[" + "".join(re.escape(chr(c)) for c in _MAP if c < 0x10000) + "]|[\U0001d400-\U0001d7ff]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_DOMAIN = re.compile(rf"\s*({_LABEL}(?:{_DOT}{_LABEL})+)", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = _LOCAL - frozenset("_%+")
_SEP = r"[\s.\-]{0,2}"
_PHONE = re.compile(rf"(?<![\w/@])(?<!\d[.\-])(?:\(\+?88\){_SEP}(?=0)|\+?88[\s.\-]?(?=0)|\+?880{_SEP}(?=1)|00880{_SEP}(?=1)|0088{_SEP}(?=0))?0?1{_SEP}[3-9](?:{_SEP}\d){{8}}(?![\d\w]|[.\-/]\d)")
_SPOKEN = re.compile(r"\bzero\s+one(?:\s+(?:zero|one|two|three|four|five|six|seven|eight|nine)){9}\b", re.I)
_WORLD = re.compile(r"(?<![\w+/@])\+[1-9](?:[ .\-]{0,2}\(?\d\)?){7,14}(?![\w]|[.\-/]\d)")
_PHONE_CHARS = 48  # the longest number of the plan with two separators between any two of its digits
_ID = re.compile(r"\s*(?:(?:no|number|nr|num|নং|নম্বর|card)\.?)?[\s:#.\-–]*((?<![\dA-Za-z])(?:[A-Z]{1,2}\s?\d{6,9}|\d(?:[ \n\-]?\d){8,16}))(?![\dA-Za-z]|[-/]\d)", re.I)
_MRZ_NAME = re.compile(r"P<[A-Z]{3}([A-Z]+(?:<[A-Z]+)*<<[A-Z]+(?:<[A-Z]+)*)|(?<![A-Z<])([A-Z]+(?:<[A-Z]+)*<<[A-Z]+(?:<[A-Z]+)*)(?![A-Z])")
_MRZ_NUMBER = re.compile(r"(?<![A-Z0-9<])([A-Z0-9<]{9})[0-9<][A-Z]{3}[0-9]{6}[0-9<][MFX<][0-9]{6}[0-9<][A-Z0-9<]{2,}")

_RUN = re.compile(r"[A-Z0-9<]+")
_PLACE = r"(?:[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ]+|[ঀ-ৣ]{3,})"
_CITY = rf"(?:\d{{4,6}}\s+{_PLACE}|P\.?\s?O\.?\s+Box\s+\d+|{_PLACE}(?:-\d{{3,6}}|\s+(?-i:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?)(?:\s+(?-i:\d[A-Z]{{2}}))?\b)?)"
_BARI = "বা(?:\u09dc|\u09a1\u09bc)ি"
_WARD = "ও(?:\u09df|\u09af\u09bc)ার্ড"
_SARAK = f"(?:রোড|স(?:\u09dc|\u09a1\u09bc)ক|{_WARD}|সেক্টর|ব্লক|লেন)"
_UNIT = rf"(?:(?:Road|Block|Sector|Ward|Lane|Street)\s+\w+|R-\d+|\d+[A-Z]?(?:/\d+)?\s+(?:\w+\s+)?(?:Lane|Street|Road|Avenue)|\d+º\s?\w|{_SARAK}(?:\s+নং)?\s+\d+\w?|\d+(?:/\d+)?\s+[ঀ-ৣ]+\s+লেন)"
_HEAD = (
    rf"(?:(?:House|Flat|Holding|Apt\.?)\s+\d+[A-Z]?(?:/\d+)?|H-\d+|\d+/\d+\s+\w+\s+(?:Lane|Street|Road)|\d+[A-Z]?\s+\w+\s+(?:Lane|Street)|Vill(?:\.|age)?\s+{_PLACE}"
    rf"|(?:{_BARI}|হোল্ডিং|ফ্ল্যাট)(?:\s+নং)?\s+\d+\w?|\d+(?:/\d+)?\s+[ঀ-ৣ]+\s+লেন|গ্রাম\s+[ঀ-ৣ]+|\d+\s+(?:rue|avenue|boulevard)\s+(?:\w+\s+)?\w+|Calle\s+\w+\s+\d+|\w+(?:weg|straße|strasse|gasse)\s+\d+\w?)"
)
_ADDRESS = re.compile(rf"(?<![\w/-]){_HEAD}(?:,\s*{_UNIT})*,\s*{_CITY}", re.I)

_TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[ঀ-ৣ]+")
_EDGE = re.compile(r"(?<![\w/-])(?=\w)")
_AFTER = re.compile(r"\s+([A-Za-zÀ-ɏ]+|[ঀ-ৣ]+)")
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Engr|Sr|Sra|Dra|M)\.|\b(?:Mme|Mlle|Frau|Herr|bhai)|জনাব|ড\.|ডা\.|অধ্যা\.|\bName:|নাম:|Proprietor:|মালিক|আমার নাম|\bmy name is|\bsigned by|appelle|\bme llamo|\bich heiße|\bamar nam|\bspoke with)\s+\Z", re.I)
_TITLED = re.compile(r"(?:[A-Z]\. )*([A-Z][a-z]{2,}) ([A-Z][a-z]{3,})(?![\w@]|[.\w]*@)")
_ADDRESSED = re.compile(r"[.\-+]\w*[\w.]*@")
_SPACES = re.compile(r"\s*")
_FRENCH = re.compile(r"\s+(?:est|habite|a|était|vit)\b")


def endings(parts: list[str], least: int, most: int, times: int = 5) -> set[str]:
    """Endings that at least ``times`` name parts share and that no shorter one covers as well."""
    counts = Counter(p[-n:] for p in set(parts) for n in range(least, most + 1) if len(p) > n)
    return {e for e, n in counts.items() if n >= times and len(e) <= most}


class Finder:
    """Finds spans of personal data in one text."""

    def __init__(self, names: list[tuple[str, str, str]]):
        fold = [(n.lower(), script, kind) for n, script, kind in names if n]
        self.given = {n for n, _, k in fold if k == "given"}
        self.family = {n for n, _, k in fold if k == "family"}
        latin, bengali = ([n for n in self.family if n.isascii()], [n for n in self.family if not n.isascii()])
        self.family_ends = tuple(endings(latin, 4, 6) | endings(bengali, 3, 5))
        self.given_ends = tuple(endings([n for n in self.given if n.isascii()], 2, 4, 8)) or ("\0",)
        self.given_starts = {n[: max(2, len(n) - 2)] for n in self.given if not n.isascii()}
        words: dict[str, str] = {}
        for w in self.family | set(self.family_ends):
            words[w] = "name"
        for kind, cues in (("id", ID_CUES), ("address", ADDRESS_CUES), ("cue", NAME_CUES), ("number", NUMBER_CUES), ("mail", ["@", "at]", "at)", " dot "]), ("mrz", ["<"])):
            for w in cues:
                words[w] = kind
        self.automaton = ahocorasick.Automaton()
        for w, kind in words.items():
            self.automaton.add_word(w, (kind, len(w)))
        self.automaton.make_automaton()

    def is_family(self, word: str) -> bool:
        low = word.lower()
        return low in self.family or (low.endswith(self.family_ends) if self.family_ends else False) and (not word.isascii() or word[0].isupper())

    def is_given(self, word: str) -> bool:
        low = word.lower()
        return low in self.given or (word[0].isupper() and low.endswith(self.given_ends) if word.isascii() else any(low.startswith(s) and len(low) - len(s) <= 3 for s in (low[: max(2, len(low) - 2)],) if s in self.given_starts))

    def name(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The name around a family part that ends at ``end``."""
        latin = _latin(text[end - 1])
        if end < len(text) and _letter(text[end], latin):
            return None
        while start > 0 and (text[start - 1].isalpha() or "ঀ" <= text[start - 1] <= "ৣ"):
            start -= 1
        m = _TOKEN.match(text, start)
        if m is None or m.end() != end or not self.is_family(m.group()):
            return None
        if start and text[start - 1] in "@._-/+" and not (text[start - 1] == "." and start > 1 and text[start - 2].isupper()):
            return None
        if text[end : end + 1] in ("@", "_") or _ADDRESSED.match(text, end):
            return None
        parts, left = 1, start
        while (before := _word_before(text, left)) is not None:
            at, initial, word = before
            if initial:
                if initial == "M" and not _titled(text, at) and (parts > 1 or _FRENCH.match(text, end)):
                    break  # Monsieur
            elif not (self.is_given(word) or self.is_family(word)) and not (word[0].isupper() and parts == 1 and _titled(text, at) and not _TITLE.search(word + " ")):
                break
            parts, left = parts + 1, at
        right = end
        while m := _AFTER.match(text, right):
            if not self.is_family(m.group(1)) or text[m.end() : m.end() + 1] in ("@", "_"):
                break
            parts, right = parts + 1, m.end()
        if parts < 2 and not _titled(text, left):
            return None
        return left, right

    @staticmethod
    def mail(text: str, start: int, end: int, floor: int) -> tuple[int, int] | None:
        """The address around an at-sign, spelled out or not, or around a spelled-out dot; not before ``floor``."""
        if text[start].isspace():  # a dot: the host's first labels, then the word "at"
            i = _back(text, start, floor)
            while i > floor and text[i - 1] in _HOST:
                i -= 1
            host, j = i, _back(text, i, floor)
            if j == i or text[j - 2 : j].lower() != "at" or j - 2 <= floor or not text[j - 3].isspace():
                return None
            begin = stop = _back(text, j - 2, floor)
            end = host
        elif text[start] == "@":
            begin = stop = start
        else:
            i = _back(text, start, floor)
            if i <= floor or text[i - 1] not in "[(":
                return None
            begin = stop = _back(text, i - 1, floor)
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, end)
        if m is None or not any(c.isalnum() for c in text[begin:stop]) or text[start] == "@" and m.start(1) != end:
            return None
        tail = re.search(r"\.([A-Z][a-z]+)\Z", m.group(1))
        if tail and (host := m.group(1)[: tail.start()]).islower() and text[begin:stop].lower() == text[begin:stop] and "." in host:
            return begin, m.start(1) + tail.start()  # the next sentence, without a space
        return begin, m.end(1)

    @staticmethod
    def address(text: str, start: int, end: int) -> tuple[int, int] | None:
        """The address whose head holds the cue: it begins at the cue's word or up to two words before."""
        left = start
        for _ in range(3):
            left = _back(text, left, 0)
            while left > 0 and not text[left - 1].isspace():
                left -= 1
        for edge in _EDGE.finditer(text, left, end):
            if (m := _ADDRESS.match(text, edge.start())) and start <= m.end():
                return m.span()
        return None

    def spans(self, raw: str, cue: str | None = None) -> list[tuple[int, int, str]]:
        """(start, end, kind), sorted and without overlap.  ``cue`` names a field whose whole text may be a value."""
        text, place = _flat(raw)
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower()[:1] for c in text)
        found: list[tuple[int, int, str]] = []
        done = {"mail": -1, "number": -1, "address": -1, "mrz": -1}
        if cue == "id" and (m := re.search(r"(?<![\w-])([A-Z]{1,2}\s?\d{6,9}|\d(?:[ \n\-]?\d){9,16})\s*\Z", text, re.I)) and _valid_id(m.group(1)):
            found.append((m.start(1), m.end(1), "IDNUM"))
        for end, (kind, size) in self.automaton.iter(low.replace("\n", " ")):
            end += 1
            start = end - size
            if kind == "name":
                if (hit := self.name(text, start, end)) is not None:
                    found.append((*hit, "NAME"))
            elif kind == "cue":
                if (m := _TITLED.match(text, _SPACES.match(text, end).end())) and m.group(1).lower() in self.given and not self.is_family(m.group(2)):
                    found.append((m.start(), m.end(), "NAME"))
            elif kind == "mail":
                if start >= done["mail"] and (hit := self.mail(text, start, end, max(0, done["mail"]))) is not None:
                    found.append((*hit, "EMAIL"))
                    done["mail"] = hit[1]
            elif kind == "number":
                if start < done["number"]:
                    continue
                if size == 4 and text[start].isalpha():
                    hits = [m] if (m := _SPOKEN.match(text, start)) else []
                else:
                    hits = [m for m in _PHONE.finditer(text, max(0, start - 8), min(len(text), end + _PHONE_CHARS)) if m.start() <= start < m.end()]
                    if not hits and size == 1 and (m := _WORLD.match(text, start)) and sum(c.isdigit() for c in m.group()) in WORLD_DIGITS:
                        hits = [m]
                if hits:
                    found.append((*hits[0].span(), "PHONE"))
                    done["number"] = hits[0].end()
            elif kind == "id":
                if (m := _ID.match(text, end)) and (start == 0 or not low[start - 1].isalpha() or not low[start].isascii()):
                    value, lengths = m.group(1), ID_DIGITS.get(low[start:end], ID_DIGITS[""])
                    while not _valid_id(value, lengths) and "\n" in value:  # the next line's number is another one
                        value = value.rpartition("\n")[0]
                    if _valid_id(value, lengths):
                        found.append((m.start(1), m.start(1) + len(value), "IDNUM"))
            elif kind == "address":
                if start >= done["address"] and (hit := self.address(text, start, end)) is not None:
                    found.append((*hit, "ADDRESS"))
                    done["address"] = hit[1]
            elif start >= done["mrz"]:
                a, b = start, end
                while a > 0 and (text[a - 1] == "<" or text[a - 1].isascii() and (text[a - 1].isdigit() or text[a - 1].isupper())):
                    a -= 1
                b = _RUN.match(text, start).end()
                done["mrz"] = b
                for m in _MRZ_NAME.finditer(text, a, b):
                    k = 1 if m.group(1) else 2
                    found.append((m.start(k), m.end(k), "NAME"))
                found += [(m.start(1), m.end(1), "IDNUM") for m in _MRZ_NUMBER.finditer(text, a, b)]
                # the line of the number, which may hold no filler, follows that of the name
                if (m := _RUN.match(text, _SPACES.match(text, b).end())) and (m := _MRZ_NUMBER.match(text, m.start(), m.end())):
                    found.append((m.start(1), m.end(1), "IDNUM"))
        return _settle(found, place, raw)


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha() or "À" <= c <= "ɏ"


def _letter(c: str, latin: bool) -> bool:
    return _latin(c) if latin else "ঀ" <= c <= "ৣ"


def _back(text: str, at: int, floor: int) -> int:
    """The place where the white space before ``at`` begins."""
    while at > floor and text[at - 1].isspace():
        at -= 1
    return at


def _word_before(text: str, left: int) -> tuple[int, str, str] | None:
    """(start, initial, word) of the initial with its full stop or the word before the white space before ``left``."""
    end = _back(text, left, 0)
    if end == left or end == 0:
        return None
    if text[end - 1] == ".":
        at = end - 2
        if at < 0 or not "A" <= text[at] <= "Z" or at and (text[at - 1] in "._" or text[at - 1].isalnum()):
            return None
        return at, text[at], ""
    latin = _latin(text[end - 1])
    at = end
    while at > 0 and _letter(text[at - 1], latin):
        at -= 1
    return (at, "", text[at:end]) if at < end else None


def _titled(text: str, left: int) -> bool:
    """Whether a title or another cue of a name stands before ``left``."""
    return _TITLE.search(text, max(0, _back(text, left, 0) - 16), left) is not None


def _valid_id(value: str, lengths: tuple[int, ...] = ID_DIGITS[""]) -> bool:
    digits = sum(c.isdigit() for c in value)
    if value[0].isalpha():
        return 6 <= digits <= 9
    return digits in lengths and len(set(c for c in value if c.isdigit())) > 1


def _flat(raw: str) -> tuple[str, list[int] | None]:
    """The text with forms, digits and spaces folded, and where each of its characters stood."""
    if raw.isascii() or not _SPECIAL.search(raw):
        return raw, None
    if not _HIDDEN.search(raw):
        return _SPECIAL.sub(lambda m: _MAP.get(ord(m.group()), m.group()) or " ", raw), None
    out, place = [], []
    for i, c in enumerate(raw):
        to = _MAP.get(ord(c), c)
        if to:
            out.append(to)
            place.append(i)
    return "".join(out), place


def _settle(found: list[tuple[int, int, str]], place: list[int] | None, raw: str) -> list[tuple[int, int, str]]:
    """Drop overlaps, the stronger kind first and the longer one of a kind; back to places of the raw text."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for start, end, kind in sorted(set(found), key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0])):
        i = bisect_right(starts, start)
        if i and ends[i - 1] > start or i < len(starts) and starts[i] < end:
            continue
        starts.insert(i, start)
        ends.insert(i, end)
        if place:
            start, end = place[start], place[end - 1] + 1
        kept.append((start, end, kind))
    return sorted(kept)


def name_parts(names: DataFrame, most: int = MOST_NAMES) -> list[tuple[str, str, str]]:
    """The table of name parts; refused beyond ``most`` rows, as it is broadcast."""
    rows = [tuple(r) for r in names.select("name_part", "script", "kind").where("name_part is not null").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} name parts")
    return rows


_FINDERS: dict[int, Finder] = {}


def _run(df: DataFrame, names: list[tuple[str, str, str]], one, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(names)
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _FINDERS.get(key)
        if finder is None:
            _FINDERS.clear()
            finder = _FINDERS[key] = Finder(shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                yield one(finder, part)

    return df.mapInArrow(run, schema)


def _columns(df: DataFrame, id_col: str, text_col: str, id_fields: tuple[str, list[str]] | None) -> DataFrame:
    cue = F.when(df[id_fields[0]].isin(id_fields[1]), F.lit("id")) if id_fields else F.lit(None).cast("string")
    return df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text"), cue.alias("_cue"))


def find(df: DataFrame, names: list[tuple[str, str, str]], id_col: str, text_col: str, record_table: str, id_fields: tuple[str, list[str]] | None = None) -> DataFrame:
    """(record_table, record_id, start_pos, end_pos, pii_type): one row per occurrence.

    Positions count code points of the given text from 0, end exclusive.  Null and empty texts give no row;
    ids that repeat are searched each for itself.  ``id_fields`` names a column and the values of it at which a
    bare number is an identity number.
    """

    def one(finder: Finder, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts, ends, kinds = [], [], [], []
        for i, text, cue in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            for start, end, kind in finder.spans(text, cue):
                ids.append(i)
                starts.append(start)
                ends.append(end)
                kinds.append(kind)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())], names=["record_id", "start_pos", "end_pos", "pii_type"])

    rows = _columns(df, id_col, text_col, id_fields).where("_id is not null and _text is not null and _text != ''")
    return _run(rows, names, one, "record_id long, start_pos long, end_pos long, pii_type string").select(F.lit(record_table).alias("record_table"), "record_id", "start_pos", "end_pos", "pii_type")


def redact(df: DataFrame, names: list[tuple[str, str, str]], id_col: str, text_col: str, id_fields: tuple[str, list[str]] | None = None) -> DataFrame:
    """(id, text, replaced): each text with its personal data replaced by ``[EMAIL]``, ``[NAME]`` and so on.

    One row per input row; null stays null, with 0 replacements.  All other characters stay as they are.
    """

    def one(finder: Finder, part: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for text, cue in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            spans = finder.spans(text, cue) if text else []
            out, at = [], 0
            for start, end, kind in spans:
                out += [text[at:start], f"[{kind}]"]
                at = end
            texts.append("".join([*out, text[at:]]) if spans else text)
            counts.append(len(spans))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[id_col, "text", "replaced"])

    return _run(_columns(df, id_col, text_col, id_fields), names, one, f"{id_col} long, text string, replaced int")
