"""Languages of records and of their segments (problem 5).

Multinomial naive Bayes over hashed character n-grams of words.  The matrix of log-probabilities (``BUCKETS`` x
languages, 4 bytes each: about 3 MB, whatever the corpus) is broadcast; batches of texts are scored in numpy: a
word's row of sums is remembered, a sentence is the sum of its words' rows.  Training takes the clean samples
and at most ``TRAIN_ROWS`` labelled rows; it drops rows whose label the first round contradicts.  No shuffle.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sample, slices
from .lookfold import RESIZED, keeps_places, quick_fold, resized

#: Words after which a full stop seldom ends a rough piece of text.
ABBREVIATIONS = """dr mr mrs ms prof st vol pp p no nos fig figs sec cf approx etc vs jan feb mar apr jun jul aug sep sept oct nov dec co ltd inc corp ver
vill engr p.o e.g i.e a.m p.m u.s u.k ph.d gen col capt lt rev hon jr sr dept est ave blvd rd ed eds al ca z b d h nr str usw bzw ges m hr fr evtl inkl
mme mlle env av bd tél sra srta dra aprox núm pág tel md mst sm adv ড ডা অধ্যা লি মি মো মোঃ নং প্রফে ইঞ্জি एड डॉ श्री प्रो पं ต ร ศ อ จ ดร นาย د أ م"""

LANGUAGES = ["en", "bn", "banglish", "fr", "de", "es", "hi", "zh", "ja", "th", "ar"]

#: Buckets of the hashed n-grams; n-gram lengths; bounds of the labelled and of the clean sample; words a worker remembers.
BUCKETS, GRAMS, TRAIN_ROWS, SAMPLE_ROWS, MEMO_SIZE = 1 << 16, (1, 2, 3, 4), 6_000, 20_000, 400_000

#: A text of at most so many characters says too little.
LEAST_CHARS = 15

#: Spellings of language labels.
LABELS = {
    "en": "en eng english", "bn": "bn ben bengali bangla", "banglish": "banglish romanised-bengali romanized-bengali bn-latn", "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch", "es": "es spa spanish español espanol castellano", "hi": "hi hin hindi", "zh": "zh zho chi chinese cmn mandarin", "ja": "ja jpn japanese",
    "th": "th tha thai", "ar": "ar ara arabic",
}
_LABEL = {x: code for code, names in LABELS.items() for x in names.split()}

_WORD = re.compile(r"[^\s\d!-&(-@\[-`{-~।॥。、，！？：；・（）《》「」『』“”„«»…–—¿¡०-९০-৯٠-٩،؛؟०-९]+")
_END = re.compile(r"(?<=[.?!؟])[\"'”’»)\]]*\s+|(?<=[।॥。！？])[\"'”’»」』)\]]*\s*|[\n\r]+")
# Addresses, sites and numbers read out digit by digit are of no language.
_MAIL = re.compile(r"\S*@\S*|www\.\S+|\S+\s*[\[(]at[\])]\s*\S+|\S+ at (?=\S+ dot )|[\[(]dot[\])]\s*\S+|\S+(?: dot \S+)+|(?:\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b\s*){5,}")
_MAIL_SIGNS = ("@", "www.", "at]", "at)", " dot ", "zero")
_DENSE = re.compile("[぀-ヿ㐀-鿿ก-๛]")
_THAI = re.compile("[ก-๛]")
_SHORT = set(ABBREVIATIONS.split())
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_BENGALI = re.compile("[ঀ-ৣৰ-৾]")


def normal_label(label: str | None) -> str | None:
    """The code a label stands for; None if it is missing or undetermined or no known language's."""
    if not label:
        return None
    text = label.strip().casefold().replace("_", "-")
    return _LABEL.get(text) or _LABEL.get(text.split("-")[0])


def words(text: str) -> list[str]:
    """Words of a folded text in lower case; scripts without spaces are cut into short pieces."""
    out = []
    for word in _WORD.findall(text):
        if len(word) > 6 and _DENSE.search(word):
            out += [word[i : i + 4] for i in range(0, len(word), 4)]
        else:
            out.append(word)
    return out


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams."""
    marked = f"_{word}_" if len(word) > 4 or not _DENSE.search(word) else word
    return [zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Rough sentences of a folded text: not cut after abbreviations and initials; Thai is cut at spaces."""
    at = 0
    for m in _END.finditer(text):
        end = m.start()
        if end and text[end - 1] == ".":
            word = text[max(at, end - 12) : end - 1].rsplit(None, 1)[-1:]
            if word and (len(w := word[0].lstrip("(").casefold()) < 2 or w in _SHORT):
                continue
        if end > at:
            yield at, end
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _thai(text: str, spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in spans:
        at = a
        for m in re.finditer(r"(\S+)\s+", text[a:b]):
            if _THAI.search(m.group(1)):
                yield at, a + m.end(1)
                at = a + m.end()
        if at < b:
            yield at, b


def train(rows: list[tuple[str, str]], labelled: list[tuple[str, str]] = ()) -> tuple[np.ndarray, frozenset[str]]:
    """Log-probabilities (buckets x languages) and known words, from clean (language, text) rows and noisy labelled ones.

    A labelled row teaches its label if most of its sentences already read as that language; its other sentences
    teach it too, unless they clearly read as another one.
    """
    place = {code: i for i, code in enumerate(LANGUAGES)}
    counts = np.zeros((BUCKETS, len(LANGUAGES)))
    known: Counter[str] = Counter()

    def add(lang: str, text: str, weight: float) -> None:
        for word in words(_MAIL.sub(" ", text.lower())):
            known[word] += 1 if weight < 1 else 3
            np.add.at(counts[:, place[lang]], grams(word), weight)

    def model() -> tuple[np.ndarray, frozenset[str]]:
        smooth = counts + 0.02
        return np.log(smooth / smooth.sum(0)).astype(np.float32), frozenset(w for w, n in known.items() if n > 2)

    for lang, text in rows:
        if lang in place:
            add(lang, quick_fold(text), 1.0)
    for _ in range(2):
        scorer, todo = Scorer(model()), []
        folded = [(code, quick_fold(text)) for lang, text in labelled if (code := normal_label(lang)) in place and len(text) > LEAST_CHARS]
        for (code, text), found in zip(folded, scorer.segments([t for _, t in folded]), strict=True):
            size = sum(b - a for _, _, a, b in found)
            if size and sum(b - a for lang, _, a, b in found if lang == code) >= 0.6 * size:
                far = {(a, b) for lang, c, a, b in found if lang != code and c > 0.9999999}
                todo += [(code, text[a:b]) for a, b in (_thai(text, pieces(text)) if _THAI.search(text) else pieces(text)) if (a, b) not in far]
        for code, text in todo:
            add(code, text, 0.1)
    return model()


class Scorer:
    """Scores sentences in batches; remembers the rows of words."""

    def __init__(self, model: tuple[np.ndarray, frozenset[str]]):
        self.matrix, self.known = model
        self.n = self.matrix.shape[1]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((4096, self.n + 2), np.float32)

    def add(self, word: str) -> None:
        at = len(self.memo)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        buckets = grams(word)
        seen = word in self.known or len(word) <= 4 and _DENSE.search(word) is not None
        weight = 1.0 if seen else 0.25  # mostly names, which are of no language
        self.rows[at, :-2] = self.matrix[buckets].sum(0) * weight
        self.rows[at, -2] = len(buckets) * weight
        self.rows[at, -1] = seen
        self.memo[word] = at

    def segments(self, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
        """(language, confidence, start, end) of each whole sentence of each folded text that says enough."""
        if len(self.memo) > MEMO_SIZE:
            self.clear()
        parts, owner, spans = [], [], []
        for i, text in enumerate(texts):
            low = text.lower()  # of the same length, but for one Turkish letter
            for a, b in _thai(text, pieces(text)) if _THAI.search(text) else pieces(text):
                part = low[a:b]
                parts.append(words(_MAIL.sub(" ", part) if any(x in part for x in _MAIL_SIGNS) else part))
                owner.append(i)
                spans.append((a, b))
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        if not parts:
            return out
        flat = [w for p in parts for w in p]
        for word in set(flat).difference(self.memo):
            self.add(word)
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        sums = np.zeros((len(parts), self.n + 2), np.float64)
        full = np.flatnonzero(per)
        if len(full):
            starts = (np.cumsum(per) - per)[full]
            sums[full] = np.add.reduceat(self.rows[ids], starts, axis=0)
        scores, size, known = sums[:, :-2], sums[:, -2], sums[:, -1]
        order = np.sort(scores, axis=1)
        best, margin = scores.argmax(1), order[:, -1] - order[:, -2]
        top = scores - order[:, -1:]
        confidence = 1.0 / np.exp(np.maximum(top, -60)).sum(1)
        # a sentence: some words, known ones among them, and a clear language
        for k in np.flatnonzero((size >= 8) & (known >= 2) & (margin > MARGIN)).tolist():
            dense = LANGUAGES[best[k]] in ("zh", "ja", "th")
            if per[k] >= (2 if dense else 3):
                out[owner[k]].append((LANGUAGES[best[k]], float(confidence[k]), *spans[k]))
        return out


#: Least log-odds of the best language over the next.
MARGIN = 6.0

#: Wiki markup that is no prose.
_MARKUP = [
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), " "), (re.compile(r"<ref[^>/]*/>|<ref[^>]*>.*?(?:</ref>|\Z)", re.S | re.I), " "), (re.compile(r"<(nowiki|math|gallery|code|pre|syntaxhighlight)[^>]*>.*?</\1>", re.S | re.I), " "),
    (re.compile(r"\{\|.*?(?:\n\|\}|\Z)", re.S), "\n"), (re.compile(r"\{\{[^{}]*\}\}"), " "), (re.compile(r"\{\{[^{}]*\}\}"), " "), (re.compile(r"\{\{[^{}]*\}\}"), " "),
    (re.compile(r"\[\[[^\[\]|:]*:[^\[\]]*\]\]"), " "), (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"), (re.compile(r"\[https?://\S+ ?([^\]]*)\]|https?://\S+"), r"\1"),
    (re.compile(r"^\s*=+.*?=+\s*$|^[|!].*$|^[*#;:]+|__[A-Z]+__|<[^<>]*>|^\s*\|.*$", re.M), "\n"), (re.compile(r"'{2,}"), ""),
]


#: Words that turn a page into a redirect, in the wikis of the languages.
_REDIRECT = re.compile(r"\s*#\s*(?:redirect|redirection|weiterleitung|redirección|redireccion|redirige|পুনর্নির্দেশ|পুননির্দেশ|पुनर्प्रेषित|अनुप्रेषित|重定向|转送|転送|リダイレクト|เปลี่ยนทาง|تحويل)\b", re.I)


def prose(text: str) -> str:
    """A wiki text without its markup, tables, templates, references and headings."""
    if _REDIRECT.match(text):
        return ""
    for pattern, to in _MARKUP:
        text = pattern.sub(to, text)
    return text


_SCORERS: dict[int, Scorer] = {}


def fit(samples: DataFrame, labelled: list[tuple[DataFrame, str, str]] = (), rows: int = TRAIN_ROWS) -> tuple[np.ndarray, frozenset[str]]:
    """Train on ``samples`` (lang, text; at most ``SAMPLE_ROWS`` rows) and on at most ``rows`` labelled rows of each given
    (table, label, text): those of least hash, so that the model does not depend on the order of rows."""
    noisy = [r for df, label, text in labelled for r in sample(df.where(df[label].isNotNull() & (F.length(df[text]) > LEAST_CHARS)), rows, label, text)]
    return train(sample(samples.where("lang is not null and text is not null"), SAMPLE_ROWS, "lang", "text"), noisy)


def _mapped(df: DataFrame, matrix: tuple, one, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                yield one(scorer, part)

    return df.mapInArrow(run, schema)


def _read(part: pa.RecordBatch, markup: bool) -> list[str]:
    texts = part.column("_text").to_pylist()
    return [quick_fold(prose(t) if markup else t) if t else "" for t in texts]


Places = tuple[np.ndarray, np.ndarray]


def _cut(text: str, places: Places, pattern: re.Pattern[str], to: str | Callable[[re.Match[str]], str]) -> tuple[str, Places]:
    """``pattern.sub(to, text)`` and the place (start, end) in the original of each character."""
    out, own, at = [], [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        own.append(slice(at, m.start()))
        if to == r"\1":
            if m.group(1):
                out.append(m.group(1))
                own.append(slice(m.start(1), m.end(1)))
        else:
            out.append(made := to if isinstance(to, str) else to(m))
            own += [slice(m.start(), m.start() + 1)] * len(made)
        at = m.end()
    if not at:
        return text, places
    own.append(slice(at, len(text)))
    return "".join([*out, text[at:]]), tuple(np.concatenate([x[k] for k in own]) for x in places)


def placed(text: str, markup: bool, want: str | None = None) -> Places | None:
    """The places (starts, ends) in the original of the characters of the text that ``_read`` gives (``want``, if it is
    known); None: the same."""
    if not markup and keeps_places(text):
        return None
    want = quick_fold(prose(text) if markup else text) if want is None else want
    places = np.arange(len(text)), np.arange(1, len(text) + 1)
    if markup:
        for pattern, to in _MARKUP:
            text, places = _cut(text, places, pattern, to)
    whole = _cut(text, places, RESIZED, resized)
    if keeps_places(whole[0]) and len(whole[0]) == len(want):
        return whole[1]
    out: list[str] = []
    own: list[tuple[int, int]] = []
    starts, ends = (x.tolist() for x in places)
    at = 0
    while at < len(text):  # a letter and its marks are folded together
        end = at + 1
        while end < len(text) and (unicodedata.category(text[end])[0] == "M" or 0x1160 <= ord(text[end]) <= 0x11FF or text[end] in "\uff9e\uff9f" or not quick_fold(text[end])):
            end += 1
        part = quick_fold(text[at:end])
        out.append(part)
        own += list(zip(starts[at:end], ends[at:end], strict=True)) if len(part) == end - at else [(starts[at], ends[end - 1])] * len(part)
        at = end
    if (got := "".join(out)) != want:
        # marks that composed across what does not show: aligned by the characters both have
        exact = [(-1, -1)] * len(want)
        for a, b, n in SequenceMatcher(None, got, want, autojunk=False).get_matching_blocks():
            exact[b : b + n] = own[a : a + n]
        for k, x in enumerate(exact):
            if x[0] < 0:
                exact[k] = exact[k - 1] if k else own[0]
        own = exact
    return tuple(np.array(x, np.int64) for x in (zip(*own, strict=True) if own else ((), ())))


def segments(df: DataFrame, matrix: tuple, id_col: str, text_col: str, markup: bool = False) -> DataFrame:
    """(id, start_pos, end_pos, lang, confidence, sentences, main_lang): one row per segment, neighbouring whole
    sentences of one language united; what says too little between them belongs to no language and parts nothing.

    Positions count code points of the given text from 0, end exclusive.  Confidence is the least posterior among
    the segment's sentences; main_lang is the language of most of the record's characters.  Null, empty and blank
    texts, and texts without a sentence, give no row.  Ids that repeat are scored each for itself.
    """
    names = [id_col, "start_pos", "end_pos", "lang", "confidence", "sentences", "main_lang"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string()]

    def one(scorer: Scorer, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = _read(part, markup)
        rows = []
        for i, raw, text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, scorer.segments(texts), strict=True):
            if not found:
                continue
            united: list[list] = []
            for lang, confidence, a, b in found:
                a, b = a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())
                if united and united[-1][2] == lang:
                    united[-1][1], united[-1][3], united[-1][4] = b, min(united[-1][3], confidence), united[-1][4] + 1
                else:
                    united.append([a, b, lang, confidence, 1])
            size: Counter[str] = Counter()
            for lang, _, a, b in found:
                size[lang] += b - a
            main = max(size, key=size.__getitem__)
            places = placed(raw, markup, text)
            rows += [(i, int(places[0][a]) if places else a, int(places[1][b - 1]) if places else b, lang, confidence, n, main) for a, b, lang, confidence, n in united]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text")).where("_text is not null and _text != ''")
    return _mapped(rows, matrix, one, f"{id_col} long, start_pos long, end_pos long, lang string, confidence double, sentences int, main_lang string")


def script_mix(text: str, langs: set[str]) -> str:
    """What the letters of a folded text show: mixed, bn, banglish, en or unknown."""
    latin, bengali = bool(_LATIN.search(text)), bool(_BENGALI.search(text))
    return "mixed" if latin and bengali else "bn" if bengali else "banglish" if latin and "banglish" in langs else "en" if latin else "unknown"


def judged(df: DataFrame, matrix: tuple, id_col: str, text_col: str, label_col: str, markup: bool = False, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, langs, wrong, script): languages with a whole sentence; whether the label is missing, undetermined or
    another language's, or the text holds two languages; and what script the text shows.

    Null, blank and short texts (at most ``least_chars`` characters) get no languages and a null script.
    """

    def one(scorer: Scorer, part: pa.RecordBatch) -> pa.RecordBatch:
        raw = part.column("_text").to_pylist()
        texts = _read(part, markup)
        langs, wrong, scripts = [], [], []
        for text, was, label, found in zip(texts, raw, part.column("_label").to_pylist(), scorer.segments(texts), strict=True):
            says = was is not None and len(was) > least_chars and bool(was.strip())
            own = list(dict.fromkeys(s[0] for s in found)) if says else []
            langs.append(own)
            wrong.append(bool(own) and (len(own) > 1 or normal_label(label) != own[0]))
            scripts.append(script_mix(text, set(own)) if says else None)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.list_(pa.string())), pa.array(wrong, pa.bool_()), pa.array(scripts, pa.string())], names=["record_id", "langs", "wrong", "script"])

    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text"), df[label_col].alias("_label"))
    return _mapped(rows, matrix, one, "record_id long, langs array<string>, wrong boolean, script string")


def found(events: DataFrame, docs: DataFrame, matches: DataFrame, samples: DataFrame, matrix: tuple | None = None) -> DataFrame:
    """(record_table, record_id, lang): languages of records whose label is missing or wrong or whose text is in
    two languages, and the right script_mix of matches whose value is missing or wrong.  Rows are distinct."""
    if matrix is None:
        matrix = fit(samples, [(events, "language", "transcript")])
    of_events = checkpoint(judged(events, matrix, "event_id", "transcript", "language"))
    of_docs = judged(docs, matrix, "doc_id", "text", "lang", markup=True, least_chars=0)

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.where("wrong").select(F.lit(name).alias("record_table"), "record_id", F.explode("langs").alias("lang"))

    scripts = of_events.where("script is not null").select(F.col("record_id").alias("event_id"), "script")
    wrong = matches.select("match_id", "event_id", "script_mix").join(scripts.hint("merge"), "event_id").where("script_mix is null or script_mix != script")
    matched = wrong.select(F.lit("cue_matches").alias("record_table"), F.col("match_id").cast("long").alias("record_id"), F.col("script").alias("lang"))
    return rows(of_events, "corpus_events").unionByName(rows(of_docs, "documents")).unionByName(matched)
