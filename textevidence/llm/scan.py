"""Noise in text from scanned pages (problem 1).

An averaged perceptron edits characters: at each place of a word it scores keep, replace (one or two characters by
one or two), delete and insert, and at a line's end whether a hyphen joins the line with the next.  A word's edits
and what they make of it (a word of the vocabulary, how frequent, or none) are scored together, and so is leaving it
alone; the best wins.  It is trained on words of clean pages with the confusions, losses and gains that the scans
themselves show: scanned words that turn into frequent clean ones by one small change.  Rare words, taken out of the
vocabulary for the moment, teach it to leave alone what it does not know.  A second perceptron sees the place of a line on its page, what stands around it and its words, and
finds running headers, page numbers and stamps; headers that repeat within a file teach it.

Word counts cover all pages and are made in Spark; what reaches the driver is bounded (``MOST_WORDS``,
``TRAIN_PAGES``).  Texts are never shuffled: each page turns into a short row, and only those meet, by file for
repeated headers and by (file, page) for words that go on overleaf.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .lookfold import quick_fold

#: Bounds of what reaches the driver: vocabulary, unknown words that teach confusions, pages that teach furniture.
MOST_WORDS, MOST_UNKNOWN, TRAIN_PAGES = 300_000, 60_000, 3_000

#: Share of all changes seen that a confusion must make up.
LEAST_SHARE = 1e-3

#: Share of all clean words that a word must make up to teach confusions.
SHARE = 1e-4

#: Below this score not even a repeated line is furniture: a chapter's heading may stand on several pages.
CONTENT = -150.0

#: A word that scans have so often is not taken for a misread form of a word that clean pages lack.
OFTEN = 8

#: Words that the vocabulary is made to lack for each noisy one; weight of a loss or gain of any character against that
#: of a usual confusion; least lead, in training, of leaving an unknown word alone.
UNKNOWN, STRAY, MARGIN = 1.2, 0.01, 6.0

#: Share of a file's pages that a running header heads.
REPEATED = 0.5

_PUNCT = ".,;:!?।॥“”\"'()[]{}«»„‘’‹›¿¡。、！？，；：「」『』—–|<>؟،؛…*"
_HYPHEN = re.compile(r"(\S*?[^\W\d_])[-‐¬\u00ad][ \t]*$")
_BROKEN = re.compile(r"[-‐¬\u00ad][ \t]*\n\s*\S+")
_HYPHENS = set("-‐¬\u00ad")
_INNER = re.compile(r"(?<=[^\W\d_])[.!?;,](?=[^\W\d_])|[।॥。]")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")
_ODD = re.compile(r"@|www\.|://|<<|^\W*$|^[\d\W]+$|\d.*\d.*\d")
_NUMBER = re.compile(r"^\W*(?:page|seite|página|pagina|p\.|s\.|পৃষ্ঠা|पृष्ठ)?\W*(\d{1,4})\W*(?:(?:of|von|de|sur|/)\W*(\d{1,4}))?\W*$", re.I)
_PLAIN = re.compile(r"^\s*\d{1,4}\s*$")


def clean_word(token: str) -> str:
    return token.strip(_PUNCT).lower()


def unbroken(text: str) -> str:
    """A text without the words that are broken over lines, whose halves are no words."""
    out, at = [], 0
    for m in _BROKEN.finditer(text):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        out.append(text[at:start])
        at = m.end()
    return " ".join([*out, text[at:]]) if out else text


def words_of(text: str) -> list[str]:
    """Words of a folded text as they are counted and corrected: lower case, no punctuation at their ends."""
    return [w for token in text.split() for part in (_INNER.split(token) if "@" not in token and "www." not in token else (token,)) if (w := clean_word(part)) and not _ODD.search(w)]


def unaccented(word: str) -> str:
    """A Latin word without its accents, which scans lose with the letter under them."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not "\u0300" <= c <= "\u036f")


class Perceptron:
    """Averaged multiclass perceptron over string features; a class is part of the feature."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        self._total: dict[str, float] = defaultdict(float)
        self._stamp: dict[str, int] = defaultdict(int)
        self._t = 0

    def score(self, op: str, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f"{op}|{f}", 0.0) for f in features)

    def learn(self, right: str, features: list[str], ops: list[str]) -> bool:
        self._t += 1
        best = max(ops, key=lambda op: (self.score(op, features), op != right))
        if best != right:
            for f in features:
                for op, step in ((right, 1.0), (best, -1.0)):
                    key = f"{op}|{f}"
                    self._total[key] += (self._t - self._stamp[key]) * self.weights[key]
                    self._stamp[key] = self._t
                    self.weights[key] += step
        return best == right

    def move(self, good: list[str], bad: list[str]) -> None:
        """One step towards the features of the right answer and away from those of the one that was given."""
        self._t += 1
        for keys, step in ((good, 1.0), (bad, -1.0)):
            for key in keys:
                self._total[key] += (self._t - self._stamp[key]) * self.weights[key]
                self._stamp[key] = self._t
                self.weights[key] += step

    def average(self) -> Perceptron:
        out = {}
        for key, w in self.weights.items():
            total = self._total[key] + (self._t - self._stamp[key]) * w
            if value := total / max(1, self._t):
                out[key] = round(value * 10, 3)
        self.weights = out
        return self


def place_features(word: str, i: int, n: int) -> list[str]:
    """What the editor sees around word[i : i + n]."""
    w = f"^^{word}$$"
    i += 2
    a, b = w[i - 1], w[i + n]
    return ["", a, f">{b}", f"{w[i - 2]}{a}<", f">{b}{w[i + n + 1] if i + n + 1 < len(w) else '$'}", f"{a}_{b}", f"{w[i - 2]}{a}_{b}", "d" if any(c.isdigit() for c in word) else "l"]


#: An edit: place, characters that go, characters that come.
Edit = tuple[int, int, str]


def edited(word: str, edits: tuple[Edit, ...]) -> str:
    """``word`` after ``edits``, each of which counts places in what the ones before have made."""
    for i, n, y in edits:
        word = word[:i] + y + word[i + n :]
    return word


class Editor:
    """Corrects words: a perceptron scores keeping and every edit, and what comes of it."""

    def __init__(self, vocabulary: dict[str, int], confusions: dict[str, list[str]], model: Perceptron, unknown: dict[str, int] | None = None):
        """``unknown``: how often scans have words that the vocabulary lacks."""
        self.vocabulary, self.confusions, self.model = vocabulary, confusions, model
        self.often = {w for w, n in (unknown or {}).items() if n >= OFTEN}
        self.memo: dict[str, str | None] = {}
        self.plain: dict[str, str] = {}
        for w in sorted(vocabulary, key=vocabulary.__getitem__):
            if not w.isascii() and (p := unaccented(w)) != w:
                self.plain[p] = w
        self.total, self.longest = max(1, sum(vocabulary.values())), max(map(len, vocabulary), default=0)
        self.letters: dict[int, list[str]] = defaultdict(list)  # by block of code points
        for c in sorted({c for w in vocabulary for c in w if not c.isdigit()}):
            self.letters[ord(c) >> 7].append(c)
        self.letters = dict(self.letters)

    def known(self, word: str, without: str | None = None) -> str | None:
        """The word of the vocabulary that ``word`` is, with the accents that scans lose."""
        if word in self.vocabulary and word != without:
            return word
        full = self.plain.get(word) or (self.plain.get(unaccented(word)) if not word.isascii() else None)
        return full if full != without else None

    def single(self, word: str) -> list[Edit]:
        """Edits of one place that scans call for."""
        return [(i, n, y) for i in range(len(word) + 1) for n in (0, 1, 2) if len(x := word[i : i + n]) == n for y in self.confusions.get(x, ())]

    def nearby(self, word: str, without: str | None = None) -> list[Edit]:
        """A character lost or gained, whichever it is, if that makes a word of the vocabulary."""
        if len(word) > self.longest + 1:
            return []
        v = self.vocabulary
        out = [(i, 1, "") for i in range(len(word)) if not word[i].isdigit() and (w := word[:i] + word[i + 1 :]) in v and w != without]
        letters = [c for block in sorted({ord(c) >> 7 for c in word}) for c in self.letters.get(block, ())]
        return out + [(i, 0, c) for i in range(len(word) + 1) for c in letters if (w := word[:i] + c + word[i:]) in v and w != without]

    def features(self, word: str, edits: tuple[Edit, ...], result: str, found: bool) -> list[str]:
        """What the model sees of edits: their places, and what becomes of the word."""
        out, at = [], word
        kind = "keep"
        for i, n, y in edits:
            x, place = at[i : i + n], place_features(at, i, n)
            kind = "del" if not y else "ins" if not n else "one" if n == len(y) == 1 else "more"
            out += [f"{x}>{y}|{f}" for f in place]
            out += [f"{kind}|{place[0]}", f"{kind}|{place[-1]}"]
            at = at[:i] + y + at[i + n :]
        count = self.vocabulary.get(result, 0)
        often = min(9, int(math.log2(1 + 1e6 * count / self.total))) if found else -1
        size, digits, left = min(9, len(word)), *(min(2, sum(c.isdigit() for c in x)) for x in (word, result))
        what = f"{kind if len(edits) < 2 else 'two'}|{found}"
        return [*out, f"{what}|{often}", f"{what}|{size}", f"{what}|{digits}>{left}|{word[:1].isalpha()}", f"edits{len(edits)}"]

    def parts(self, word: str, result: str, edits: tuple[Edit, ...], found: bool) -> tuple[list[str], list[str]]:
        """Features of edits, and those of keeping what they change."""
        kept, at = [], word
        for i, n, y in edits:
            kept += [f"=|{f}" for f in place_features(at, i, n)]
            at = at[:i] + y + at[i + n :]
        return self.features(word, edits, result, found), kept

    def score(self, word: str, edits: tuple[Edit, ...], result: str, found: bool) -> float:
        get = self.model.weights.get
        own, kept = self.parts(word, result, edits, found)
        return sum(get(f, 0.0) for f in own) - sum(get(f, 0.0) for f in kept)

    def candidates(self, word: str, without: str | None = None) -> list[tuple[str, tuple[Edit, ...], bool]]:
        """(result, edits, whether it is known) of keeping ``word`` and of all edits that come into question."""
        out: list[tuple[str, tuple[Edit, ...], bool]] = [(word, (), False)]
        single = self.single(word)
        any_known, often = False, word in self.often and not _DIGIT.search(word)
        for e in dict.fromkeys([*single, *self.nearby(word, without)]):
            result = edited(word, (e,))
            full = self.known(result, without)
            if often and full is None:
                continue  # a misread form of a word that clean pages lack is rare
            any_known = any_known or full is not None
            out.append((full or result, (e,), full is not None))
        if not any_known and 4 < len(word) <= self.longest + 2:
            v, plain, seen = self.vocabulary, self.plain, set()
            for e in single:
                half = edited(word, (e,))
                for i, n, y in self.single(half):
                    if i >= e[0] and ((result := half[:i] + y + half[i + n :]) in v or result in plain) and result != word and result not in seen:
                        seen.add(result)
                        if (full := self.known(result, without)) is not None:
                            out.append((full, (e, (i, n, y)), True))
        return out

    def best(self, word: str, candidates: list[tuple[str, tuple[Edit, ...], bool]], lead: float = 0.0) -> tuple[str, tuple[Edit, ...], bool]:
        """The candidate of the highest score; ``lead``: what any edit is given on top."""
        return max(candidates, key=lambda c: (self.score(word, c[1], c[0], c[2]) + (lead if c[1] else 0.0), c[0]))

    def fix(self, word: str) -> str | None:
        """The right word if ``word`` is misread, else None."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 400_000:
            self.memo.clear()
        got = self.memo[word] = self._fix(word)
        return got

    def _fix(self, word: str) -> str | None:
        v = self.vocabulary
        if word in v or len(word) < 3 or len(word) == 3 and word.isalpha() and word.isascii() or _ODD.search(word):
            return None
        result, edits, _ = self.best(word, self.candidates(word))
        if edits:
            return result if result != word else None
        if "-" in word and len(parts := word.split("-")) == 2 and all(len(p) > 2 for p in parts):
            fixed = [p if p in v else self.fix(p) for p in parts]
            if all(fixed) and fixed != parts:
                return "-".join(fixed)
        return None

    def join(self, a: str, b: str) -> str | None:
        """The word that ``a`` (before the hyphen) and ``b`` (on the next line) make; None if the hyphen is its own."""
        whole, hyphened = a + b, f"{a}-{b}"
        v = self.vocabulary
        if whole in v:
            return whole
        if hyphened in v:
            return None
        fixed = self.fix(whole)
        if fixed is not None and fixed in v:
            return fixed
        other = self.fix(hyphened)
        if other is not None and "-" in other and other in v:
            return None
        return (fixed or whole) if self.model.score("join", join_features(a, b, v)) >= self.model.score("own", join_features(a, b, v)) else None


def join_features(a: str, b: str, v: dict[str, int]) -> list[str]:
    return ["", f"a{a in v}", f"b{b in v}", f"w{a + b in v}", f"h{f'{a}-{b}' in v}", f"ab{a in v}{b in v}", "caps" if not a.isascii() else "ascii"]


def learn_confusions(vocabulary: dict[str, int], unknown: dict[str, int], least: int = 4) -> tuple[dict[str, list[str]], dict[tuple[str, str], float]]:
    """Replacements x -> y (at most two characters each; none for a loss or a gain) that turn unknown scanned words
    into frequent clean ones, and how often each is seen."""
    # Only words that are a share of all words: names that differ by chance are rare.
    frequent = max(3.0, sum(vocabulary.values()) * SHARE)
    common = {w for w, n in vocabulary.items() if n >= frequent and len(w) >= 4}
    index: dict[tuple[str, str], list[str]] = defaultdict(list)
    for w in common:
        for i in range(len(w) + 1):
            for n in (0, 1, 2):
                if i + n <= len(w):
                    index[w[:i], w[i + n :]].append(w)
    seen: dict[tuple[str, str], set[str]] = defaultdict(set)
    weight: Counter[tuple[str, str]] = Counter()
    for w, count in unknown.items():
        if len(w) < 4:
            continue
        pairs = set()
        for i in range(len(w) + 1):
            for n in (0, 1, 2):
                if i + n > len(w):
                    continue
                for v in index.get((w[:i], w[i + n :]), ()):
                    if count * 4 > vocabulary[v]:
                        continue
                    y, x = v[i : len(v) - (len(w) - i - n)], w[i : i + n]
                    if x != y and len(x) + len(y) < 4 and (not x or not y) == (abs(len(x) - len(y)) == 1 and (x in y or y in x)):
                        pairs.add((x, y))
        if 0 < len(pairs) <= 3:
            for pair in pairs:
                seen[pair].add(w)
                weight[pair] += count / len(pairs)
    total = sum(weight.values())
    out: dict[str, list[str]] = defaultdict(list)
    rates = {}
    for (x, y), n in sorted(weight.items(), key=lambda p: (-p[1], p[0])):
        # true confusions show up in many words; chance neighbours in a few
        if len(seen[x, y]) >= least and n >= max(least, total * LEAST_SHARE):
            out[x].append(y)
            rates[x, y] = n
    return dict(out), rates


def train_editor(vocabulary: dict[str, int], unknown: dict[str, int], rounds: int = 3, most: int = 1_200, seed: int = 1) -> Editor:
    """Train on clean words with planted confusions, losses and gains, on rare words that are taken out of the
    vocabulary, as they stand and with confusions, and on hyphens planted and own."""
    confusions, rates = learn_confusions(vocabulary, unknown)
    rng, model = random.Random(seed), Perceptron()
    editor = Editor(vocabulary, confusions, model, unknown)
    words = sorted(w for w in vocabulary if len(w) > 3)
    middle = sorted(map(vocabulary.__getitem__, words))[len(words) // 2] if words else 0
    rare = [w for w in words if vocabulary[w] <= middle]
    usual = [w for w in words if not any(c.isdigit() for c in w)]
    by_right: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for (x, y), n in rates.items():
        by_right[y].append((x, math.sqrt(n)))
    slips = STRAY * sum(r for some in by_right.values() for _, r in some) / max(1, len(by_right))

    def noise(word: str) -> str:
        """The word with one change: mostly a confusion of the scans, sometimes a loss or gain of any character."""
        spots = [(i, n, x, r) for i in range(len(word) + 1) for n in (0, 1, 2) if len(y := word[i : i + n]) == n for x, r in by_right.get(y, ())]
        spots += [(i, 1, "", slips) for i in range(len(word))] + [(i, 0, word[i - 1], slips) for i in range(1, len(word))]
        i, n, x, _ = rng.choices(spots, [r + 1e-9 for *_, r in spots])[0]
        return word[:i] + x + word[i + n :]

    examples: list[tuple[str, str, str | None]] = []  # as read, as it is, word that the vocabulary is to lack
    if words:
        for word in rng.choices(usual, [vocabulary[w] ** 0.5 for w in usual], k=most) if usual else ():
            examples.append((noise(word), word, None))
        for x, y in rates:  # every confusion, however seldom a word gives occasion to it
            having = [w for w in usual if y in w]
            for word in rng.choices(having, [vocabulary[w] ** 0.5 for w in having], k=max(8, most // (2 * len(rates)))) if having and y else ():
                i = rng.choice([i for i in range(len(word)) if word.startswith(y, i)])
                examples.append((word[:i] + x + word[i + len(y) :], word, None))
        for word in rng.choices(rare, k=int(most * UNKNOWN)):
            examples += [(word, word, word), (noise(word), word, word)] if rng.random() < 0.25 else [(word, word, word)]
    examples = [x for x in examples if (x[0] not in vocabulary or x[0] == x[2]) and len(x[0]) > 2 and not _ODD.search(x[0])]
    todo = [(noisy, word, some) for noisy, word, without in examples if len(some := editor.candidates(noisy, without)) > 1]
    for _ in range(rounds):
        rng.shuffle(todo)
        for noisy, word, some in todo:
            # what is to be left alone must lead by a margin
            best = editor.best(noisy, some, MARGIN if noisy == word else 0.0)
            right = [c for c in some if c[0] == word] if best[0] != word else []
            if right:
                good, bad = (editor.parts(noisy, *c) for c in (editor.best(noisy, right), best))
                model.move(good[0] + bad[1], bad[0] + good[1])
        for word in usual[: most // 4]:
            if "-" in word.strip("-"):
                a, _, b = word.partition("-")
                model.learn("own", join_features(a, b, vocabulary), ["join", "own"])
            elif len(word) > 5:
                k = rng.randrange(3, len(word) - 2)
                model.learn("join", join_features(word[:k], word[k:], vocabulary), ["join", "own"])
    model.average()
    return editor


# Furniture.


def line_key(line: str) -> str:
    """A header's letters, whatever the page: no digits, no punctuation, no chapter after a bar, lower case."""
    text = quick_fold(line).split("|")[0]
    return " ".join(w for token in text.lower().split() if (w := re.sub(r"[\W\d_]+(?![ঀ-৿])", "", token)))


def same_key(a: str, b: str) -> bool:
    if a == b:
        return bool(a)
    if not a or not b or abs(len(a) - len(b)) > 3 or min(len(a), len(b)) < 6:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= max(1, len(a) // 8)
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    m = 0
    while m < min(len(a), len(b)) - k and a[-1 - m] == b[-1 - m]:
        m += 1
    return max(len(a), len(b)) - k - m <= max(2, len(a) // 8)


class Line:
    """A non-blank line of a page and its place; what needs its text is worked out when asked for."""

    __slots__ = ("_key", "_number", "above", "below", "bottom", "no", "text", "top")

    def __init__(self, no: int, text: str, top: int, bottom: int, above: bool, below: bool):
        self.no, self.text, self.top, self.bottom, self.above, self.below = no, text, top, bottom, above, below
        self._key: str | None = None
        self._number: int | None = -1

    @property
    def number(self) -> int | None:
        """The number if the line is a page number, whatever it is dressed in."""
        if self._number == -1:
            self._number = None
            if len(self.text) < 30:
                folded = quick_fold(self.text).strip()
                if len(folded) < 24 and folded[-1:] not in ".।:;,%!?" and (m := _NUMBER.match(folded)):
                    self._number = int(m.group(1))
        return self._number

    @property
    def key(self) -> str:
        if self._key is None:
            self._key = "" if self.number is not None else line_key(self.text)
        return self._key


def page_lines(lines: list[str]) -> list[Line]:
    at = [i for i, x in enumerate(lines) if x.strip()]
    return [Line(i + 1, lines[i], k, len(at) - 1 - k, i == 0 or not lines[i - 1].strip(), i + 1 == len(lines) or not lines[i + 1].strip()) for k, i in enumerate(at)]


def run_places(lines: list[Line]) -> list[tuple[int, int]]:
    """Each line's place in its run of lines without a blank one between: from the top and from the bottom."""
    out, start = [], 0
    for k, x in enumerate(lines):
        if x.above:
            start = k
        out.append(k - start)
    end = len(lines) - 1
    below = [0] * len(lines)
    for k in range(len(lines) - 1, -1, -1):
        if lines[k].below:
            end = k
        below[k] = end - k
    return list(zip(out, below, strict=True))


def line_features(line: Line, known: dict[str, int], run: tuple[int, int] | None = None) -> list[str]:
    """``run``: the line's place in its run, where the place on the page is not known."""
    text = quick_fold(line.text).strip()
    tokens = text.lower().replace("|", " | ").split()
    digits = _DIGIT.search(text) is not None

    def shown(token: str) -> str:
        if digits and _DIGIT.search(token):
            token = _DIGITS.sub("9", token)
        return token if token in known or not token.isalpha() else "*"

    words = [shown(t) for t in tokens[:9]] or [""]
    last = words[-1] if len(tokens) < 10 else shown(tokens[-1])
    out = [f"n{min(9, len(tokens))}", f"end{text[-1:] if text[-1:] in '.!?।:;,-' else 'x'}", f"up{text.isupper()}", f"first{words[0]}", f"last{last}", f"dig{digits}", f"gap{'   ' in text}", f"short{len(text) < 50}"]
    out += ["w" + w for w in words]
    out += [f"b{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    out += [f"ab{line.above}{line.below}", f"colon{': ' in text}"]
    return out + ([f"top{min(line.top, 3)}", f"bot{min(line.bottom, 3)}"] if run is None else [f"rt{min(run[0], 3)}", f"rb{min(run[1], 3)}", "run"])


class Furniture:
    """Finds lines that belong to a page's frame."""

    def __init__(self, model: Perceptron, known: dict[str, int]):
        self.known = known
        self.lead: dict[str, float] = defaultdict(float)
        for key, w in model.weights.items():
            op, _, feature = key.partition("|")
            self.lead[feature] += w if op == "f" else -w
        self.lead = dict(self.lead)

    def likely(self, line: Line, run: tuple[int, int] | None = None) -> float:
        get = self.lead.get
        return sum(get(f, 0.0) for f in line_features(line, self.known, run))

    def of_page(self, lines: list[Line], repeated: list[str], page: int | None) -> set[int]:
        """Line numbers of the furniture of one page.  ``repeated``: keys that head several pages of the file."""
        out: set[int] = set()

        def frame(order: list[Line], top: bool) -> None:
            for line in order:
                if line.no in out:
                    continue
                plain = _PLAIN.match(quick_fold(line.text)) is not None
                if line.number is not None:
                    if not plain or page is None or -1 <= line.number - page <= 12:
                        out.add(line.no)
                        continue
                    return
                likely = self.likely(line)
                if likely > 0 or top and likely > CONTENT and any(same_key(line.key, r) for r in repeated):
                    out.add(line.no)
                    continue
                return

        frame(lines, True)
        frame(lines[::-1], False)
        return out

    def of_file(self, lines: list[Line]) -> set[int]:
        """Line numbers of the furniture in a text of several pages joined by blank lines."""
        counts = Counter(x.key for x in lines if x.above and not x.text.rstrip().endswith((".", "।", "!", "?", ",", "-")) and len(x.key) > 5)
        most = max(counts.values(), default=0)
        repeated = [k for k, n in counts.items() if n > 1 and n >= REPEATED * most]
        out: set[int] = set()
        last = 0
        runs, scores = run_places(lines), {}

        def likely(k: int) -> float:
            if k not in scores:
                scores[k] = self.likely(lines[k], runs[k])
            return scores[k]

        for k, x in enumerate(lines):
            if x.number is not None:
                plain = _PLAIN.match(quick_fold(x.text)) is not None
                # a bare number counts on with the pages and stands at a page's edge
                edge = x.below or x.above or k + 1 < len(lines) and likely(k + 1) > 0
                if edge and (not plain or x.number < 400 and (last == 0 or 0 < x.number - last <= 3)):
                    out.add(x.no)
                    last = x.number
            elif x.above and any(same_key(x.key, r) for r in repeated) and likely(k) > CONTENT:
                out.add(x.no)
            elif (x.above or x.below or k and lines[k - 1].no in out) and likely(k) > 0:
                out.add(x.no)
        return out


def train_furniture(pages: list[tuple[int, int, str]], known: dict[str, int], rounds: int = 4, seed: int = 2) -> Furniture:
    """``pages``: (file, page, text).  Headers that repeat within a file and lines outside page numbers are
    furniture; other lines are content."""
    by: dict[int, list[list[Line]]] = defaultdict(list)
    for file, page, text in pages:
        lines = page_lines(text.split("\n"))
        if lines:
            by[file].append(lines)
    examples: list[tuple[str, list[str]]] = []
    for group in by.values():
        tops = Counter(k for lines in group for k in {x.key for x in lines[:2] if x.key})
        repeated = [k for k, n in tops.items() if n >= 2 and n >= REPEATED * len(group)] if len(group) > 2 else []
        for lines in group:
            first, last, frame = 0, len(lines), []
            for x in lines[:3]:
                if x.number is None and any(same_key(x.key, r) for r in repeated):
                    frame.append(x)
                    first = x.top + 1
                    break
            # what stands under a page number belongs to the frame, too
            tail = next((x for x in lines[-3:] if x.number is not None and x.top >= first), None)
            if tail is not None:
                frame += [x for x in lines[tail.top + 1 :] if len(x.text) < 60]
                last = tail.top
            elif len(group) > 2:
                last -= 2
            runs = run_places(lines)
            for right, some in (("f", frame), ("c", [x for x in lines[first:last] if x.number is None] if len(group) > 2 else [])):
                for x in some:
                    examples += [(right, line_features(x, known)), (right, line_features(x, known, runs[x.top]))]
    model, rng = Perceptron(), random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(examples)
        for right, features in examples:
            model.learn(right, features, ["f", "c"])
    return Furniture(model.average(), known)


# Reading texts.


def fold_lines(lines: list[str]) -> list[str]:
    text = "\n".join(lines)
    if text.isascii():
        return lines
    folded = quick_fold(text).split("\n")
    return folded if len(folded) == len(lines) else [quick_fold(x) for x in lines]


class Reader:
    """Editor and furniture finder together."""

    def __init__(self, editor: Editor, furniture: Furniture):
        self.editor, self.furniture, self.memo = editor, furniture, {}

    def token(self, token: str) -> list[tuple[str, str]] | None:
        """(part, right word) of a token's misread parts; None if it has none.  Remembered."""
        if len(self.memo) > 400_000:
            self.memo.clear()
        found = []
        if "@" not in token and "www." not in token and "<<" not in token:
            for part in _INNER.split(token):
                word = clean_word(part)
                if word and (fixed := self.editor.fix(word)) is not None:
                    found.append((part, fixed))
        self.memo[token] = out = found or None
        return out

    def misread(self, line: str, skip_first: bool, skip_last: bool) -> list[tuple[str, str]]:
        """(part, right word) of the misread words of a folded line."""
        tokens = line.split()
        memo, out = self.memo, []
        last = len(tokens) - 1
        for k, token in enumerate(tokens):
            got = memo[token] if token in memo else self.token(token)
            if got is not None and not (k == 0 and skip_first or k == last and skip_last):
                out += got
        return out

    def broken(self, line: str) -> str | None:
        """The part of a word before a hyphen at a line's end."""
        if line.rstrip(" \t")[-1:] not in _HYPHENS:
            return None
        m = _HYPHEN.search(line)
        if m is None:
            return None
        part = quick_fold(m.group(1)).lower().lstrip(_PUNCT)
        return part if part and not re.search(r"[\d@<]", part) and any(c.isalpha() for c in part) else None

    @staticmethod
    def head(line: str) -> str:
        """A line's first word, if it may go on with a word of the line before."""
        token = (quick_fold(line).split() or [""])[0]
        return "" if not token or token[0].isupper() or not token[0].isalpha() or "@" in token else clean_word(_INNER.split(token)[0])

    def findings(self, lines: list[str], furniture: set[int], before: str | None = None) -> tuple[list[tuple[int, str, str]], tuple[int, str] | None]:
        """Rows (line_no, kind, item), and the part of a word with which the text ends."""
        content = [i for i, x in enumerate(lines) if x.strip() and i + 1 not in furniture]
        folded = fold_lines(lines)
        rows = [(n, "furniture", "") for n in sorted(furniture)]
        carried, open_ = False, None
        if before is not None and content and self.head(lines[content[0]]):
            carried = True
        for k, i in enumerate(content):
            part = self.broken(lines[i])
            goes_on, skip = False, part is not None
            if part is not None:
                if k + 1 == len(content):
                    open_ = (i + 1, part)
                elif head := self.head(lines[content[k + 1]]):
                    goes_on = True
                    if (word := self.editor.join(part.rpartition("-")[2] if "-" in part else part, head)) is not None:
                        rows.append((i + 1, "broken_word", f"{part.rpartition('-')[0]}-{word}" if "-" in part else word))
            rows += [(i + 1, "misread", fixed) for _, fixed in self.misread(folded[i], carried, skip)]
            carried = goes_on
        return rows, open_

    def repair(self, text: str, furniture: set[int]) -> str:
        """Continuous paragraphs: furniture gone, words joined and corrected, single line breaks opened."""
        lines = text.split("\n")
        out: list[str] = []
        paragraph: list[str] = []
        hyphen: str | None = None

        def close() -> None:
            if paragraph:
                out.append(" ".join(paragraph))
                paragraph.clear()

        for i, line in enumerate(lines):
            if i + 1 in furniture:
                continue
            if not line.strip():
                if hyphen is None:
                    close()
                continue
            tokens = line.split()
            if hyphen is not None:
                part = quick_fold(hyphen).lower().lstrip(_PUNCT)
                head = self.head(line)
                word = self.editor.join(part, head) if head else None
                tail = tokens[0][len(tokens[0].rstrip(_PUNCT)) :] if head else ""
                first = paragraph.pop() if paragraph else hyphen + "-"
                stem = re.sub(r"[-‐¬­]\s*$", "", first)
                if word is not None:
                    lead = stem[: len(stem) - len(stem.lstrip(_PUNCT))]
                    tokens[0] = lead + (word.capitalize() if stem.lstrip(_PUNCT)[:1].isupper() else word) + tail
                else:
                    tokens[0] = stem + "-" + tokens[0] if head else f"{first} {tokens[0]}"
                hyphen = None
            part = self.broken(line)
            fixes = dict(self.misread(quick_fold(" ".join(tokens)), False, part is not None))
            for k, token in enumerate(tokens) if fixes else ():
                for was, right in fixes.items():
                    if was in token:
                        core = was.strip(_PUNCT)
                        tokens[k] = token.replace(core, right.capitalize() if core[:1].isupper() else right)
            if part is not None:
                m = _HYPHEN.search(line)
                hyphen = m.group(1)
            paragraph += tokens
        close()
        return "\n\n".join(out)


# Spark.


def word_counts(df: DataFrame, text_col: str, clean: str) -> DataFrame:
    """(word, clean, scan): counts of all words of all texts; ``clean`` is a condition that tells clean texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tokens are counted as they stand, which is quick; only distinct ones are folded.
        raw: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for tokens, folded in zip(raw, counts, strict=True):
                for token, n in tokens.items():
                    for word in words_of(quick_fold(token)):
                        folded[word] += n
                tokens.clear()
            words = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "clean", "scan"])

        for batch in batches:
            for part in slices(batch, "_text"):
                for text, is_clean in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw[0 if is_clean else 1].update(unbroken(text).split())
                if len(raw[0]) + len(raw[1]) > 200_000:
                    yield flush()
        yield flush()

    rows = df.where(df[text_col].isNotNull()).select(df[text_col].alias("_text"), F.expr(clean).alias("_clean"))
    return rows.mapInArrow(run, "word string, clean long, scan long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))


def fit(pages: DataFrame, most_words: int = MOST_WORDS, most_unknown: int = MOST_UNKNOWN, train_pages: int = TRAIN_PAGES) -> Reader:
    """Train a reader on ``pages`` (file_id, page, text, engine): the words of all pages are counted; at most the
    most frequent ``most_words`` clean and ``most_unknown`` other words, and ``train_pages`` pages, are collected."""
    counts = checkpoint(word_counts(pages, "text", "coalesce(engine, '') = 'pdfjs-dist'"))
    vocabulary = {r[0]: r[1] for r in counts.where("clean > 0").orderBy(F.desc("clean"), "word").limit(most_words).select("word", "clean").collect()}
    unknown = {r[0]: r[1] for r in counts.where("clean = 0 and scan > 0").orderBy(F.desc("scan"), "word").limit(most_unknown).select("word", "scan").collect()}
    scans = pages.where("text is not null and coalesce(engine, '') != 'pdfjs-dist' and file_id is not null")
    n = scans.count()
    share = max(1, n // max(1, train_pages))
    order = F.xxhash64("file_id"), "file_id", "page", "text"  # whole files, the same whatever the order of rows
    sample = scans.where(F.pmod(F.xxhash64("file_id"), F.lit(share)) == 0).select("file_id", "page", "text").orderBy(*order).limit(2 * train_pages).collect()
    known = {w: 1 for w, c in vocabulary.items() if c >= 5} | {w: 1 for w, c in unknown.items() if c >= max(8, n // 1000)}
    return Reader(train_editor(vocabulary, unknown), train_furniture([tuple(r) for r in sample], known))


_READERS: dict[int, Reader] = {}


def _mapped(df: DataFrame, shared, one, schema: str, column: str | None = "_text") -> DataFrame:
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _READERS.get(key)
        if reader is None:
            _READERS.clear()
            reader = _READERS[key] = shared.value
        for batch in batches:
            for part in slices(batch, column) if column else (batch,):
                yield one(reader, part)

    return df.mapInArrow(run, schema)


_FOUND = "record_table string, record_id long, line_no long, kind string, item string"


def _found(name: str, rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
    rows = list(dict.fromkeys(rows))
    ids, nos, kinds, items = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(kinds, pa.string()), pa.array(items, pa.string())], names=["record_table", "record_id", "line_no", "kind", "item"])


def edges(furniture: Furniture, lines: list[str], at: list[int]) -> tuple[list[int], list[int]]:
    """The lines at the top and at the bottom of a page that may be furniture, each with the first that cannot: it has
    no page number, and not even repeated would it be a header.  ``at``: places of the lines that are not blank."""

    def run(order: list[int]) -> list[int]:
        out = []
        for k in order:
            out.append(k)
            i = at[k]
            line = Line(i + 1, lines[i], k, len(at) - 1 - k, k == 0 or at[k - 1] != i - 1, k + 1 == len(at) or at[k + 1] != i + 1)
            if line.number is None and furniture.likely(line) <= CONTENT:
                break
        return out

    top = run(list(range(len(at))))
    bottom = run([k for k in range(len(at) - 1, -1, -1) if k >= len(top)])[::-1]
    return [at[k] for k in top], [at[k] for k in bottom]


def found_texts(df: DataFrame, shared, id_col: str, text_col: str, record_table: str, joined_pages: bool) -> DataFrame:
    """Findings in records that stand alone; ``joined_pages``: a text holds the pages of a file, one after another."""

    def one(reader: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            lines = text.split("\n")
            furniture = reader.furniture.of_file(page_lines(lines)) if joined_pages else set()
            rows, _ = reader.findings(lines, furniture)
            out += [(i, *row) for row in rows]
        return _found(record_table, out)

    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text")).where("_id is not null and _text is not null and _text != ''")
    return _mapped(rows, shared, one, _FOUND)


def settled_pages(pages: DataFrame, shared) -> DataFrame:
    """A short row for each scanned page of files (page_id, file_id, page, text): its furniture and findings, the open
    word with which it ends, and its first word, should that go on with one of the page before."""
    tops = F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), 1, 2)
    scans = pages.where("text is not null and text != '' and page_id is not null and coalesce(engine, '') != 'pdfjs-dist'")

    def keys(_: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        files, out = [], []
        for file, lines in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for key in {k for x in lines if not _NUMBER.match(quick_fold(x).strip()) and len(k := line_key(x)) > 5}:
                files.append(file)
                out.append(key)
        return pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(out, pa.string())], names=["file_id", "key"])

    heads = _mapped(scans.where("file_id is not null").select(F.col("file_id").cast("long"), tops.alias("tops")), shared, keys, "file_id long, key string", None)
    sizes = scans.where("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.count("*").alias("pages"))
    counted = heads.groupBy("file_id", "key").count().where("count > 1").join(sizes.hint("merge"), "file_id").where(F.col("count") >= F.lit(REPEATED) * F.col("pages"))
    repeated = counted.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("count"), "key"))).alias("k"))  # two lines a page, half the pages: at most four
    repeated = repeated.select(F.col("file_id").alias("_file"), F.col("k.key").alias("_repeated"))

    schema = "page_id long, file_id long, page int, top array<string>, bottom array<string>, nos array<int>, n_lines int, rows array<struct<line_no:int,kind:string,item:string,next:int>>, tails array<struct<line_no:int,part:string>>, heads array<struct<line_no:int,head:string,token:string>>"

    def read(reader: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        """Short rows: what each line would say if it were content, and the lines that may be furniture."""
        columns: list[list] = [[] for _ in range(10)]
        for page_id, file, page, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
            lines = text.split("\n")
            folded = fold_lines(lines)
            at = [i for i, x in enumerate(lines) if x.strip()]
            rows = []
            carried = False
            for k, i in enumerate(at):
                piece, goes_on = reader.broken(lines[i]), False
                if piece is not None and k + 1 < len(at) and (head := reader.head(lines[at[k + 1]])):
                    goes_on = True
                    if (word := reader.editor.join(piece.rpartition("-")[2] if "-" in piece else piece, head)) is not None:
                        rows.append((i + 1, "broken_word", f"{piece.rpartition('-')[0]}-{word}" if "-" in piece else word, at[k + 1] + 1))
                # next is -1 for a line's first word, which may be the rest of a word on the page before
                rows += [(i + 1, "misread", fixed, -1 if folded[i].lstrip().startswith(token) else 0) for token, fixed in reader.misread(folded[i], carried, piece is not None)]
                carried = goes_on
            near = edges(reader.furniture, lines, at)
            for column, value in zip(columns, (page_id, file, page, [lines[i] for i in near[0]], [lines[i] for i in near[1]], [i + 1 for g in near for i in g], len(at), [dict(zip(("line_no", "kind", "item", "next"), r, strict=True)) for r in rows], [{"line_no": i + 1, "part": p} for i in dict.fromkeys([*near[0], *at[-1 - len(near[1]) :]]) if (p := reader.broken(lines[i])) is not None], [{"line_no": i + 1, "head": reader.head(lines[i]), "token": lines[i].split()[0]} for i in dict.fromkeys([*at[: 1 + len(near[0])], *near[1]])]), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("item", pa.string()), ("next", pa.int32())])), pa.list_(pa.struct([("line_no", pa.int32()), ("part", pa.string())])), pa.list_(pa.struct([("line_no", pa.int32()), ("head", pa.string()), ("token", pa.string())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "file_id", "page", "top", "bottom", "nos", "n_lines", "rows", "tails", "heads"])

    short = _mapped(scans.select(F.col("page_id").cast("long"), F.col("file_id").cast("long"), F.col("page").cast("int"), F.col("text").alias("_text")), shared, read, schema)
    joined = short.join(repeated.hint("merge"), F.col("file_id") == F.col("_file"), "left").drop("_file")

    def settle(reader: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        """Furniture of each page, the findings outside it, and the page's open last and first words."""
        out: list[list] = [[] for _ in range(8)]
        for row in part.to_pylist():
            texts = [*row["top"], *row["bottom"]]
            lines, n = [], row["n_lines"]
            for k, (no, text) in enumerate(zip(row["nos"], texts, strict=True)):
                top = k if k < len(row["top"]) else n - len(texts) + k
                above = k == 0 or row["nos"][k - 1] != no - 1
                below = k + 1 == len(texts) or row["nos"][k + 1] != no + 1
                lines.append(Line(no, text, top, n - 1 - top, above, below))
            furniture = reader.furniture.of_page(lines, row["_repeated"] or [], row["page"])
            found = [(no, "furniture", "") for no in sorted(furniture)]
            first = min((x.no for x in lines if x.no not in furniture), default=0)
            maybe = next((r for r in row["rows"] if r["line_no"] == first and r["next"] == -1), None)
            found += [(r["line_no"], r["kind"], r["item"]) for r in row["rows"] if r["line_no"] not in furniture and r is not maybe and not (r["kind"] == "broken_word" and r["next"] in furniture)]
            last = max((x.no for x in lines if x.no not in furniture), default=0)
            tail = next((t for t in row["tails"] if t["line_no"] == last), None)
            head, token = next(((h["head"], h["token"]) for h in row["heads"] if h["line_no"] == first), ("", ""))
            for column, value in zip(out, (row["page_id"], row["file_id"], row["page"], [{"line_no": a, "kind": b, "item": c} for a, b, c in dict.fromkeys(found)], tail, head, maybe and {"line_no": maybe["line_no"], "item": maybe["item"]}, token), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("item", pa.string())])), pa.struct([("line_no", pa.int32()), ("part", pa.string())]), pa.string(), pa.struct([("line_no", pa.int32()), ("item", pa.string())]), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["page_id", "file_id", "page", "found", "tail", "head", "maybe", "token"])

    return checkpoint(_mapped(joined, shared, settle, "page_id long, file_id long, page int, found array<struct<line_no:int,kind:string,item:string>>, tail struct<line_no:int,part:string>, head string, maybe struct<line_no:int,item:string>, token string", None))


def found_pages(pages: DataFrame, shared) -> DataFrame:
    """Findings in the scanned pages of files (page_id, file_id, page, text)."""
    settled = settled_pages(pages, shared)
    inside = settled.select(F.lit("pdf_pages").alias("record_table"), F.col("page_id").alias("record_id"), F.explode("found").alias("f")).select("record_table", "record_id", F.col("f.line_no").cast("long").alias("line_no"), "f.kind", "f.item")

    nexts = settled.where("file_id is not null and head != ''").groupBy("file_id", "page").agg(F.min_by("head", "page_id").alias("head")).select("file_id", (F.col("page") - 1).alias("page"), "head")
    over = settled.where("tail is not null").select("page_id", "file_id", "page", "tail").join(nexts.hint("merge"), ["file_id", "page"]).select("page_id", "tail.line_no", "tail.part", "head")

    def across(reader: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, no, piece, head in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
            if (word := reader.editor.join(piece.rpartition("-")[2] if "-" in piece else piece, head)) is not None:
                rows.append((i, no, "broken_word", f"{piece.rpartition('-')[0]}-{word}" if "-" in piece else word))
        return _found("pdf_pages", rows)

    # A misread first word counts unless the page before ends with an open word.
    opened = settled.where("tail is not null and file_id is not null").select("file_id", (F.col("page") + 1).alias("page")).distinct()
    firsts = settled.where("maybe is not null").join(opened.hint("merge"), ["file_id", "page"], "left_anti")
    first = firsts.select(F.lit("pdf_pages").alias("record_table"), F.col("page_id").alias("record_id"), F.col("maybe.line_no").cast("long").alias("line_no"), F.lit("misread").alias("kind"), F.col("maybe.item").alias("item"))
    inside = inside.unionByName(first).distinct()
    return inside.unionByName(_mapped(over, shared, across, _FOUND, None))


def found(pages: DataFrame, rasters: DataFrame, images: DataFrame, reader: Reader | None = None) -> DataFrame:
    """(record_table, record_id, line_no, kind, item): furniture lines, words broken over lines, misread words.

    Lines are counted from 1, blank ones too.  Of ``pages`` only scans count (engine not ``pdfjs-dist``).  Null
    and empty texts give no row; pages without a file stand alone.  Rows are distinct within a record.
    """
    reader = reader or fit(pages)
    shared = pages.sparkSession.sparkContext.broadcast(reader)
    every = found_pages(pages, shared).unionByName(found_texts(rasters, shared, "file_id", "text", "raster_results", True))
    return every.unionByName(found_texts(images, shared, "image_id", "text_in_image", "image_intents", False))


def repaired(df: DataFrame, reader: Reader, id_col: str, text_col: str, joined_pages: bool = True) -> DataFrame:
    """(id, text): each text as continuous readable paragraphs; null stays null, empty stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(reader)

    def one(reader: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [reader.repair(t, reader.furniture.of_file(page_lines(t.split("\n"))) if joined_pages else set()) if t else t for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return _mapped(df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text")), shared, one, f"{id_col} long, text string")


def repaired_pages(pages: DataFrame, reader: Reader) -> DataFrame:
    """(id, text): each scanned page of ``pages`` as continuous paragraphs, without the furniture its file shows; a
    word broken over pages is whole on the page where it begins and gone from the next.  Null and empty texts stay."""
    shared = pages.sparkSession.sparkContext.broadcast(reader)
    settled = settled_pages(pages, shared)
    furniture = F.transform(F.filter("found", lambda x: x.kind == "furniture"), lambda x: x.line_no)
    own = settled.select("page_id", "file_id", "page", furniture.alias("_furniture"), F.col("tail").isNotNull().alias("_open"), (F.col("head") != "").alias("_goes_on"))
    nexts = settled.where("file_id is not null and head != ''").groupBy("file_id", "page").agg(F.min_by("token", "page_id").alias("_next")).select("file_id", (F.col("page") - 1).alias("page"), "_next")
    opened = settled.where("tail is not null and file_id is not null").select("file_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("_opened")).distinct()
    own = own.join(nexts.hint("merge"), ["file_id", "page"], "left").join(opened.hint("merge"), ["file_id", "page"], "left")
    short = own.select(F.col("page_id").alias("_page"), "_furniture", F.when(F.col("_open"), F.col("_next")).alias("_next"), (F.col("_goes_on") & F.coalesce("_opened", F.lit(False))).alias("_cut"))
    texts = pages.where("coalesce(engine, '') != 'pdfjs-dist'").select(F.col("page_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    # The texts meet their short rows by id here; what follows leaves them in place.
    rows = checkpoint(texts.join(short.hint("merge"), F.col("_id") == F.col("_page"), "left").drop("_page"))

    def one(reader: Reader, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, furniture, following, cut in zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True):
            if text:
                nos = set(furniture or ())
                if cut:
                    lines = text.split("\n")
                    first = next(i for i, x in enumerate(lines) if x.strip() and i + 1 not in nos)
                    lines[first] = lines[first].lstrip()[len(lines[first].split()[0]) :]
                    text = "\n".join(lines)
                text = reader.repair(f"{text}\n{following}" if following else text, nos)
            texts.append(text)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return _mapped(rows, shared, one, "page_id long, text string")
