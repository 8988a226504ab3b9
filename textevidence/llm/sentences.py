"""Sentence units across languages and scripts (problem 3).

A hidden-event n-gram model: between two words stands either nothing or a boundary token.  The words of a text are
read as a sequence of bigrams (word before with its marks, word after); the model knows how often a boundary token
follows a word and its marks, which words follow the token, and which words follow each other without it.  All
three back off: from the word to its shape with its marks, to the marks, to any gap; from a pair of words to the
first one with the other's shape, to shapes.  Marks have no weights of their own: what a full stop or a danda after
a word is worth is counted.

Spark counts the bigrams of all whole texts and of all clean sentences, line ends included.  A line end is a boundary token that shows; the
hidden ones are found by expectation-maximisation over the counts, which starts from how often a word with its
marks stands at a line's end for each time it stands inside a line (abbreviations seldom do).  At run time every
gap of a line takes part, with marks or without, and its posterior comes from a forward-backward pass in which a
token right after another has the odds that one-word units have in the corpus.

Given, not learned, is what the units are by definition: line breaks (in wrapped texts blank lines) and the spaces
of Thai end a unit, so does an ellipsis that no lower case follows, and a gap inside a quotation or a bracket does
not.

All counts take part with their words, however many there are.  If they are few, the model is searched for on the driver
and broadcast.  Else the same search runs in Spark over the table of counts and gives the log-odds of each
bigram; those of the most frequent ones are broadcast, and lines that hold others meet them in a join.  Texts stay in their
partition; only counts and such lines are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .lookfold import quick_fold

#: Most bigrams, and most ends and starts of lines, that the driver collects.  If there are more, Spark trains the model, and
#: PAIRS is the number of bigrams whose log-odds are broadcast, the most frequent ones; the others' are joined.
PAIRS, WORDS = 150_000, 50_000

#: Rounds of expectation-maximisation; the weight of the next shorter history in what follows a word (words that
#: follow have as much weight as they were once new there).
ROUNDS, PRIOR = 4, 3.0

#: Most units that are taken to end inside lines for each that ends one, where the search starts.
MOST_INSIDE = 5.0

#: How much more often two words meet at a boundary than in a corpus whose languages were all mixed.
APART = 30.0

#: Share of a shape's gaps whose posteriors may err: so much weight have all gaps in what follows it without a token.
NOISE = 0.05

#: Log-odds below which a gap's neighbours need not know of it.
FAINT = -12.0

#: Scripts of shapes: a sentence is followed by one of its own script, but for a share of SWITCH.
SCRIPTS, SWITCH = {"upper": "cased", "caps": "cased", "lower": "cased", "bare": "bare", "dense": "dense"}, 0.1

#: Log-odds of what is given: a space between Thai words ends a unit; so does an ellipsis unless lower case goes on,
#: for lines hardly ever end in one, and then no count tells.
GIVEN = 40.0

#: Stands for the log-odds of a gap that have to be joined.
UNKNOWN = math.inf

Bigram = tuple[str, str, str, str, int]

_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]} | {0xFF61: "。", 0x3002: "。", 0x066B: ".", 0x06D4: "."}
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︎️﻿"
_HIDE = {ord(c): None for c in _INVISIBLE}
_I = f"[{_INVISIBLE}]*"
_ENDS = ".?!।॥。؟…۔"
_CLOSERS = "\"'”’»)\\]}」』）›"
_MARK = re.compile(rf"[{_ENDS}](?:{_I}[{_ENDS}])*")
_CLOSE = re.compile(rf"(?:{_I}[{_CLOSERS}])+(?=[\s{_INVISIBLE}]|[^\w{_CLOSERS}]|\Z|[^\x00-˿])")
_THAI = re.compile("[ก-๛]")
_QUOTED = re.compile(r"“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»|「[^「」\n]+」|『[^『』\n]+』|\([^()\n]+\)|（[^（）\n]+）|(?<![^\s(\[])\"[^\"\n]+\"(?!\w)|(?<![^\s(\[])'[^'\n]+[^\s']'(?!\w)")
_OPEN = re.compile("[“„«「『(（\"']")
_OPENERS = "([{“‘«\"'„「『（¿¡‹"
_TRAIL = _ENDS + _CLOSERS + "“‘,;:—–-、，；：؛،*_"
_DIGIT = re.compile(r"\d")
_DENSE = re.compile("[぀-ヿ㐀-鿿가-힣]")
_KINDS = {**{c: "q" for c in "\"'”’»」』›“‘"}, **{c: "b" for c in ")]}）"}}
_ELLIPSIS = re.compile(r"\t.*(?:\.\.|…)[^~]*$")
_JOINED = "\0"  # ends a piece that no space parts from the next


_ANY_WIDE = re.compile("[" + "".join(map(chr, _WIDE)) + "]")


def narrow(text: str) -> str:
    """The text with wide marks, letters and spaces in their usual width, character for character."""
    return text.translate(_WIDE) if not text.isascii() and _ANY_WIDE.search(text) else text


def pieces(token: str) -> list[str]:
    """A token, cut behind the marks inside it; addresses stay whole."""
    if "@" in token or "://" in token or "www." in token:
        return [token]
    out, at = [], 0
    for m in _MARK.finditer(token):
        end = c.end() if (c := _CLOSE.match(token, m.end())) else m.end()
        if end > at and any(x.isalnum() for x in token[end:]):
            out.append(token[at:end] + _JOINED)
            at = end
    out.append(token[at:])
    return out


def tokens(line: str) -> list[str]:
    """The pieces of a line."""
    out = line.split()
    if _INSIDE.search(line):
        return [x for token in out for x in (pieces(token) if _INSIDE.search(token) else (token,))]
    return out


_INSIDE = re.compile(rf"[{_ENDS}][^\s{_ENDS}]")


def places(line: str, own: list[str]) -> list[int]:
    """Where each piece of a line ends."""
    out, at = [], 0
    for piece in own:
        size = len(piece) - piece.endswith(_JOINED)
        at = line.index(piece[:size], at) + size
        out.append(at)
    return out


def outside(line: str, own: list[str]) -> list[bool] | None:
    """Of each gap between the pieces of a line whether it is outside quotations and brackets; None if all are."""
    quoted = [m.span() for m in _QUOTED.finditer(line)] if _OPEN.search(line) else []
    if not quoted:
        return None
    out, k = [], 0
    for end in places(line, own)[:-1]:
        while k < len(quoted) and quoted[k][1] <= end:
            k += 1
        out.append(not (k < len(quoted) and quoted[k][0] < end))
    return out


def _case(word: str) -> str:
    c = word[:1]
    if c.isalpha():
        return ("caps" if word.isupper() and len(word) > 2 else "upper") if c.isupper() else "lower" if c.islower() else "dense" if _DENSE.match(c) else "bare"
    return "digit" if c.isdigit() else "none" if not c else "mark"


def keys(piece: str) -> tuple[str, str, str, str]:
    """(word and marks as a history, its shape and marks, word as what follows, its shape)."""
    joined = piece.endswith(_JOINED)
    text = piece[:-1] if joined else piece
    text = quick_fold(text) if not text.isascii() else text
    body = text.rstrip(_TRAIL)
    marks = "".join(_KINDS.get(c, c) for c in text[len(body) :])[-3:] + ("~" if joined else "")
    word = body.lstrip(_OPENERS)
    case = _case(word)
    left = right = _DIGIT.sub("9", word)
    shape, size = case, len(left)
    if _DENSE.search(word[-1:]):  # no spaces part the words: the last and the first characters stand for them
        left, shape = word[-2:], "dense"
    elif case in ("upper", "caps", "lower", "bare"):
        shape = f"{case}{'.' if '.' in left else ''}{1 if size < 2 else 3 if size < 4 else 5 if size < 6 else 9}"
    if case == "dense":
        right = word[:2]
    return f"{left}\t{marks}", f"{shape}\t{marks}", right, case


def _mark(shape: str) -> str:
    return shape.partition("\t")[2]


def _ends(marks: str) -> bool:
    return any(c in _ENDS for c in marks)


def _at_starts(shapes: Iterable[str], cases: Iterable[str], start_case: np.ndarray) -> np.ndarray:
    """Of each shape how likely a sentence behind it starts with a word of each case."""
    script = np.array([SCRIPTS.get(x.partition("\t")[0].rstrip(".1359"), "") for x in shapes])
    own = np.array([[not g or g == SCRIPTS.get(y, g) for y in cases] for g in script]).reshape(len(script), len(start_case))
    weight = (start_case + 0.5) * own
    return (1 - SWITCH) * weight / np.maximum(weight.sum(1, keepdims=True), 1e-9) + SWITCH * (start_case + 0.5) / (start_case.sum() + 0.5 * len(start_case))


def _back_off(mark: np.ndarray, nm: int, s_shape: np.ndarray, n_shape: np.ndarray, shape_case: np.ndarray) -> tuple:
    """(p_any, p_mark, p_shape, o_case, p_case, p_shape_case) from the tokens and gaps behind each shape and the words that
    follow it without a token."""
    s_mark, n_mark = np.bincount(mark, s_shape, nm), np.bincount(mark, n_shape, nm)
    p_any = (s_mark.sum() + 0.5) / (n_mark.sum() + 1.0)
    p_mark = (s_mark + PRIOR * p_any) / (n_mark + PRIOR)
    p_shape = (s_shape + PRIOR * p_mark[mark]) / (n_shape + PRIOR)
    o_case = shape_case.sum(0)
    p_case = (o_case + 0.5) / (o_case.sum() + 0.5 * len(o_case))
    lax = (PRIOR + NOISE * n_shape)[:, None]
    return p_any, p_mark, p_shape, o_case, p_case, (shape_case + lax * p_case) / (shape_case.sum(1, keepdims=True) + lax)


def _short(singles: float, starts: float, p_any: float) -> float:
    """Log-odds of a token right after another, against those of any gap."""
    alone = (singles + 0.5) / (starts + 1.0)
    return math.log(alone / (1 - alone)) - math.log(p_any / (1 - p_any)) if 0 < alone < 1 else 0.0


class Model:
    """A hidden-event bigram model; ``odds`` gives a gap's log-odds of a boundary token before its neighbours are seen."""

    def __init__(self, rows: Iterable[Bigram] = (), clean: Iterable[Bigram] = (), rounds: int = ROUNDS):
        """``rows``: (history, its shape, what follows, its shape, n); a line's start or end has an empty shape, and a
        line of one word is a row of two empty shapes.  ``clean``: rows of clean sentences, read one after another: a
        token stands between any two, and none hides inside."""
        rows, clean = [r for r in rows if r[4] > 0], [r for r in clean if r[4] > 0]
        singles = sum(r[4] for r in [*rows, *clean] if not r[1] and not r[3])
        lefts: dict[tuple[str, str], int] = {}
        rights: dict[tuple[str, str], int] = {}
        for a, x, b, y, _ in [*rows, *clean]:
            if x:
                lefts.setdefault((a, x), len(lefts))
            if y:
                rights.setdefault((b, y), len(rights))
        inner = [r for r in rows if r[1] and r[3]]
        sure = [r for r in clean if r[1] and r[3]]
        self.ready = bool(inner or sure)
        if not self.ready:
            return
        self.shapes = {x: i for i, x in enumerate(dict.fromkeys(x for _, x in lefts))}
        self.marks = {m: i for i, m in enumerate(dict.fromkeys(map(_mark, self.shapes)))}
        self.cases = {y: i for i, y in enumerate(dict.fromkeys(y for _, y in rights))}
        shape = np.array([self.shapes[x] for _, x in lefts], np.int64)
        mark = np.array([self.marks[_mark(x)] for x in self.shapes], np.int64)
        case = np.array([self.cases[y] for _, y in rights], np.int64)
        nl, nr, ns, nm, nc = len(lefts), len(rights), len(self.shapes), len(self.marks), len(self.cases)
        at_end, at_start, follows = np.zeros(nl), np.zeros(nr), np.zeros(nl)
        for k, (a, x, b, y, n) in enumerate([*rows, *clean]):
            if x and not y:
                at_end[lefts[a, x]] += n
                follows[lefts[a, x]] += n * (k >= len(rows))
            elif y and not x:
                at_start[rights[b, y]] += n
        ai, bi = (np.array([of[r[k], r[k + 1]] for r in [*inner, *sure]], np.int64) for k, of in ((0, lefts), (2, rights)))
        n = np.array([r[4] for r in [*inner, *sure]], np.float64)
        hides = np.arange(len(n)) < len(inner)

        def total(of: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
            return np.bincount(of, weight, size)

        inside = total(ai, n * hides, nl)
        start_case = total(case, at_start, nc)
        size = total(bi, n, nr) + at_start
        self.in_case = total(case, size, nc)
        q = (size + 1.0) / (self.in_case[case] + nr + 1.0)
        # The start: a line's end shows how often a boundary token follows a word and its marks.
        marked = np.array([_ends(m) for m in self.marks], bool)[mark][shape]
        loose = np.array([m.endswith("~") for m in self.marks], bool)[mark][shape]
        ends = at_end.copy()
        for (a, x), i in lefts.items():
            if loose[i]:
                j = lefts.get((a[:-1], x[:-1]))
                ends[i] = at_end[j] if j is not None else 0.0
        spaced = marked & ~loose
        ratio = min(MOST_INSIDE, inside[spaced].sum() / max(1.0, at_end[spaced].sum()))
        seen = np.where(marked, np.minimum(inside, ratio * ends), 0.0)
        by_shape = total(shape, seen, ns) / np.maximum(total(shape, inside, ns), 1e-9)
        before = np.clip((seen + PRIOR * by_shape[shape]) / (inside + PRIOR), 0.02, 0.98)
        # and the starts of lines how often one stands before a word that follows an end mark
        behind = total(bi, n * hides * marked[ai], nr)
        share = min(MOST_INSIDE, inside[marked].sum() / max(1.0, at_start.sum()))
        begun = np.minimum(behind, share * at_start)
        of_case = (total(case, begun, nc) + 1.0) / (total(case, behind, nc) + 2.0)
        after = np.clip((begun + PRIOR * of_case[case]) / (behind + PRIOR), 0.02, 0.98)
        both = before[ai] * after[bi]
        post = np.where(hides & (by_shape > 0)[shape][ai], both / (both + (1 - before[ai]) * (1 - after[bi])), 0.0)
        # Without an end mark: pairs of a word that ends lines and one that starts them, if they stand together no more
        # often than any two lines would.  The pair's own counts can't tell a token from none, so these stay as they are.
        bare = hides & ~marked[ai] & (at_end[ai] > 0) & (at_start[bi] > 0)
        if bare.any():
            by_chance = at_end[ai[bare]] * at_start[bi[bare]] / max(1.0, at_end[~marked].sum()) / max(1.0, at_start.sum())
            post[bare] = np.minimum(0.95, APART * at_end[~marked].sum() * by_chance / n[bare])
        # What follows a boundary token is known from the starts of lines; hidden tokens would only confirm themselves.
        p_start_case = _at_starts(self.shapes, self.cases, start_case)
        new_start = total(case, (at_start > 0) + 0.0, nc) + 1.0  # how many words were once new there: the weight of words not seen
        p_start = (at_start + new_start[case] * q) / (start_case[case] + new_start[case])
        new_right = total(case, (total(bi, n, nr) > 0) + 0.0, nc) + 1.0
        new_pair = total(ai * nc + case[bi], np.ones(len(n)), nl * nc).reshape(nl, nc) + 1.0
        for _ in range(rounds):
            yes, no = n * post, n * (1 - post)
            every, s_left = total(ai, n, nl) + follows, total(ai, yes, nl) + follows
            shape_case = total(shape[ai] * nc + case[bi], no, ns * nc).reshape(ns, nc)
            p_any, p_mark, p_shape, o_case, p_case, p_shape_case = _back_off(mark, nm, total(shape, s_left, ns), total(shape, every, ns), shape_case)
            p_left = (s_left + PRIOR * p_shape[shape]) / (every + PRIOR)
            p_right = (total(bi, no, nr) + new_right[case] * q) / (o_case[case] + new_right[case])
            left_case = total(ai * nc + case[bi], no, nl * nc).reshape(nl, nc)
            p_left_case = (left_case + PRIOR * p_shape_case[shape]) / (left_case.sum(1, keepdims=True) + PRIOR)
            p_pair = p_left_case[ai, case[bi]] * (no + new_pair[ai, case[bi]] * p_right[bi]) / (left_case[ai, case[bi]] + new_pair[ai, case[bi]])
            # Behind an end mark what follows depends on the shape of the word before: of a word after which nearly all
            # gaps hold a token, what is left without one is what the search left over.
            p_pair = np.where(marked[ai], p_shape_case[shape[ai], case[bi]] * p_right[bi], p_pair)
            p = p_left[ai]
            post = np.where(bare, post, np.where(hides, 1.0 / (1.0 + (1 - p) * p_pair / np.maximum(p * p_start_case[shape[ai], case[bi]] * p_start[bi], 1e-300)), 0.0))
        self.nr = nr
        self.p_shape, self.p_mark, self.p_any = p_shape.tolist(), p_mark.tolist(), float(p_any)
        self.new_start, self.new_right, self.starts = new_start.tolist(), new_right.tolist(), float(start_case.sum())
        self.start_case, self.p_start_case, self.o_case, self.p_case = start_case.tolist(), p_start_case.tolist(), o_case.tolist(), p_case.tolist()
        self.p_shape_case = p_shape_case.tolist()
        self.left = {k: (float(p_left[i]), left_case[i].astype(np.float32), new_pair[i].astype(np.float32)) for k, i in lefts.items() if k[0]}
        self.right = {k: (float(at_start[i]), float(q[i]), float(p_right[i])) for k, i in rights.items() if k[0]}
        pairs: Counter = Counter()
        for i in np.flatnonzero((no > 0.01) & ~marked[ai]).tolist():
            a, _, b, _, _ = inner[i] if i < len(inner) else sure[i - len(inner)]
            pairs[a, b] += float(no[i])
        self.pairs = dict(pairs)
        self.short = _short(singles, at_start.sum(), self.p_any)

    short = 0.0
    known: dict[str, float] | None = None
    rest: DataFrame | None = None

    def odds(self, a: str, x: str, b: str, y: str) -> float:
        if not self.ready:
            return -1.0
        i, k, own, next_ = self.shapes.get(x), self.cases.get(y), self.left.get((a, x)), self.right.get((b, y))
        if own is not None:
            p = own[0]
        else:
            m = self.marks.get(_mark(x))
            p = self.p_shape[i] if i is not None else self.p_mark[m] if m is not None else self.p_any
        if k is None:
            return math.log(p / (1 - p))
        starts, q, right = next_ or (0.0, 1.0 / (self.in_case[k] + self.nr + 1.0), None)
        start = (self.p_start_case[i][k] if i is not None else self.start_case[k] / max(1.0, self.starts)) * (starts + self.new_start[k] * q) / (self.start_case[k] + self.new_start[k])
        if right is None:
            right = self.new_right[k] * q / (self.o_case[k] + self.new_right[k])
        case = self.p_shape_case[i][k] if i is not None else self.p_case[k]
        if own is not None and not _ends(_mark(x)):
            here, new = float(own[1][k]), float(own[2][k])
            case = (here + PRIOR * case) / (float(own[1].sum()) + PRIOR)
            right = (self.pairs.get((a, b), 0.0) + new * right) / (here + new)
        return math.log(max(p * start, 1e-300)) - math.log(max((1 - p) * case * right, 1e-300))


def _name(a: str, b: str) -> str:
    """The name of a bigram; no piece has a line break."""
    return f"{a}\n{b}"


class Whole(Model):
    """A model that Spark has trained, of any size.  ``known``: log-odds of the most frequent bigrams by their names; ``rest``:
    (gap, odds) of all others that the texts hold, if any.  Gaps of other texts have the log-odds of their shapes."""

    def __init__(self, every: DataFrame, pairs: int = PAIRS, rounds: int = ROUNDS):
        """``every``: the table of fit; the formulas are those of Model."""
        spark, c, sums = every.sparkSession, F.col, F.sum
        self.ready, self.left, self.right, self.pairs = True, {}, {}, {}
        # What is counted by shapes is small.
        kinds = sorted(tuple(r) for r in every.groupBy("x", "y").agg(sums("n"), sums("m")).collect())
        self.shapes = {x: i for i, x in enumerate(dict.fromkeys(x for x, _, n, m in kinds if x and n + m))}
        self.marks = {m: i for i, m in enumerate(dict.fromkeys(map(_mark, self.shapes)))}
        self.cases = {y: i for i, y in enumerate(sorted({y for _, y, n, m in kinds if y and n + m}))}
        ns, nm, nc = len(self.shapes), len(self.marks), len(self.cases)
        mark = np.array([self.marks[_mark(x)] for x in self.shapes], np.int64)
        inner = [(x, y) for x, y, _, _ in kinds if x and y]
        kx, ky = np.array([self.shapes.get(x, ns) for x, _ in inner], np.int64), np.array([self.cases.get(y, nc) for _, y in inner], np.int64)
        codes = spark.createDataFrame([(x, y, k, int(ky[k])) for k, (x, y) in enumerate(inner)], "x string, y string, k int, yk int")
        flags = spark.createDataFrame([(x, _ends(_mark(x)), _mark(x).endswith("~")) for x in sorted({x for x, *_ in kinds if x})], "x string, marked boolean, loose boolean")

        def at(values: np.ndarray, other: float | np.ndarray = 0.0) -> np.ndarray:  # by shape, for each kind of bigram
            return np.where(kx < ns, np.append(values, 0.0)[kx], other)

        def case_at(values: np.ndarray) -> np.ndarray:
            return np.append(values, 0.0)[ky]

        def lit(values: np.ndarray):
            return F.get(F.lit(np.asarray(values, np.float64)), c("k"))

        def clip(x):
            return F.least(F.greatest(x, F.lit(0.02)), F.lit(0.98))

        def when(condition, x):
            return sums(F.when(condition, x).otherwise(0))

        both_n, opens, closes = c("n") + c("m"), c("x") == "", c("y") == ""
        left = every.where("x != ''").groupBy("a", "x").agg(when(closes, both_n).alias("at_end"), when(closes, c("m")).alias("follows"), when(~closes, c("n")).alias("inside"))
        left = left.join(F.broadcast(flags), "x")
        base = Window.partitionBy(F.when(c("loose"), F.expr("substring(a, 1, length(a) - 1)")).otherwise(c("a")))
        left = checkpoint(left.withColumn("ends", F.when(c("loose"), F.coalesce(F.max(F.when(~c("loose"), c("at_end"))).over(base), F.lit(0))).otherwise(c("at_end"))))
        by_x = left.groupBy("x", "marked", "loose").agg(*(sums(v).alias(v) for v in ("at_end", "follows", "inside"))).collect()
        spaced = [r for r in by_x if r["marked"] and not r["loose"]]
        ratio = min(MOST_INSIDE, sum(r["inside"] for r in spaced) / max(1.0, sum(r["at_end"] for r in spaced)))
        unmarked = float(sum(r["at_end"] for r in by_x if not r["marked"]))
        seen = F.when(c("marked"), F.least(c("inside").cast("double"), ratio * c("ends"))).otherwise(0.0)
        by_shape, follows, inside = np.zeros(ns), np.zeros(ns), np.zeros(ns)
        for r in by_x:
            if r["x"] in self.shapes:
                follows[self.shapes[r["x"]]], inside[self.shapes[r["x"]]] = r["follows"], r["inside"]
        for x, n in left.groupBy("x").agg(sums(seen)).collect():
            if x in self.shapes:
                by_shape[self.shapes[x]] = n
        by_shape /= np.maximum(inside, 1e-9)

        behind = c("marked") & ~opens
        right = every.where("y != ''").join(F.broadcast(flags), "x", "left").groupBy("b", "y").agg(when(opens, both_n).alias("at_start"), sums(both_n).alias("size"), when(behind, c("n")).alias("behind"), when(~opens, both_n).alias("inner"))
        right = checkpoint(right)
        starts = float(right.agg(sums("at_start")).first()[0] or 0)
        share = min(MOST_INSIDE, sum(r["inside"] for r in by_x if r["marked"]) / max(1.0, starts))
        begun = F.least(c("behind").cast("double"), share * c("at_start"))
        start_case, in_case, new_start, new_right, s_begun, s_behind, nr = (np.zeros(nc) for _ in range(7))
        of = (start_case, in_case, new_start, new_right, s_begun, s_behind, nr)
        for y, *own in right.groupBy("y").agg(sums("at_start"), sums("size"), when(c("at_start") > 0, 1), when(c("inner") > 0, 1), sums(begun), sums("behind"), when(c("size") > 0, 1)).collect():
            if y in self.cases:
                for values, v in zip(of, own, strict=True):
                    values[self.cases[y]] = v
        new_start, new_right, nr = new_start + 1.0, new_right + 1.0, float(nr.sum())
        p_start_case = _at_starts(self.shapes, self.cases, start_case)

        both = clip((seen + PRIOR * lit(at(by_shape))) / (c("inside") + PRIOR)), clip((begun + PRIOR * lit(case_at((s_begun + 1.0) / (s_behind + 2.0)))) / (c("behind") + PRIOR))
        yes, no = both[0] * both[1], (1 - both[0]) * (1 - both[1])
        bare = ~c("marked") & (c("at_end") > 0) & (c("at_start") > 0) & (c("n") > 0)
        apart = F.least(F.lit(0.95), APART * unmarked * c("at_end") * c("at_start") / max(1.0, unmarked) / max(1.0, starts) / c("n"))
        post = F.when(bare, apart).when(lit(at(by_shape)) > 0, yes / (yes + no)).otherwise(0.0)
        state = every.where("x != '' and y != ''").join(F.broadcast(codes), ["x", "y"]).drop("x", "y")
        state = state.join(left.drop("x").hint("merge"), "a").join(right.drop("y").hint("merge"), "b")
        state = checkpoint(state.select("a", "b", "k", "yk", "n", "q", "m", "marked", "follows", "size", "at_start", bare.alias("bare"), post.alias("post")))

        own, own_case, other = Window.partitionBy("a"), Window.partitionBy("a", "yk"), Window.partitionBy("b")
        free = c("n") * (1 - c("post"))
        for turn in range(rounds):
            s_shape, n_shape, shape_case = follows.copy(), follows.copy(), np.zeros((ns, nc))
            for k, s_yes, s_no, s_all in state.groupBy("k").agg(sums(c("n") * c("post")), sums(free + c("m")), sums(both_n)).collect():
                if s_all:
                    s_shape[kx[k]] += s_yes
                    n_shape[kx[k]] += s_all
                    shape_case[kx[k], ky[k]] += s_no
            p_any, p_mark, p_shape, o_case, p_case, p_shape_case = _back_off(mark, nm, s_shape, n_shape, shape_case)
            by_mark = np.array([p_mark[self.marks[_mark(x)]] if _mark(x) in self.marks else p_any for x, _ in inner])
            shaped = [np.where((kx < ns) & (ky < nc), np.pad(v, ((0, 1), (0, 1)))[kx, ky], case_at(u)) for v, u in ((p_shape_case, p_case), (p_start_case, start_case / max(1.0, starts)))]
            last = turn == rounds - 1
            real = c("b") != "" if last else F.lit(True)  # as Model has it
            q = (F.when(real, c("size")).otherwise(0) + 1.0) / lit(case_at(in_case) + nr + 1.0)
            p_start = (F.when(real, c("at_start")).otherwise(0) + lit(case_at(new_start)) * q) / lit(case_at(start_case + new_start) + (ky == nc))
            p_right = (F.when(real, c("o_right")).otherwise(0) + lit(case_at(new_right)) * q) / lit(case_at(o_case + new_right) + (ky == nc))
            p_left = (c("s_left") + c("follows") + PRIOR * lit(at(p_shape, by_mark))) / (c("every") + c("follows") + PRIOR)
            held = F.when(free > 0.01, free).otherwise(0.0) + c("m") if last else free
            p_pair = (c("here") + PRIOR * lit(shaped[0])) / (c("all") + PRIOR) * (held + c("new") * p_right) / (c("here") + c("new"))
            p_pair = F.when(c("marked"), lit(shaped[0]) * p_right).otherwise(p_pair)
            token = p_left * lit(shaped[1]) * p_start
            new = (c("n") > 0).cast("int") + (c("m") > 0).cast("int")
            state = state.withColumns({"here": sums(free + c("m")).over(own_case), "new": sums(new).over(own_case) + 1.0})
            state = state.withColumns({"every": sums(both_n).over(own), "s_left": sums(c("n") * c("post")).over(own), "all": sums(free + c("m")).over(own)})
            state = state.withColumn("o_right", sums(free + c("m")).over(other))
            if not last:
                post = F.when(c("bare"), c("post")).when(c("n") == 0, 0.0).otherwise(1.0 / (1.0 + (1 - p_left) * p_pair / F.greatest(token, F.lit(1e-300))))
                state = checkpoint(state.select("a", "b", "k", "yk", "n", "q", "m", "marked", "follows", "size", "at_start", "bare", post.alias("post")))
        odds = F.log(F.greatest(token, F.lit(1e-300))) - F.log(F.greatest((1 - p_left) * p_pair, F.lit(1e-300)))
        odds = F.when(lit(ky == nc) > 0, F.log(p_left / (1 - p_left))).otherwise(odds)
        gaps = checkpoint(state.where("n + q > 0").select(F.concat_ws("\n", "a", "b").alias("gap"), (c("n") + c("q")).alias("seen"), odds.alias("odds")))
        top = gaps.orderBy(F.desc("seen"), "gap").limit(pairs).toArrow()
        names = top.column("gap").to_pylist()
        self.known = dict(zip(names, top.column("odds").to_pylist(), strict=True))
        if len(names) == pairs and pairs:
            least = top.column("seen")[-1].as_py()
            self.rest = gaps.where((c("seen") < least) | (c("seen") == least) & (c("gap") > names[-1])).select("gap", "odds")
        self.nr, self.p_shape, self.p_mark, self.p_any = nr, p_shape.tolist(), p_mark.tolist(), float(p_any)
        self.new_start, self.new_right, self.starts = new_start.tolist(), new_right.tolist(), starts
        self.start_case, self.p_start_case, self.o_case, self.p_case = start_case.tolist(), p_start_case.tolist(), o_case.tolist(), p_case.tolist()
        self.p_shape_case, self.in_case = p_shape_case.tolist(), in_case.tolist()
        self.short = _short(float(sum(n + m for x, y, n, m in kinds if not x and not y)), starts, self.p_any)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rest"}


def forward_backward(odds: list[float], near: list[bool], short: float) -> list[float]:
    """Posteriors of the boundary tokens of a chain of gaps; near[i]: gap i lies one word after gap i-1, where a token
    that follows another has ``short`` more log-odds."""
    n, step = len(odds), math.exp(short)
    emit = [math.exp(max(-40.0, min(40.0, o))) for o in odds]
    forward, f0, f1 = [], 1.0, 0.0
    for e, close in zip(emit, near, strict=True):
        f0, f1 = f0 + f1, (f0 + f1 * (step if close else 1.0)) * e
        f0, f1 = f0 / (f0 + f1), f1 / (f0 + f1)
        forward.append((f0, f1))
    b0 = b1 = 1.0
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        f0, f1 = forward[i]
        out[i] = f1 * b1 / (f0 * b0 + f1 * b1)
        turn = step if near[i] else 1.0
        b0, b1 = b0 + emit[i] * b1, b0 + emit[i] * b1 * turn
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    return out


class Splitter:
    """Cuts texts into units with a trained model; remembers pieces and the log-odds of gaps."""

    def __init__(self, model: Model, partly: bool = False):
        """``partly``: gaps that the model does not know are left for later."""
        self.model, self.partly, self.known, self.memo, self.joined = model, partly, {}, {}, {}

    def keys(self, piece: str) -> tuple[str, str, str, str]:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[piece] = keys(piece)
        return got

    def gap(self, pair: tuple[str, str]) -> float:
        """The log-odds of the gap between two pieces."""
        if len(self.memo) > 600_000:
            self.memo.clear()
        a, b = pair
        left, right = self.keys(a), self.keys(b)
        if not a.endswith(_JOINED) and _THAI.search(a):
            got = GIVEN
        elif _ELLIPSIS.search(left[1]):
            got = -GIVEN if right[3] == "lower" else GIVEN
        else:
            got = None
            if self.model.known is not None:
                name = _name(left[0], right[2])
                got = self.model.known.get(name)
                if got is None:
                    got = UNKNOWN if self.partly else self.joined.get(name)
            if got is None:
                got = self.model.odds(*left[:2], *right[2:])
        self.memo[pair] = got
        return got

    def unknown(self, text: str) -> list[str]:
        """Names of the gaps of a line that are left for later."""
        own = tokens(text)
        pairs = dict.fromkeys(zip(own, own[1:], strict=False))
        return list(dict.fromkeys(_name(self.keys(a)[0], self.keys(b)[2]) for a, b in pairs if self.gap((a, b)) == UNKNOWN))

    def line(self, text: str) -> list[int] | None:
        """Ends of the units inside one line (the last end is the line's own); None if gaps are left for later."""
        own = tokens(text)
        if len(own) < 2:
            return []
        get, odds = self.memo.get, []
        for pair in zip(own, own[1:], strict=False):
            o = get(pair)
            odds.append(self.gap(pair) if o is None else o)
        likely = [i for i, o in enumerate(odds) if o > FAINT]
        if not likely:
            return []
        if self.partly and any(odds[i] == UNKNOWN for i in likely):
            return None
        if len(likely) > 1:
            chosen = self.chain(odds, likely)
        else:
            chosen = [likely[0]] if odds[likely[0]] > 0 else []
        if not chosen:
            return []
        free, ends = outside(text, own), places(text, own)
        return [ends[i] for i in chosen if free is None or free[i]]

    def chain(self, odds: list[float], likely: list[int]) -> list[int]:
        """Of the gaps that may hold a token those whose posterior is above one half."""
        out, begin = [], 0
        for j in range(1, len(likely) + 1):
            if j < len(likely) and likely[j] == likely[j - 1] + 1:
                continue
            run = likely[begin:j]
            begin = j
            if len(run) == 1:  # its neighbours hold none
                out += run if odds[run[0]] > 0 else []
            else:
                some = forward_backward([odds[i] for i in run], [i > run[0] for i in run], self.model.short)
                out += [i for i, p in zip(run, some, strict=True) if p > 0.5]
        return out

    def split(self, text: str, wrapped: bool, later: list[tuple[int, str]] | None = None) -> list[tuple[int, int]]:
        """(start, end) of the units.  wrapped: a single line break is only a wrap, a blank line ends a unit.  ``later`` takes
        the start and the text of each line that is left for later."""
        seen = narrow(text)
        out = []
        for a, b in _lines(seen, wrapped):
            part = seen[a:b].replace("\n", " ") if wrapped else seen[a:b]
            ends = self.line(part)
            if ends is None:
                later.append((a, part))
                continue
            at = a
            for end in [*(a + e for e in ends), b]:
                s, e = _bare(seen, at, end)
                if s < e:
                    out.append((s, e))
                at = end
        return out


_BLANK = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+[^\S\n]*")
_BREAK = re.compile(r"[\n\r  \x0b\x0c\x85]+")


def _lines(text: str, wrapped: bool) -> Iterator[tuple[int, int]]:
    at = 0
    for m in (_BLANK if wrapped else _BREAK).finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def bigrams(texts: Iterable[tuple[str, bool]], quoted: Counter | None = None) -> Counter:
    """Counts of (piece, piece) in the lines of (text, wrapped); "" stands for a line's start and end.  ``quoted`` takes those
    of gaps inside quotations and brackets."""
    out: Counter = Counter()
    for text, wrapped in texts:
        seen = narrow(text)
        for a, b in _lines(seen, wrapped):
            line = seen[a:b].replace("\n", " ")
            own = tokens(line)
            if own:
                pairs = zip(["", *own], [*own, ""], strict=True)
                free = outside(line, own)
                if quoted is not None and free is not None:
                    pairs = list(pairs)
                    quoted.update(compress(pairs, [False, *(not f for f in free), False]))
                out.update(pairs if free is None else compress(pairs, [True, *free, True]))
                if len(own) == 1:
                    out["", ""] += 1
    return out


def folded(pairs: Counter) -> Counter:
    """Counts of (history, its shape, what follows, its shape) of the model from those of pieces."""
    memo: dict[str, tuple[str, str, str, str]] = {"": ("", "", "", "")}
    out: Counter = Counter()
    for (a, b), n in pairs.items():
        for piece in (a, b):
            if piece not in memo:
                memo[piece] = keys(piece)
        out[memo[a][:2] + memo[b][2:]] += n
    return out


def train(clean: list[str], texts: list[tuple[str, bool]] = ()) -> Model:
    """clean: one sentence each; texts: (text, wrapped), all of which are counted here."""
    return Model([(*k, n) for k, n in folded(bigrams(texts)).items()], clean=[(*k, n) for k, n in folded(bigrams((t, False) for t in clean)).items()])


_SPLITTERS: dict[tuple[int, bool], Splitter] = {}


def _mapped(df: DataFrame, shared, partly: bool, one, schema: str) -> DataFrame:
    """``one`` gives the columns of ``schema`` for a splitter and a batch of ``df``, which has a column _text."""
    key = (shared._jbroadcast.id() if shared._jbroadcast is not None else 0, partly)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _SPLITTERS.get(key)
        if splitter is None:
            _SPLITTERS.clear()
            splitter = _SPLITTERS[key] = Splitter(shared.value, partly)
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(one(splitter, part), fields, strict=True)], names=[name for name, _ in fields])

    return df.mapInArrow(run, schema)


def sentences(df: DataFrame, clean: DataFrame, id_col: str, text_col: str, wrapped: bool, record_table: str, model: Model | None = None) -> DataFrame:
    """(record_table, record_id, start_pos, end_pos): the sentence units of each non-blank text, in order.

    ``clean`` holds one clean sentence per row in ``text``.  ``wrapped`` says whether single
    line breaks are only wraps.  ``model``: of fit, with ``df`` among its sources.  Positions count code points; units have
    no white space at their ends and cover all visible characters.  Null, empty and blank texts have no units; very long
    texts are cut whole.
    """
    model = model or fit([(df, text_col, wrapped)], clean)
    shared = df.sparkSession.sparkContext.broadcast(model)
    units = "record_id long, start_pos long, end_pos long"

    def whole(splitter: Splitter, part: pa.RecordBatch) -> tuple:
        ids, starts, ends, counts = part.column(0), [], [], []
        for text in part.column(1).to_pylist():
            own = splitter.split(text, wrapped)
            counts.append(len(own))
            starts += [s for s, _ in own]
            ends += [e for _, e in own]
        return np.repeat(np.asarray(ids), counts), starts, ends

    def first(splitter: Splitter, part: pa.RecordBatch) -> tuple:
        """Units, and lines with gaps to be joined: (id, start, null, line, names of the gaps)."""
        out = [], [], [], [], []
        for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            later: list[tuple[int, str]] = []
            rows = [(i, s, e, None, None) for s, e in splitter.split(text, wrapped, later)]
            for row in [*rows, *((i, a, None, line, splitter.unknown(line)) for a, line in later)]:
                for values, v in zip(out, row, strict=True):
                    values.append(v)
        return out

    def then(splitter: Splitter, part: pa.RecordBatch) -> tuple:
        out = [], [], []
        for i, line, at, joined in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
            splitter.joined = {x["gap"]: x["odds"] for x in joined or ()}
            for s, e in splitter.split(line, True):
                for values, v in zip(out, (i, at + s, at + e), strict=True):
                    values.append(v)
        return out

    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text")).where("_id is not null and _text is not null and _text != ''")
    if model.rest is None:
        out = _mapped(rows, shared, False, whole, units)
    else:
        parts = checkpoint(_mapped(rows, shared, True, first, f"{units}, line string, gaps array<string>"))
        lines = parts.where("line is not null").withColumn("_key", F.md5("line"))
        held = lines.select("_key", F.explode("gaps").alias("gap")).join(model.rest.hint("merge"), "gap").groupBy("_key").agg(F.collect_set(F.struct("gap", "odds")).alias("_rest"))
        late = lines.join(held.hint("merge"), "_key", "left").select("record_id", F.col("line").alias("_text"), "start_pos", "_rest")
        out = parts.where("line is null").select("record_id", "start_pos", "end_pos").unionByName(_mapped(late, shared, False, then, units))
    return out.select(F.lit(record_table).alias("record_table"), "record_id", "start_pos", "end_pos")


def counts(df: DataFrame, column: str, wrapped: bool) -> DataFrame:
    """(a, x, b, y, n, q): partial counts of the bigrams of all whole texts; q: inside quotations and brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        quoted: Counter = Counter()

        def flush() -> pa.RecordBatch:
            n, q = folded(seen), folded(quoted)
            rows = list(n | q)
            seen.clear()
            quoted.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in rows], pa.string()) for j in range(4)), *(pa.array([of[k] for k in rows], pa.int64()) for of in (n, q))], names=["a", "x", "b", "y", "n", "q"])

        for batch in batches:
            for part in slices(batch, "_text"):
                seen.update(bigrams(((t, wrapped) for t in part.column(0).to_pylist()), quoted))
                if len(seen) + len(quoted) > 300_000:
                    yield flush()
        yield flush()

    return df.where(df[column].isNotNull()).select(df[column].alias("_text")).mapInArrow(run, "a string, x string, b string, y string, n long, q long")


def fit(sources: list[tuple[DataFrame, str, bool]], clean: DataFrame, pairs: int = PAIRS, words: int = WORDS) -> Model:
    """Train on the bigrams of all texts of the (table, column, wrapped) sources and of all ``clean`` sentences.

    All are counted, and all counts take part.  Of more than ``pairs`` bigrams or ``words`` ends and starts of lines
    Spark makes the model (Whole), else the driver.
    """
    every = counts(clean, "text", False).select("a", "x", "b", "y", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("q"), F.col("n").alias("m"))
    for df, column, wrapped in sources:
        every = every.unionByName(counts(df, column, wrapped).withColumn("m", F.lit(0).cast("long")))
    every = checkpoint(every.groupBy("a", "x", "b", "y").agg(*(F.sum(v).alias(v) for v in ("n", "q", "m"))))
    inner, ends = every.where("n + m > 0").agg(F.count_if(F.expr("x != '' and y != ''")), F.count_if(F.expr("x = '' or y = ''"))).first()
    if not inner:
        return Model()
    if inner > pairs or ends > words:
        return Whole(every, pairs)
    kept = every.where("n + m > 0").toArrow()
    rows = sorted(zip(*(kept.column(v).to_pylist() for v in ("a", "x", "b", "y", "n", "m")), strict=True))
    return Model([r[:5] for r in rows], clean=[(*r[:4], r[5]) for r in rows])
