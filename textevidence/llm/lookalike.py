"""One form for text that looks the same (problem 2).

A trie holds the vocabulary: words, each under its bare form with its most frequent spelling in all whole texts.
Spark counts the spellings; of the words the trie takes those first whose usual spelling is not the bare one, up to
a bound.  Those beyond it reach their texts by a join.  Every word walks the trie as it stands, by a weighted edit automaton in which look-alikes,
width, joining, the order of marks and characters that do not show cost nothing; the cheapest word within
``max_cost`` gives the canonical spelling (0 by default: only words that look the same).  Words the trie lacks are
normalised by the tables, which also confirm what the walk finds at no cost.  Both ways give one form to all
spellings of a look, so the vocabulary never changes which texts are found equal.  Texts stay in their partition,
unless words beyond the trie are joined; counts of spellings and digests of canonical texts are shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_keys, slices, spread_join
from .lookfold import INVISIBLE, LATIN_LOOK, WIDE

#: Words and letters the trie holds at most: bounds of what is broadcast.
VOCABULARY_WORDS, VOCABULARY_LETTERS = 100_000, 1_000_000

#: Dashes of any width; Arabic stretching; Thai and Lao letters made of two; marks drawn alike.
_DASHES = {c: "-" for c in [0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0xFE58, 0xFE63, 0xFF0D]}
_PARTS = {0x0E33: "ํา", 0x0EB3: "ໍາ", 0x0640: "", 0x0132: "IJ", 0x0133: "ij"}
_LIGATURES = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0x01C4, 0x01CD)]}
FREE = WIDE | LATIN_LOOK | _DASHES | _PARTS | _LIGATURES | {ord(c): "" for c in INVISIBLE}
_TO = {chr(c): to for c, to in FREE.items()}
_UNUSUAL = re.compile("[" + "".join(re.escape(c) for c in _TO if c < "\U00010000") + "]")
_ASTRAL = re.compile("[\U0001d400-\U0001d7ff]")
_TONE = re.compile("([่-๋])ํ")
_TONES = frozenset("่้๊๋")
_WORD = re.compile(r"\S+")
#: What is settled before words are cut: spaces, what stands for several words, what does not show (but joiners).
_BETWEEN = re.compile("[" + "".join(re.escape(c) for c, to in _TO.items() if c.isspace() or any(x.isspace() for x in to) or c in INVISIBLE and c not in "\u200c\u200d") + "]")


def bare(text: str) -> str:
    """The bare form by table: all spellings of a look give the same string."""
    if text.isascii():
        return text
    text = _UNUSUAL.sub(lambda m: _TO[m.group()], text)
    if _ASTRAL.search(text):
        text = _ASTRAL.sub(lambda m: _TO.get(m.group(), m.group()), text)
    text = unicodedata.normalize("NFC", text)
    if _UNUSUAL.search(text):  # composition may make a letter that has a look-alike
        text = unicodedata.normalize("NFC", _UNUSUAL.sub(lambda m: _TO[m.group()], text))
    return _TONE.sub(r"ํ\1", text) if "ํ" in text else text


class Trie:
    """Vocabulary under bare forms; nodes are dictionaries, "" holds the canonical spelling and its weight."""

    def __init__(self, words: list[tuple[str, str, int]]):
        self.root: dict = {}
        for form, spelling, weight in words:
            node = self.root
            for c in unicodedata.normalize("NFD", form):
                node = node.setdefault(c, {})
            if node.get("", ("", 0))[1] < weight:
                node[""] = (spelling, weight)

    def find(self, word: str, max_cost: float = 0.0) -> str | None:
        """The canonical spelling nearest to ``word``: free edits cost 0, any other insertion, deletion or change 1."""
        letters = [x for c in unicodedata.normalize("NFD", word) for x in unicodedata.normalize("NFD", _TO.get(c, c)) or ("",)]
        states: dict[tuple[int, int], tuple[float, dict]] = {}
        front = [(0.0, 0, self.root)]
        best: tuple[float, int, str] | None = None
        while front:
            grown: list[tuple[float, int, dict]] = []
            for cost, i, node in front:
                key = (i, id(node))
                if key in states and states[key][0] <= cost:
                    continue
                states[key] = (cost, node)
                if i == len(letters):
                    if "" in node and (best is None or (cost, -node[""][1]) < best[:2]):
                        best = (cost, -node[""][1], node[""][0])
                elif letters[i] == "":
                    grown.append((cost, i + 1, node))
                elif (to := node.get(letters[i])) is not None:
                    grown.append((cost, i + 1, to))
                if i + 1 < len(letters) and letters[i] in _TONES and letters[i + 1] == "ํ" and (to := node.get("ํ", {}).get(letters[i])) is not None:
                    grown.append((cost, i + 2, to))
                if cost + 1 <= max_cost:
                    if i < len(letters):
                        grown.append((cost + 1, i + 1, node))
                    for c, to in node.items():
                        if c:
                            grown.append((cost + 1, i, to))
                            if i < len(letters) and c != letters[i]:
                                grown.append((cost + 1, i + 1, to))
            front = grown
        return best[2] if best else None


class Canon:
    """Brings texts to their canonical form; remembers words."""

    def __init__(self, words: list[tuple[str, str, int]], max_cost: float = 0.0):
        self.trie, self.max_cost, self.memo = Trie(words), max_cost, {}

    def word(self, word: str) -> str:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got, form = self.trie.find(word, self.max_cost), bare(word)
            if not self.max_cost and (got is None or got != form and bare(got) != form):
                got = self.trie.find(form)  # composed otherwise than the walk reads it, or not held
                got = None if got is not None and bare(got) != form else got
            got = self.memo[word] = form if got is None else got
        return got

    def text(self, text: str, rest: dict[str, str] | None = None) -> str:
        """``rest``: canonical spellings of bare forms the trie lacks."""
        # spaces first, so that words are seen whole; what does not show may stand alone between spaces
        if not text.isascii():
            text = _BETWEEN.sub(lambda m: _TO[m.group()], text)
        if rest:
            return _WORD.sub(lambda m: rest.get(w := self.word(m.group()), w), text)
        return _WORD.sub(lambda m: self.word(m.group()), text)


def _usable(word: str, form: str) -> bool:
    """Whether a spelling may be the canonical one of its bare form."""
    return word == form or (len(form) == len(word) or "\u200d" in word or "\u200c" in word) and not any(0xFF00 <= ord(c) < 0xFFF0 for c in word) and bare(word) == form


def _words(text: str) -> list[str]:
    return _WORD.findall(text if text.isascii() else _BETWEEN.sub(lambda m: _TO[m.group()], text))


def spellings(df: DataFrame, text_col: str) -> DataFrame:
    """(form, spelling, n): counts of the spellings in all whole texts; partial, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(form, word, n) for word, n in seen.items() if (form := bare(word)) and _usable(word, form)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["form", "spelling", "n"])

        for batch in batches:
            for part in slices(batch, "_text"):
                for text in part.column(0).to_pylist():
                    seen.update(_words(text))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    return df.where(df[text_col].isNotNull()).select(df[text_col].alias("_text")).mapInArrow(run, "form string, spelling string, n long")


def vocabulary(sources: list[tuple[DataFrame, str]], words: int = VOCABULARY_WORDS, letters: int = VOCABULARY_LETTERS) -> tuple[list[tuple[str, str, int]], DataFrame | None]:
    """(bare form, most frequent spelling, count) of words of all texts of the (table, column) pairs, at most ``words``
    with ``letters`` in all; and a table (form, spelling) of those beyond whose spelling is not the bare form, if any.

    Of spellings as frequent as each other the bare one counts; a word seen once is its bare form.
    """
    every = None
    for df, column in sources:
        rows = spellings(df, column)
        every = rows if every is None else every.unionByName(rows)
    every = every.groupBy("form", "spelling").agg(F.sum("n").alias("n"))
    best = every.groupBy("form").agg(F.max_by("spelling", F.struct("n", F.col("spelling") == F.col("form"), "spelling")).alias("spelling"), F.sum("n").alias("n"))
    best = checkpoint(best.where("n > 1").select("form", "spelling", "n", (F.col("spelling") != F.col("form")).alias("other")))
    top = best.orderBy(F.desc("other"), F.desc("n"), "form").limit(words).collect()
    total, kept = 0, []
    for r in top:
        total += len(r["form"])
        if total > letters:
            break
        kept.append(r)
    rest = None
    if all(r["other"] for r in kept) and (len(kept) == words or len(kept) < len(top) and top[len(kept)]["other"]):
        rest = best.where("other").select("form", "spelling", "n")
        if kept:
            last = kept[-1]
            rest = rest.where((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("form") > last["form"]))
        rest = rest.select("form", "spelling")
    return [(r["form"], r["spelling"], r["n"]) for r in kept], rest


_CANONS: dict[tuple, Canon] = {}


def _mapped(df: DataFrame, words: list, max_cost: float, one, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(words)
    key = (shared._jbroadcast.id(), max_cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = _CANONS.get(key)
        if canon is None:
            _CANONS.clear()
            canon = _CANONS[key] = Canon(shared.value, max_cost)
        for batch in batches:
            for part in slices(batch, "_text"):
                yield one(canon, part)

    return df.mapInArrow(run, schema)


def _with_rest(rows: DataFrame, words: list, rest: DataFrame) -> DataFrame:
    """(_id, _text, _rest): texts with the spellings of their words that the trie lacks; equal texts share a key."""

    def one(canon: Canon, part: pa.RecordBatch) -> pa.RecordBatch:
        keys, forms = [], []
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            own = {canon.word(w) for w in _words(text)}
            keys += [key] * len(own)
            forms += own
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(forms, pa.string())], names=["_key", "form"])

    keyed = rows.withColumn("_key", F.md5("_text"))
    held = _mapped(keyed.where("_text is not null").select("_key", "_text"), words, 0.0, one, "_key string, form string")
    own = held.join(rest.hint("merge"), "form").groupBy("_key").agg(F.collect_set(F.struct("form", "spelling")).alias("_rest"))
    return keyed.join(own.hint("merge"), "_key", "left").select("_id", "_text", "_rest")


def canonical(df: DataFrame, words: list, id_col: str, text_col: str, max_cost: float = 0.0, rest: DataFrame | None = None) -> DataFrame:
    """(id, text): each text in its canonical form; null, empty and blank texts stay as they are."""
    joined = rest is not None

    def one(canon: Canon, part: pa.RecordBatch) -> pa.RecordBatch:
        found = part.column(2).to_pylist() if joined else [None] * part.num_rows
        texts = [canon.text(t, {x["form"]: x["spelling"] for x in r or ()}) if t else t for t, r in zip(part.column(1).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text"))
    if joined:
        rows = _with_rest(rows, words, rest)
    return _mapped(rows, words, max_cost, one, f"{id_col} long, text string")


def digests(df: DataFrame, words: list, id_col: str, text_col: str, record_table: str) -> DataFrame:
    """(record_table, record_id, look, spelling): digests of the canonical form and of the text itself."""

    def one(canon: Canon, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, looks, spellings = [], [], []
        for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            form = canon.text(text)
            if form and not form.isspace():
                ids.append(i)
                looks.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                spellings.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(spellings, pa.int64())], names=["record_id", "look", "spelling"])

    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text")).where("_id is not null and _text is not null and _text != ''")
    return _mapped(rows, words, 0.0, one, "record_id long, look binary, spelling long").select(F.lit(record_table).alias("record_table"), "record_id", "look", "spelling")


def found(sources: list[tuple[str, DataFrame, str, str]], words: list | None = None) -> DataFrame:
    """(record_table, id_a, id_b), id_a < id_b: records of one table whose texts look the same but differ.

    ``sources``: (table name, table, id column, text column).  Every record meets one record (that of the least
    id) of each other spelling of its look; copies of a spelling are not paired with each other, nor each with
    each copy of another spelling.  Null, empty and blank texts never count.  Rows are distinct.
    """
    if words is None:
        words, _ = vocabulary([(df, text) for _, df, _, text in sources])  # words the trie lacks are compared bare
    every = None
    for name, df, id_col, text_col in sources:
        rows = digests(df, words, id_col, text_col, name)
        every = rows if every is None else every.unionByName(rows)
    every = checkpoint(every)
    look = ["record_table", "look"]
    several = checkpoint(every.groupBy(look).agg(F.count("*").alias("n"), F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a != b").select(*look, "n"))
    hot = hot_keys(several, look)  # a look that very many records share is dealt to many tasks
    rows = spread_join(every, several.select(look), look, hot)
    first = rows.groupBy(*look, "spelling").agg(F.min("record_id").alias("other")).withColumnRenamed("spelling", "other_spelling")
    pairs = spread_join(rows, first, look, hot).where("spelling != other_spelling and record_id != other")
    return pairs.select("record_table", F.least("record_id", "other").alias("id_a"), F.greatest("record_id", "other").alias("id_b")).distinct()
