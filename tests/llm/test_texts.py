"""Scans, look-alikes, sentences, personal data and languages on defined cases and held-out rows."""

from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("textevidence.llm")
from textevidence.llm import langid, lookalike, pii, scan, sentences  # noqa: E402


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect()]


# Sentences.


@pytest.fixture(scope="module")
def transcripts(spark, data):
    return [r[0] for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/corpus_events.parquet").where("transcript is not null").select("transcript").collect()]


@pytest.fixture(scope="module")
def splitter(samples, transcripts):
    return sentences.Splitter(sentences.train([t for _, t in samples], [(t, False) for t in transcripts]))


def units(splitter, text, wrapped=False):
    return [text[a:b] for a, b in splitter.split(text, wrapped)]


def test_clean_sentences_stay_whole(splitter, samples):
    assert [t for lang, t in samples if lang != "th" and len(units(splitter, t)) != 1] == []


def test_joined_sentences_come_apart(splitter, samples):
    rng, wrong, total = random.Random(4), 0, 0
    for lang in sorted({x for x, _ in samples}):
        own = [t for x, t in samples if x == lang]
        for _ in range(40):
            some = rng.sample(own, 3)
            total += 1
            wrong += units(splitter, ("" if lang in ("zh", "ja") else " ").join(some)) != some
    assert wrong / total < 0.02


@pytest.mark.parametrize(
    ("text", "wrapped", "want"),
    [
        ("Dr. Who left at 9.30 a.m. with approx. 5 boxes. He slept.", False, ["Dr. Who left at 9.30 a.m. with approx. 5 boxes.", "He slept."]),
        ("“Stop! Do not open it.” shouted the guard. It rained.", False, ["“Stop! Do not open it.” shouted the guard.", "It rained."]),
        ("„Halt! Nicht öffnen.“ rief der Wächter. Es regnete.", False, ["„Halt! Nicht öffnen.“ rief der Wächter.", "Es regnete."]),
        ("It rained. (The gate stayed shut.) He slept.", False, ["It rained.", "(The gate stayed shut.)", "He slept."]),
        ("one line\nanother line", False, ["one line", "another line"]),
        ("one line\nits rest\n\nanother unit", True, ["one line\nits rest", "another unit"]),
        ("সে এল।আমি গেলাম।", False, ["সে এল।", "আমি গেলাম।"]),
        ("Am 3. Mai lag der Pegel hoch. Es regnete.", False, ["Am 3. Mai lag der Pegel hoch.", "Es regnete."]),
        ("  ", False, []), ("", False, []), ("x", False, ["x"]),
    ],
)
def test_cases(splitter, text, wrapped, want):
    assert units(splitter, text, wrapped) == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB. ?!\n।“”\"'()9อ 。"), max_size=60), st.booleans())
def test_units_cover_the_text(text, wrapped):
    got = sentences.Splitter(sentences.Model()).split(text, wrapped)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    covered = {i for a, b in got for i in range(a, b)}
    assert all(c.isspace() or i in covered for i, c in enumerate(text))
    assert not any(text[a].isspace() or text[b - 1].isspace() for a, b in got)


SHORT = -2.5


def brute_posteriors(odds, near):
    import itertools
    import math

    total, sums = 0.0, [0.0] * len(odds)
    for events in itertools.product((0, 1), repeat=len(odds)):
        w = math.exp(sum(o for o, e in zip(odds, events, strict=True) if e)) * math.prod(math.exp(SHORT) for i in range(1, len(odds)) if near[i] and events[i] and events[i - 1])
        total += w
        for i, e in enumerate(events):
            sums[i] += w * e
    return [s / total for s in sums]


def test_forward_backward():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(1, 7)
        odds, near = [rng.uniform(-3, 3) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
        assert sentences.forward_backward(odds, near, SHORT) == pytest.approx(brute_posteriors(odds, near))


def test_what_is_counted_decides():
    """A word that never ends a line is an abbreviation, on no list; another mark ends units once lines end in it."""
    texts = [("Der Rat traf Xyqz. Maler im Haus.", False), ("Gestern kam Xyqz. Weber ins Dorf.", False), ("Dann ging Xyqz. Bauer fort.", False)] * 10
    texts += [(f"{a} {b}", False) for a in ("Der Rat schlief.", "Das Dorf schlief.") for b in ("Der Maler kam.", "Das Haus fiel.", "Der Weber schlief.")] * 10
    texts += [(x, False) for x in ("Der Rat schlief.", "Das Haus fiel.", "Der Maler kam.", "Das Dorf schlief.")] * 20
    own = sentences.Splitter(sentences.train([], texts))
    assert units(own, "Das Dorf fiel. Der Rat sah Xyqz. Weber.") == ["Das Dorf fiel.", "Der Rat sah Xyqz. Weber."]


def test_unpunctuated_text(transcripts, samples, splitter):
    """Texts without their marks: a third of the boundaries are line breaks, the others have nothing but words."""
    rng, ends = random.Random(2), "".join(c for c in sentences._ENDS)
    known = []
    for text in transcripts:
        own = [u for x in units(splitter, text) if (u := x.strip().rstrip(ends + "\"'”’»)]"))]
        if own and not any(sentences._DENSE.search(u) or sentences._THAI.search(u) for u in own):
            known.append(own)
    broken = [("".join(u + (("\n" if rng.random() < 0.4 else " ") if k + 1 < len(own) else "") for k, u in enumerate(own)), False) for own in known[::2]]
    bare, right, found, true = sentences.Splitter(sentences.train([], broken)), 0, 0, 0
    for own in known[1::2]:
        text, at, want = " ".join(own), 0, set()
        for u in own[:-1]:
            at += len(u)
            want.add(at)
            at += 1
        got = {b for _, b in bare.split(text, False)} - {len(text)}
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert right / true > 0.9 and right / found > 0.95


def test_fit_counts_every_text(spark, samples):
    """The counts of all rows reach the model: with bounds of any size the sums by shape are the same, in any order."""
    clean = spark.createDataFrame(samples, "lang string, text string")
    rng, some = random.Random(3), [f"{a} {b} {c}." for a, b in (("Der", "Rat"), ("Das", "Dorf"), ("Der", "Weber"), ("Das", "Haus")) for c in ("kam", "schlief", "ging", "fiel")]
    rows = [(i, "".join(rng.choice(some) + rng.choice(" \n") for _ in range(4)).strip() if i % 7 else None) for i in range(240)]
    made = []
    for n, order in ((1, rows), (3, rows[::-1])):
        df = spark.createDataFrame(order, "id long, text string").repartition(n)
        made.append(sentences.fit([(df, "text", False)], clean))
    text = "Das Dorf kam. Der Rat ging. Das Haus fiel."
    got = [sentences.Splitter(m).split(text, False) for m in made]
    assert got[0] == got[1] and [text[a:b] for a, b in got[0]] == ["Das Dorf kam.", "Der Rat ging.", "Das Haus fiel."]
    few = sentences.fit([(spark.createDataFrame(rows, "id long, text string"), "text", False)], clean, pairs=5, words=5)
    assert abs(sum(few.start_case) - sum(made[0].start_case)) < 1e-6


def test_fit_counts_every_clean_sentence(spark):
    """Clean sentences are counted however many there are, those that sort last as well."""
    clean = spark.range(6000).selectExpr("concat('Satz ', id, ' endet hier.') as text")
    df = spark.createDataFrame([(1, "Der Rat kam. Er ging.")], "id long, text string")
    assert sum(sentences.fit([(df, "text", False)], clean).start_case) == 6001


@pytest.mark.parametrize("few", [3, 300])
def test_bounds_change_no_units(spark, data, few):
    """What the driver may collect decides where the model is made, not what it knows: rare words and quotations, too."""
    events = spark.read.parquet(f"{data}/corpus_events.parquet").select("event_id", "transcript").unionByName(
        spark.createDataFrame([(-1, "Der Rat sprach: „Zwölf Qrx. kamen, acht Vbn. nicht.“ Er schlief. Er ging."), (-1, "It rained. He slept.\nHe left."), (-2, " ")], "event_id long, transcript string")
    )
    pages = spark.read.parquet(f"{data}/pdf_pages.parquet").where("engine = 'pdfjs-dist'").select("page_id", "text")
    clean, sources = spark.read.parquet(f"{data}/lang_samples.parquet"), [(events, "transcript", False), (pages, "text", True)]
    got = []
    for model in (sentences.fit(sources, clean), sentences.fit(sources, clean, pairs=few, words=few)):
        rows = sentences.sentences(events, clean, "event_id", "transcript", False, "e", model).unionByName(sentences.sentences(pages, clean, "page_id", "text", True, "p", model))
        got.append((model, sorted(tuple(r) for r in rows.collect())))
    (whole, want), (bounded, have) = got
    assert have == want
    assert len(bounded.known) == few
    rest = dict(tuple(r) for r in bounded.rest.collect())
    counted = sentences.folded(sentences.bigrams((r[0], False) for r in events.where("transcript is not null").select("transcript").collect()))
    for a, x, b, y in counted:
        if x and y:
            name = sentences._name(a, b)
            assert bounded.known.get(name, rest.get(name)) == pytest.approx(whole.odds(a, x, b, y), abs=1e-4)


def test_sentence_frame(spark, samples, splitter):
    clean = spark.createDataFrame(samples, "lang string, text string")
    df = spark.createDataFrame([(1, None, 5), (2, " ", 5), (3, "It rained. He slept.", 5), (3, "It rained. He slept.", 5)], "record_id long, text string, start_pos int")
    rows = sentences.sentences(df, clean, "record_id", "text", False, "t", splitter.model).collect()
    assert sorted((r["record_id"], r["start_pos"], r["end_pos"]) for r in rows) == sorted([(3, 0, 10), (3, 11, 20)] * 2)


# Languages.


@pytest.fixture(scope="module")
def model(samples):
    return langid.train([x for i, x in enumerate(samples) if i % 3])


def test_held_out_languages(model, samples):
    scorer = langid.Scorer(model)
    held = [(lang, t) for i, (lang, t) in enumerate(samples) if i % 3 == 0 and len(t) > 25]
    got = scorer.segments([t for _, t in held])
    right = sum(bool(f) and {x[0] for x in f} == {lang} for (lang, _), f in zip(held, got, strict=True))
    wrong = sum(any(x[0] != lang for x in f) for (lang, _), f in zip(held, got, strict=True))
    assert right / len(held) > 0.85 and wrong / len(held) < 0.05


def test_two_languages_and_gibberish(model):
    scorer = langid.Scorer(model)
    text = "The river station repaired the wooden gate before the heavy rain. নদীর ঘাটের অফিস মাসের শেষ সপ্তাহে ছাদের রং ফিরিয়েছে।"
    assert {x[0] for x in scorer.segments([text])[0]} == {"en", "bn"}
    assert scorer.segments(["zoztzkzqnjygfxqjt;lhxc;bwx", "", "   ", "12 34"]) == [[], [], [], []]


def test_labels_and_markup():
    assert [langid.normal_label(x) for x in (None, "", "EN", "en_GB", "Bengali", "zho", "und", "mixed", "nl", "ben")] == [None, None, "en", "en", "bn", "zh", None, None, None, "bn"]
    assert langid.prose("#REDIRECT [[Place]]") == ""
    text = langid.prose("{{Infobox|a={{b}}}}'''Bold''' and [[link|words]].<ref>x</ref>\n{| class\n! A\n|}\n== Head ==\n[[Category:C]]<!-- note -->")
    assert "Bold and words." in text and not any(x in text for x in ("Infobox", "class", "Head", "Category", "note", "x<"))
    assert [langid.script_mix(t, s) for t, s in (("আমি go", set()), ("আমি", set()), ("ami", {"banglish"}), ("je", {"fr"}), ("১২ 5", set()))] == ["mixed", "bn", "banglish", "en", "unknown"]


# Look-alikes.


def test_same_look():
    same = [("Ｈｅｌｌｏ world", "Hello world"), ("раrk", "park"), ("été", "été"), ("re​ad­ing", "reading"), ("ﬁsh", "fish"), ("a‑b–c", "a-b-c"), ("য়ো", "য়ো"), ("র‍্যালি", "র্যালি"), ("น้ำ", "น้ํา"), ("ｶﾞ", "ガ")]
    assert [(a, b) for a, b in same if lookalike.bare(a) != lookalike.bare(b)] == []
    other = [("Park", "park"), ("১", "1"), ("x²", "x2"), ("মালিক", "মালীক"), ("almacén", "almacen"), ("a b", "ab")]
    assert [(a, b) for a, b in other if lookalike.bare(a) == lookalike.bare(b)] == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_bare_is_stable(text):
    once = lookalike.bare(text)
    assert lookalike.bare(once) == once
    assert lookalike.bare(unicodedata.normalize("NFD", text)) == lookalike.bare(unicodedata.normalize("NFC", text))


def test_trie_automaton():
    trie = lookalike.Trie([("cafe", "cafe", 5), ("র্যালি", "র‍্যালি", 9), ("cage", "cage", 1)])
    assert trie.find("сafе") == "cafe" and trie.find("র্যা​লি") == "র‍্যালি" and trie.find("cake") is None
    assert trie.find("cake", max_cost=1) == "cafe" and trie.find("caf", max_cost=1) == "cafe" and trie.find("", max_cost=1) is None


def test_look_pairs(spark):
    rows = [(1, "Hello there"), (2, "Hello there"), (3, "Hello there"), (4, "Неllo there"), (5, None), (6, ""), (7, "​"), (8, "other"), (9, "Other"), (2, "Hello there")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, look string")
    got = {tuple(r)[1:] for r in lookalike.found([("t", df, "id", "text")]).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (3, 4), (2, 4)}
    texts = {r["id"]: r["text"] for r in lookalike.canonical(df, [], "id", "text").collect()}
    assert texts[4] == texts[2] == "Hello there" and texts[5] is None


def test_a_look_of_very_many(spark):
    rows = [(i, "pаrk" if i % 2 else "park") for i in range(2000)] + [(5000 + i, f"own {i}") for i in range(3000)]
    got = lookalike.found([("t", spark.createDataFrame(rows, "id long, text string"), "id", "text")])
    assert got.count() == 1999 and got.where("id_a > 1").count() == 0


# Personal data.


@pytest.fixture(scope="module")
def finder(spark, data):
    return pii.Finder(pii.name_parts(spark.read.parquet(f"{data}/name_parts.parquet")))


def test_personal_data(finder, spark, data):
    parts = spark.read.parquet(f"{data}/name_parts.parquet").where("script = 'latn'").collect()
    given_name = next(r["name_part"] for r in parts if r["kind"] == "given")
    family = next(r["name_part"] for r in parts if r["kind"] == "family")
    cases = {
        "Write to a.b+c@in.mail.example before noon.": [("a.b+c@in.mail.example", "EMAIL")],
        "x [at] mail [dot] test, or y at mail dot test.": [("x [at] mail [dot] test", "EMAIL"), ("y at mail dot test", "EMAIL")],
        "Follow @handle or see www.site.example.": [],
        "call 01712 345 678 or +880 1712-345678 or (+88) 017 1234 5678.": [("01712 345 678", "PHONE"), ("+880 1712-345678", "PHONE"), ("(+88) 017 1234 5678", "PHONE")],
        "ring ০১৭১২৩৪৫৬৭৮।": [("০১৭১২৩৪৫৬৭৮", "PHONE")],
        "on zero one seven zero zero one two zero two seven eight today": [("zero one seven zero zero one two zero two seven eight", "PHONE")],
        "Order 2057-886045, serial 4471-83-0093, code 1611, Tk 12,500.00 on 01/02/2020": [],
        "NID 918 350 7848296 was shown; Passport BB4654769 too": [("918 350 7848296", "IDNUM"), ("BB4654769", "IDNUM")],
        "to House 205, Road 28, Block E, Keshtown this week": [("House 205, Road 28, Block E, Keshtown", "ADDRESS")],
        "ঠিকানা বাড়ি ৮০, রোড ১, লিমপুর লিখে রাখুন": [("বাড়ি ৮০, রোড ১, লিমপুর", "ADDRESS")],
        "House 87 of the committee voted on road 68 repairs.": [],
        f"Mr. {given_name} {family} left.": [(f"{given_name} {family}", "NAME")],
        f"signed by J. {family.upper()}, today": [(f"J. {family.upper()}", "NAME")],
        "P<BGDHOLDER<<C<D<<<<<<<<<<<<<<<<<<<<<<<<<<<<\n\nA012345678BGD9001125M3012316<<<<<<<<<<<<<<02": [("HOLDER<<C<D", "NAME"), ("A01234567", "IDNUM")],
        "at 221B Baker Street, London NW1 since": [("221B Baker Street, London NW1", "ADDRESS")],
        "ring +49 30 1234567, SSN 123-45-6789, 3 + 4 = 7, +5 points": [("+49 30 1234567", "PHONE"), ("123-45-6789", "IDNUM")],
        "zero  one seven zero zero one two zero two seven eight": [("zero  one seven zero zero one two zero two seven eight", "PHONE")],
        "": [],
    }
    for text, want in cases.items():
        assert [(text[a:b], k) for a, b, k in finder.spans(text)] == want, text
    wide = "Mail ａ＠mail.test​ now"
    assert [(wide[a:b], k) for a, b, k in finder.spans(wide)] == [("ａ＠mail.test", "EMAIL")]


def test_no_boundary_is_too_far(finder, spark, data):
    """However long a value is, it is found and redacted whole."""
    parts = [r["name_part"] for r in spark.read.parquet(f"{data}/name_parts.parquet").where("script = 'latn' and kind = 'family'").collect()]
    names, sub = " ".join(x.capitalize() for x in parts[:12]), "sub." * 300
    cases = [
        (f"{'x.' * 200}bob@{sub}example.com", "EMAIL"),
        (f"{'b' * 500} [at] {sub}mail [dot] test", "EMAIL"),
        (f"y at {sub}mail dot co dot test", "EMAIL"),
        (f"House 205, {'Road 28, Block E, ' * 40}Keshtown", "ADDRESS"),
        (f"12 {'Q' * 200} Lane, Keshtown", "ADDRESS"),
        (names, "NAME"),
        (f"J. {'K. ' * 60}{parts[0].capitalize()}", "NAME"),
    ]
    for value, kind in cases:
        text = f"Then {value}, and on."
        assert [(text[a:b], k) for a, b, k in finder.spans(text)] == [(value, kind)], value[:60]
    gap = f"NID:{' ' * 400}918 350 7848296"
    assert [gap[a:b] for a, b, _ in finder.spans(gap)] == ["918 350 7848296"]
    mrz = "P<BGDHOLDER<<C<D<<<<<<<<<<<<<<<<<<<<<<<<<<<<\nA012345678BGD9001125M3012316123456789012345602"
    assert [mrz[a:b] for a, b, _ in finder.spans(mrz)] == ["HOLDER<<C<D", "A01234567"]
    for bulk in ("@" * 20_000, "a@" * 20_000, "<" * 20_000, " dot" * 20_000, "+1 " * 20_000, "house " * 20_000, "J. " * 20_000, parts[0] * 3_000, "at]" * 20_000):
        finder.spans(bulk)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("a1@. <P০-\n​ＡHouse,"), max_size=60))
def test_spans_are_ordered(text):
    got = pii.Finder([("Abcdef", "latn", "given"), ("Xyzfam", "latn", "family")]).spans(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.org now", "x"), (2, None, "x"), (3, "", "x")], "id long, text string, replaced string")
    got = {r["id"]: (r["text"], r["replaced"]) for r in pii.redact(df, [("Abc", "latn", "given")], "id", "text").collect()}
    assert got == {1: ("to [EMAIL] now", 1), 2: (None, 0), 3: ("", 0)}


# Scans.


@pytest.fixture(scope="module")
def reader(spark, data):
    return scan.fit(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pdf_pages.parquet"))


def test_words(reader):
    fix = reader.editor.fix
    assert [fix(w) for w in ("fcrry", "cana1", "b0ard", "ferry", "canal", "কবেছে", "xy")] == ["ferry", "canal", "board", None, None, "করেছে", None]


def test_planted_noise_is_undone(reader):
    rng, editor = random.Random(5), reader.editor
    back = [(y, x) for x, ys in editor.confusions.items() for y in ys]
    words = [w for w, n in editor.vocabulary.items() if n >= 8 and len(w) > 4 and w.isalpha()]
    right = total = kept = 0
    for w in rng.sample(words, min(300, len(words))):
        kept += editor.fix(w) is None
        spots = [(y, x) for y, x in back if y in w]
        if spots:
            y, x = rng.choice(spots)
            noisy = w.replace(y, x, 1)
            if noisy not in editor.vocabulary:
                total += 1
                right += editor.fix(noisy) == w
    assert kept == min(300, len(words)) and right / total > 0.9


def test_losses_and_gains():
    """Scans that lose and double characters teach the editor to undo just that; all from what they show."""
    words = "kitchen window garden station harbour railway meadow village bridge canal market printer surveyor engineer lantern basket timber barley workshop warehouse".split()
    vocabulary = {w: 400 for w in words} | {f"zq{a}{b}x{c}": 1 for a in "bdfg" for b in "aeiou" for c in "klmnp"}
    unknown = {w[:i] + w[i + 1 :]: 6 for w in words for i in range(1, len(w) - 1)} | {w[:i] + w[i] + w[i:]: 6 for w in words for i in range(1, len(w) - 1)}
    editor = scan.train_editor(vocabulary, unknown)
    assert any(not x for x in editor.confusions) and any("" in ys for ys in editor.confusions.values())
    assert [editor.fix(w) for w in ("kitchn", "windw", "kittchen", "winddow", "kitchen", "zqraxt")] == ["kitchen", "window", "kitchen", "window", None, None]
    noisy = [(n, w) for w in words for i in range(1, len(w) - 1) for n in (w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:]) if n not in vocabulary]
    assert sum(editor.fix(n) == w for n, w in noisy) / len(noisy) > 0.95


def test_the_model_decides(reader):
    """A weight on keeping is obeyed, and without its weights the editor knows no right word from a wrong one."""
    editor, rng = reader.editor, random.Random(6)
    back = [(y, x) for x, ys in editor.confusions.items() for y in ys if y]
    words = sorted(w for w, n in editor.vocabulary.items() if n >= 8 and len(w) > 4 and w.isalpha())
    noisy = [(w.replace(y, x, 1), w) for w in rng.sample(words, 150) for y, x in [rng.choice(back)] if y in w]
    noisy = [(n, w) for n, w in noisy if n not in editor.vocabulary]
    learned = sum(editor.fix(n) == w for n, w in noisy) / len(noisy)
    model = scan.Perceptron()
    model.weights = dict(editor.model.weights) | {"=|": 1e6}
    assert all(scan.Editor(editor.vocabulary, editor.confusions, model).fix(n) is None for n, _ in noisy)
    model.weights = {}
    blind = scan.Editor(editor.vocabulary, editor.confusions, model)
    assert learned > 0.9 and sum(blind.fix(n) == w for n, w in noisy) / len(noisy) < learned - 0.2


def test_joins(reader):
    assert reader.editor.join("disco", "vered") == "discovered"
    assert reader.editor.join("well", "known") is None


def test_page(reader):
    text = "Annual Report of the Somewhere Board\n\nThe fcrry was late and the irriga-\ntion board met. The well-\nknown potter came.\n\n- 3 -"
    lines = text.split("\n")
    furniture = reader.furniture.of_page(scan.page_lines(lines), ["annual report of the somewhere board"], 3)
    rows, tail = reader.findings(lines, furniture)
    assert {r for r in rows if r[1] != "furniture"} == {(3, "misread", "ferry"), (3, "broken_word", "irrigation")}
    assert furniture == {1, 7} and tail is None
    assert reader.repair(text, furniture) == "The ferry was late and the irrigation board met. The well-known potter came."


def test_scan_frame(spark, reader):
    schema = "page_id long, file_id long, page int, text string, engine string"
    rows = [(1, 7, 1, "The board met at the east-", "x"), (2, 7, 2, "ern canal.", "x"), (3, 7, 3, None, "x"), (4, None, 1, "The fcrry", "x"), (5, 7, 4, "The fcrry", "pdfjs-dist"), (6, 8, 1, "", "x")]
    pages = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "file_id long, image_id long, text string, text_in_image string")
    got = {tuple(r)[1:] for r in scan.found(pages, none, none, reader).collect()}
    assert got == {(1, 1, "broken_word", "eastern"), (4, 1, "misread", "ferry")}
    fixed = {r["page_id"]: r["text"] for r in scan.repaired(pages, reader, "page_id", "text").collect()}
    assert fixed[3] is None and fixed[6] == "" and fixed[4] == "The ferry"


WEIRD = st.text(st.one_of(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), st.sampled_from("\n\n -­​ \t।.3|©\x85আক্ি")), max_size=120)


@settings(max_examples=150, deadline=None)
@given(WEIRD)
def test_no_text_breaks_a_reader(text):
    reader = _READER[0]
    lines = text.split("\n")
    furniture = reader.furniture.of_file(scan.page_lines(lines))
    rows, _ = reader.findings(lines, furniture)
    assert all(1 <= n <= len(lines) for n, _, _ in rows)
    assert isinstance(reader.repair(text, furniture), str)
    assert reader.furniture.of_page(scan.page_lines(lines), ["abc def"], 1) <= set(range(1, len(lines) + 1))
    canon = lookalike.Canon([])
    assert lookalike.bare(canon.text(text)) == lookalike.bare(text)
    for _, _, a, b in _SCORER[0].segments([langid.quick_fold(langid.prose(text))])[0]:
        assert a < b


_READER: list = []
_SCORER: list = []


@pytest.fixture(autouse=True)
def _shared(reader, model):
    _READER[:], _SCORER[:] = [reader], [langid.Scorer(model)]
