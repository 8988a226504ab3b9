"""Shared spans against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("textevidence.llm")
from textevidence.llm import spans  # noqa: E402


def brute(docs: list[tuple[int, str | None]], span: int) -> set[tuple[int, int, int]]:
    where = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            where[t[p : p + span]].add(i)
    marked: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for i, t in docs:
        p = 0
        flags = [len(where[t[p : p + span]]) > 1 for p in range(len(t or "") - span + 1)] if t else []
        while p < len(flags):
            if flags[p]:
                end = p + span
                q = p
                while q + 1 < len(flags) and (flags[q + 1] or q + 1 < end and any(flags[q + 1 : end + 1])):
                    q += 1
                    if flags[q]:
                        end = q + span
                marked[i].add((p, end))
                p = end
            else:
                p += 1
    out = set()
    for i, runs in marked.items():
        done: list[list[int]] = []
        for s, e in sorted(runs):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(i, s, e) for s, e in done}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghij আমি。\x07😀"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(10, 120))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pieces) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 290), (104, docs[0][1]), (105, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 40)
    for opened in (spans.OPENED, 2000, 0):  # buckets too large to be opened go on as rows of windows
        assert {tuple(r) for r in spans.shared_spans(df, span=40, gram=20, opened=opened).collect()} == want


def test_defined_cases(spark):
    text = "".join(random.Random(0).choices("abcdefgh ", k=400))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, "z")], "doc_id long, text string, start_pos string")
    assert spans.shared_spans(df).count() == 0  # one record only, repeated, and one without an id
    df = spark.createDataFrame([(1, text), (2, "<" + text[:250]), (3, "short")], "doc_id long, text string")
    assert sorted(tuple(r) for r in spans.shared_spans(df).collect()) == [(1, 0, 250), (2, 1, 251)]
    parts = {r["doc_id"]: (r["shared_chars"], r["n_chars"]) for r in spans.shared_parts(df).collect()}
    assert parts == {1: (250, 400), 2: (250, 251), 3: (0, 5)}
    assert spans.shared_spans(df.where("false")).count() == 0


def test_packing_loses_nothing():
    rng = np.random.default_rng(1)
    rows = [rng.choice(np.array([10, 13, 32, 97, 98, 0x964, 0x995, 0x9CD, 0x200D, 0x201C, 7, 0x4E00, 0x1F600]), int(n)) for n in rng.integers(1, 30, 200)]
    rows += [np.array([97, 0x995, 0x964]), np.array([7]), np.array([0x10FFFF, 97])]
    codes = np.concatenate(rows).astype(np.uint32)
    lens = np.array([len(r) for r in rows])
    start = np.cumsum(lens) - lens
    half = lens // 2
    import pyarrow as pa

    page, offsets, data = spans.pack(codes, np.stack((start, start + half), 1).ravel(), np.stack((half, lens - half), 1).ravel())
    array = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    back, sizes = spans.unpack(page, array)
    assert back.tolist() == codes.tolist() and sizes.tolist() == lens.tolist()
    assert (page[:200] == 19).any() and (page == -1).any()


def test_long_texts_come_in_pieces(monkeypatch, spark):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdef ", k=3000))
    docs = [(1, base), (2, base[500:1900]), (3, "x" + base[1000:1300])]
    want = brute(docs, 40)
    ids, texts, bases = spans.in_pieces([1, 2, 3], [t for _, t in docs], 40, size=300)
    assert len(texts) > 10 and all(docs[i - 1][1][b : b + len(t)] == t for i, t, b in zip(ids, texts, bases))
    made = spans.thinned(spans.units(ids, texts, 40, 20, bases))
    columns = [np.asarray(made.column(k)) for k in (0, 1, 2, 3, 4, 5, 7)]
    doc, start, end = spans._merge(*spans.compare(*columns, made.column(6), 40, 20))
    assert {tuple(map(int, x)) for x in zip(doc, start, end)} == want


def test_lines_of_long_texts_and_hot_lines(spark):
    """A text of very many lines, and a line that every record has, come out whole."""
    hot, rng = "h" * 60, random.Random(2)
    long = "\n".join(f"line {i} " + "x" * 50 for i in range(20_000))
    docs = [(i, f"own {i} {rng.random()} {'y' * 50}\n{hot}\n") for i in range(3000)] + [(5000, long), (5001, "\n" + long), (5002, None), (None, hot)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spans.repeated_lines(df, span=50)
    assert got.where("doc_id < 5000").count() == 2999 and got.where("doc_id < 5000 and kept_id = 0 and end_pos - start_pos = 60").count() == 2999
    far = got.where("doc_id = 5001").collect()
    assert len(far) == 20_000 and all(r["kept_id"] == 5000 and r["kept_pos"] == r["start_pos"] - 1 for r in far)
    assert spans.repeated_lines(df.where("false")).count() == 0


def test_anchor_at_the_end():
    """Stretches may be empty at either end of a slice."""
    for seed in range(30):
        text = "".join(random.Random(seed).choices("abcd", k=40))
        made = spans.thinned(spans.units(np.array([1, 2]), [text, text], 40, 20))
        assert made.num_rows == 2 and np.asarray(made.column(7)).tolist() == [spans.COMMON, spans.KNOWN]
