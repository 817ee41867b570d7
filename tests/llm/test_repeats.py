from __future__ import annotations

import hashlib
import random

import pytest

from viewforge.llm import repeats as R


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        keep = bytearray(b"\1") * len(data)
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                keep[k : k + 100] = bytes(100)
            seen.add(window)
        left = bytes(c for c, k in zip(data, keep, strict=True) if k)
        runs = sum(1 for k in range(len(keep)) if not keep[k] and (not k or keep[k - 1]))
        out[doc] = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefg é "

    def text(n):
        return "".join(rng.choices(letters, k=n))

    passages = [text(rng.choice([99, 100, 101, 130, 400])) for _ in range(8)]
    rows = []
    for doc in range(60):
        parts = [rng.choice([text(rng.randint(0, 200)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        rows.append((doc, "".join(parts)))
    rows += [(60, "ab" * 400), (61, "a" * 1000), (62, rows[5][1]), (63, rows[5][1]), (64, ""), (65, "x" * 99)]
    return rows


def result(df):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove_repeats(df).collect()}


@pytest.mark.parametrize("seed,limit", [(1, 4000), (2, 4000), (3, 3), (4, 1)])
def test_against_windows(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(R, "GROUP_SPANS", limit)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows)


def test_slices(spark):
    rng = random.Random(9)
    half = "".join(rng.choices("abcdefgh ", k=R.CHUNK_BYTES * 3 // 4))
    rows = [(1, half + "-" + half), (2, half[1000:3000])]
    out = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out[1][1:3] == (len(half), 1) and out[2][1:3] == (2000, 1)


def test_maximal_repeats():
    texts = [b"xabcabcy", b"zabcw"]
    found = {(texts[p[0][0]][p[0][1] : p[0][1] + n], frozenset(p)) for n, p in R.maximal_repeats(texts, 2)}
    assert (b"abc", frozenset({(0, 1), (0, 4), (1, 1)})) in found
    assert not any(s == b"bc" for s, _ in found)


def test_hot_passage(spark, monkeypatch):
    """A passage in most documents, its ends in ever other surroundings, in groups far over the limit."""
    monkeypatch.setattr(R, "GROUP_SPANS", 20)
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh ", k=230))
    rows = [(doc, "".join(rng.choices("abcd ", k=rng.randint(0, 150))) + passage + "".join(rng.choices("abcd ", k=rng.randint(0, 150)))) for doc in range(400)]
    rows += [(400 + k, rows[k % 7][1]) for k in range(100)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == brute(rows)


def test_namesakes(spark):
    rng = random.Random(12)
    a, b = ("".join(rng.choices("abcdefg ", k=300)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (3, b + "x")]
    out = sorted((r.id, r.n_bytes, r.n_removed, r.kept_text) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    assert out == sorted([(1, 300, 0, a), (2, 300, 300, ""), (2, 300, 0, b), (3, 301, 300, "x")])


def test_copies_pass_the_tree(monkeypatch):
    """What copies lose comes from the maximal repeats of a group."""
    text = bytes(range(120))
    assert list(R.maximal_repeats([text], 100, [True])) == [(120, [(0, 0)])]
    marks = list(R.group_marks([(0, 0, 5, 10, 3, text, 77)]))
    assert marks == [(77, 3, None, None, R.packed_part(text))]


def test_cases(spark):
    long = "".join(random.Random(4).choices("abcdefg ", k=500))
    rows = [(1, long), (2, None), (3, "é" * 40), (4, long), (4, long), (None, long), (5, long.upper())]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    out = R.remove_repeats(df, with_text=True).collect()
    assert len(out) == len(rows)
    by = {r.id: (r.n_removed, r.kept_text) for r in out}
    assert by[1] == by[None] == (0, long) and by[2] == (0, "") and by[3] == (0, "é" * 40) and by[4] == (500, "")
    assert R.remove_repeats(df.limit(0)).count() == 0
    rows = R.without_repeats(df.withColumnRenamed("start", "n_chars")).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in rows}[4] == ("", 0) and len(rows) == 7
