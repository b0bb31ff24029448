import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyseal.llm import spelling
from tallyseal.llm.common import Scratch

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k > 1}


def plain_near(words):
    """By what is left when one place is taken out."""
    holes, near = defaultdict(list), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].append(w)
            if (short := w[:k] + w[k + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= set(own) - {w}
    return near


def plain(rows):
    n = plain_words(rows)
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert found(spelling.op12_spelling(spark, SF)) == want and any(f for _, f, *_ in want) and any(n for *_, n, _ in want)


@pytest.fixture(scope="module")
def hard():
    """Dense neighbourhoods, chains of forms, long runs, marks between runs, repeated rows, null ids and texts."""
    rng = random.Random(4)
    base = ["abcabcab", "aaaaaaaa", "étéétéété", "b" * 60, "ÿ" * 9, "zyxwvut" * 9]
    rows = [(None, "Abcabcab abcabcab"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "×÷abcdefgĀabcdefg")]
    for k in range(400):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                i = rng.randrange(len(w) + 1)
                w = rng.choice((w[:i] + rng.choice("abéZ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("aBc") + w[i + 1 :]))
            words.append(w)
        rows.append((k, rng.choice((" ", "-", "一", "1")).join(words)))
    chain = ["qwertyui", "qwertyuio", "qwertyuiop"]
    rows += [(1000 + k, f"{chain[0]}k " * 2 + f"{chain[0]} " * 30 + f"{chain[1]} " * 400 + f"{chain[2]} " * 5000) for k in range(2)]
    return rows


@pytest.mark.parametrize("block_words", [20_000, 5, 1])
def test_hard_words(spark, hard, block_words):
    df = spark.createDataFrame(hard, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("clash")).repartition(3)
    want = plain(hard)
    assert found(spelling.group_variants(df, block_words=block_words)) == want
    assert any(f is not None and r != f for _, f, r, *_ in want)


def test_empty_table(spark):
    assert found(spelling.group_variants(spark.createDataFrame([], "doc_id long, text string"))) == set()


@pytest.mark.parametrize("small", [0, 4, 48])
def test_blocks_find_each_pair_once(small):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 11))) for _ in range(900)} | {"ab" * 20, "ab" * 20 + "a", "a" * 40, "a" * 41, "b" + "a" * 40})
    blocks = defaultdict(list)
    for w in words:
        b = w.encode("latin-1")
        for m, lo, hi in spelling.first_blocks(b):
            blocks[m, lo, hi, spelling._key(b, m, lo, hi)].append(b)
    got = Counter()
    for (m, lo, hi, _), own in blocks.items():
        got.update(frozenset((own[i].decode(), own[j].decode())) for i, j in spelling.scan_block(own, m, lo, hi, small))
    near = plain_near(set(words))
    assert set(got.values()) == {1} and set(got) == {frozenset((a, b)) for a in words for b in near[a]}


def test_crc_of_runs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 300)
    ends = starts + rng.integers(0, 150, 300)
    first = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    assert spelling.run_crcs(data, starts, ends, first).tolist() == [zlib.crc32(data[s:e].tobytes(), int(f)) for s, e, f in zip(starts, ends, first, strict=True)]


def test_no_task_holds_a_hot_block(spark):
    """All words share their beginning: blocks are cut before they are dealt."""
    rng = random.Random(2)
    words = sorted({"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    scratch = Scratch(spark, "t")
    pairs = {frozenset((r["word"], r["near"])) for r in spelling.near_words(df, scratch, 100).collect()}
    near = plain_near(set(words))
    assert pairs == {frozenset((a, b)) for a in words for b in near[a]}
