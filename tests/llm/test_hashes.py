"""Words and windows whose polynomial hashes modulo a power of two are equal, whatever the base, must be told apart everywhere."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyseal.llm import common, jaccard_join, lm_scoring, packing, pieces, substring_dedup, token_files, tokens


def pattern(n, flip=False, letters="ab"):
    """The Thue-Morse word of n letters, or its complement."""
    return "".join(letters[(k.bit_count() & 1) ^ flip] for k in range(n))


PAIRS = [(pattern(n), pattern(n, True)) for n in (1024, 2048)]


@pytest.fixture(scope="module")
def twins():
    rows = []
    for one, other in PAIRS:
        for left, right in (("", ""), ("xxxxxxxx", "yyyyyyyy"), ("plain ", " words"), ("日本", "é")):
            rows += [left + one + right, left + other + right]
    return rows * 3


@pytest.fixture(scope="module")
def docs(spark, twins):
    return spark.createDataFrame(list(enumerate(twins)), "doc_id long, text string").repartition(2).cache()


@pytest.mark.parametrize("letters", ["ab", None])
def test_spans_of_patterns(letters):
    values = np.array([3, 5], np.uint64) if letters else np.random.default_rng(1).integers(0, 1 << 63, 2, np.uint64)
    for n in (1024, 2048, 4096):
        bits = np.array([k.bit_count() & 1 for k in range(n)])
        both = np.concatenate([values[bits], values[1 - bits]])
        a, b = common.span_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        for width in (1000, n):
            got = common.window_hashes(both, width)
            assert len(np.unique(got)) == len({tuple(both[i : i + width].tolist()) for i in range(len(got))})


def test_spans_equal_exactly_where_their_values_do():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2, 3000).astype(np.uint64)
    starts = rng.integers(0, 2900, 4000)
    ends = starts + rng.integers(0, 100, 4000)
    ends[:500] = starts[:500] + rng.integers(0, 12, 500)
    seen = {}
    for h, s, e in zip(common.span_hashes(values, starts, np.minimum(ends, 3000)).tolist(), starts, np.minimum(ends, 3000), strict=True):
        assert seen.setdefault(h, tuple(values[s:e])) == tuple(values[s:e])
    assert len(seen) == len({tuple(values[s:e]) for s, e in zip(starts, np.minimum(ends, 3000), strict=True)})
    assert len(common.window_hashes(values[:3], 4)) == 0 and common.window_hashes(values[:1], 1).tolist() == values[:1].tolist()


def test_keys_tell_spans_apart(twins):
    rng = random.Random(3)
    words = sorted({*twins, *("".join(rng.choice("ab\x00") for _ in range(rng.randrange(1, 40))) for _ in range(3000))})
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    a, b = common.span_keys(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(words)


def test_token_ids_of_twins(docs, twins, tmp_path):
    e = tokens.encoder(tokens.default_path("byte_bpe_50k.json")).tokenizer
    want = {k: [*e.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(twins)}
    got = {}
    for r in packing.pack(docs, with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {k: [i for _, x in sorted(v) for i in x] for k, v in got.items()} == want
    e = tokens.encoder(tokens.default_path("word_bpe_49k.json")).tokenizer
    token_files.write_tokens(docs, str(tmp_path / "ids"), files=2)
    assert {r["doc_id"]: r["ids"] for r in token_files.read_tokens(docs.sparkSession, str(tmp_path / "ids")).collect()} == {k: [*e.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(twins)}


def test_pieces_of_twins(twins):
    import sentencepiece

    path = pieces.default_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, at = pieces.piece_encoder(path).encode_texts([t.encode() for t in twins])
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(twins))] == [lib.encode(t) for t in twins]


def test_dedup_keeps_twins(spark):
    """34 equal words and then one of two twins: no window of 35 occurs twice."""
    common_words = " ".join(f"w{k}" for k in range(34))
    rows = [(2 * k + j, f"{common_words} {k} {common_words} {t}".replace(f"{common_words} {k} ", "")) for k, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(4), 0)
    again = spark.createDataFrame([*rows, (9, rows[0][1])], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(again).collect()}
    assert {k for k, v in out.items() if v[0]} == {0, 9} and out[9] == (35, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("shard_words", [240_000, 0])
def test_dedup_of_patterned_words(spark, shard_words):
    """Twins as patterns of words, not of letters: brute force over windows."""
    window = 35
    texts = [" ".join(pattern(n, f)) for n in (256, 512) for f in (False, True)] + [" ".join("ab" * 40), " ".join("b" + "ab" * 30), " ".join("abc" * 30)]
    at = {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - window + 1):
            at.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = [set() for _ in texts]
    for places in at.values():
        if len(places) > 1:
            for k, i in places:
                gone[k] |= set(range(i, i + window))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df, shard_words=shard_words).collect()}
    assert got == {k: len(g) for k, g in enumerate(gone)}


def test_dedup_refuses_short_windows(spark):
    with pytest.raises(ValueError, match="8 words"):
        substring_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=7)


def test_jaccard_links_no_twins(spark):
    rows = [(2 * k + j, f"{t} q r") for k, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    rows += [(10 + k, t) for k, t in enumerate(PAIRS[0])] + [(20 + k, " ".join(t)) for k, t in enumerate(PAIRS[0])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert linked == {(20, 21)} and got == {k: 20 if k == 21 else k for k, _ in rows}


def test_lm_knows_only_trained_twins(spark):
    train = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(train[0], PAIRS[0][0]), (train[1], PAIRS[1][0]), (held[0], PAIRS[0][1]), (held[1], PAIRS[1][0])]
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {train[0]: (2, 2), train[1]: (2, 2), held[0]: (2, 1), held[1]: (2, 2)}
