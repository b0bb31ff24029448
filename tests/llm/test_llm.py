"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and strange columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyseal.llm import jaccard_join, license_scan, lm_scoring, media, packing, pieces, quality_rules, registry, substring_dedup, token_files, tokens, topk

SF = "/root/testdata/sf0.001"


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)] + ["Ünï", "中文", "don't", "<|endoftext|>", "\x85", " "]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [prose(rng.choice([1, 2, 30, 60, 200])) for _ in range(60)]
    passage = prose(50)
    out += [f"{prose(40)} {passage}\n{prose(20)}" for _ in range(4)]
    long = prose(3000)
    out += [long, long, long.replace("w1 ", "x1 ", 5), " ".join(["spam ham"] * 200), "", "   ", None, "a", "a  a", "tail  ", "\n\nLead"]
    for _ in range(6):
        t = rng.choice(out[:60]).split(" ")
        t[len(t) // 2] = "changed"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, k, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, hits string").repartition(5)


def strange(spark):
    """Repeated ids, null ids and columns with the operators' own names."""
    t = " ".join(f"v{k}" for k in range(60))
    rows = [(1, t, "a", None), (1, t, "a", None), (None, t, None, "b"), (None, None, None, None), (2, "", "c", "d"), (3, t + " end", "e", "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, _row string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_registered():
    names = set(registry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(k) for k in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    from oracle import both

    ours, theirs = both(spark, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert ours == theirs and ours


# -- 1, 6: ids ------------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_library_ids(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path(name))
    raw = [(x or "").encode() for x in texts] + ["İΣς ǅ\xa0x é T\u0308 e\u0301".encode(), b"  lead", b"x" * 600]
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "a", "Ab", "don't", "I'LL", "e\u0301", "H\u0331", "\u0130", "\u212a", "\u037e", "\U0001f600", "...", "x" * 140, " !", "\x00", "\u0301"]
    raw += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))).encode() for _ in range(400)]
    e = tokens.LibraryEncoder(tokens.default_path(name))
    for _ in range(2):
        ids, at = e.encode_texts(raw)
        for k, x in enumerate(raw):
            assert ids[at[k] : at[k + 1]].tolist() == t.encode(x.decode(), add_special_tokens=False).ids
    e.store.most = 50  # a full store is emptied
    assert e.encode_texts(raw)[0].tolist() == e.encode_texts(raw[:3] + raw[3:])[0].tolist() == ids.tolist()


def test_chunk_store_holds_many():
    rng = np.random.default_rng(3)
    store, a, b = tokens.ChunkStore(), rng.integers(0, 1 << 16, 200_000, np.uint64), rng.integers(0, 16, 200_000, np.uint64)
    keys = np.unique(np.stack([a, b], 1), axis=0)
    for part in np.array_split(keys, 7):
        assert (store.find(part[:, 0], part[:, 1]) < 0).all()
        n = len(part)
        store.add(part[:, 0], part[:, 1], (part[:, 0] + part[:, 1]).astype(np.uint32), np.ones(n, np.int64), np.arange(n) % 5 > 0)
    at = store.find(keys[:, 0], keys[:, 1])
    shown = np.concatenate([np.arange(len(p)) % 5 > 0 for p in np.array_split(keys, 7)])
    assert ((at >= 0) == shown).all() and (store.ids(at[shown])[0] == (keys[:, 0] + keys[:, 1])[shown]).all()


def test_packing(spark, docs, texts):
    rows = packing.pack(docs, size=64, open_windows=4, min_piece=4, with_ids=True).collect()
    e = tokens.encoder(tokens.default_path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], np.uint32)) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for k, t in enumerate(texts):
        ids = [*e.encode_texts([(t or "").encode()])[0].tolist(), 0]
        got = sorted(by_doc[k], key=lambda r: r["start"])
        assert [x for r in got for x in r["ids"]] == ids and {r["doc_tokens"] for r in got} == {len(ids)}
    for got in by_seq.values():
        got.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in got] == [0, *np.cumsum([r["length"] for r in got])[:-1]] and sum(r["length"] for r in got) <= 64
    assert sum(r["length"] for r in rows) / (64 * len(by_seq)) > 0.9
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(strange(spark)).groupBy("doc_id").count().count() == 4


def test_token_files(spark, docs, texts, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_tokens(docs, path, files=4)
    back = token_files.read_tokens(spark, path)
    starts = {r["part"]: r["start"] for r in token_files.range_starts(back).collect()}
    rows = sorted(back.collect(), key=lambda r: r["doc_id"])
    at, e = 0, tokens.encoder(tokens.default_path("word_bpe_49k.json"))
    for r in rows:
        assert starts[r["part"]] + r["part_start"] == at and r["ids"] == [*e.encode_texts([(texts[r["doc_id"]] or "").encode()])[0].tolist(), 1]
        at += len(r["ids"])
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert [r["doc_id"] for r in back.where("doc_id = 7").collect()] == [7]
    token_files.write_tokens(strange(spark), str(tmp_path / "strange"), files=3)
    assert token_files.read_tokens(spark, str(tmp_path / "strange")).count() == 6


def test_token_files_grow_in_number(spark, monkeypatch):
    stored = spark.read.parquet(f"{SF}/documents.parquet")
    assert token_files.file_count(stored) == 8
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)
    assert token_files.file_count(stored) > 100
    assert token_files.file_count(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == 8  # of unknown size


def test_token_files_have_stripes_and_indexes(spark, tmp_path):
    """Stripes, row indexes and Bloom filters on the document id, as the files' own metadata tell, and reads that use them."""
    from pyarrow import orc

    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.randrange(10**9)}" for _ in range(60))) for k in range(24_000)]
    path = str(tmp_path / "ids")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, files=2, stripe_mb=1)
    files = sorted((tmp_path / "ids").glob("*.orc"))
    held = [orc.ORCFile(str(f)) for f in files]
    assert len(files) == 2 and all(f.row_index_stride == 1000 and f.nstripes > 1 for f in held) and sum(f.nrows for f in held) == 24_000
    # ids of a file ascend over its stripes, and each stripe can be read by itself
    for f in held:
        ids = [x for s in range(f.nstripes) for x in f.read_stripe(s, columns=["doc_id"]).column(0).to_pylist()]
        assert ids == sorted(ids)
    jvm, sc = spark._jvm, spark.sparkContext
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{files[0]}"), jvm.org.apache.orc.OrcFile.readerOptions(sc._jsc.hadoopConfiguration()))
    kinds = set()
    for s in reader.getStripes():
        footer = reader.rows().readStripeFooter(s)
        kinds |= {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
        assert footer.getColumns(1).getKind().toString() == "DIRECT_V2"  # integer run-length encoding
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and not any(k == "BLOOM_FILTER_UTF8" and c != 1 for c, k in kinds)
    back = token_files.read_tokens(spark, path).where("doc_id = 4321")
    assert "EqualTo(doc_id,4321)" in back._jdf.queryExecution().executedPlan().toString() and back.count() == 1


# -- 2 --------------------------------------------------------------------------

@pytest.mark.parametrize(("shard_words", "heavy", "most"), [(240_000, 2000, 9), (0, 1, 100_000), (0, 1, 1)])
def test_substring_dedup(docs, texts, shard_words, heavy, most, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    monkeypatch.setattr(substring_dedup, "MOST_HEAVY", most)
    window = 12
    words = {k: word_list(t) for k, t in enumerate(texts)}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, window=window, shard_words=shard_words, texts=True).collect()}
    for k, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        r = got[k]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(kept).hexdigest())
        assert r["text"] == (kept.decode() if False in keep else texts[k] or "") and (r["key"], r["hits"]) == (k, "x")


def test_substring_dedup_edges(spark):
    rows = substring_dedup.remove_repeats(strange(spark), texts=True).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (60, 60), (60, 60), (60, 60), (61, 60)]
    assert {r["key"] for r in rows} == {"a", None, "c", "e"}
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("n, period", [(36, 1), (37, 1), (38, 1), (37, 2), (38, 2), (38, 3)])
def test_substring_dedup_short_periods(spark, n, period):
    """One short text whose windows repeat a few words apart, alone and within unique words."""
    words = [f"p{k % period}" for k in range(n)]
    for lead in (0, 5):
        text = " ".join([*[f"a{k}" for k in range(lead)], *words, *[f"z{k}" for k in range(lead)]])
        r = substring_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), texts=True).first()
        assert (r["n_words"], r["n_removed"]) == (n + 2 * lead, n)


@pytest.mark.parametrize("shard_words", [240_000, 5000])
def test_substring_dedup_of_very_long_runs(spark, shard_words):
    """Two million times one word, and texts in which one phrase comes again and again between words of their own."""
    rng = random.Random(4)
    phrase = " ".join(f"p{k}" for k in range(12))
    between = lambda n: " ".join(f"{phrase} {' '.join(f'u{rng.randrange(10**9)}' for _ in range(8))}" for _ in range(n))
    one, two = between(400), between(400)
    middle = " ".join(one.split()[2000:2100])
    rows = [(1, "spam " * 2_000_000), (2, one), (3, f"{two} {middle}"), (4, "spam " * 34)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard_words=shard_words).collect()}
    assert got == {1: (2_000_000, 2_000_000), 2: (8000, 100), 3: (8100, 100), 4: (34, 0)}


def test_segments_that_repeat_a_window():
    rng = np.random.default_rng(5)
    for n, period in [(36, 1), (37, 2), (38, 3), (41, 6), (60, 9), (90, 40)]:
        for lead in (0, 7):
            h = np.concatenate([rng.integers(0, 1 << 63, lead, np.uint64), np.resize(rng.integers(0, 1 << 63, period, np.uint64), n), rng.integers(0, 1 << 63, lead, np.uint64)])
            anchors, segs, starts, counts, own = substring_dedup._segments(h, 35)
            for s, c, o in zip(starts, counts, own, strict=True):
                assert o == (len({h[i : i + 35].tobytes() for i in range(s, s + c)}) < c)


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(50):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        a.close()
        n = Counter(tuple(s[i : i + 4]) for s in seqs for i in range(len(s) - 3))
        for s in seqs:
            assert a.repeated(s, 4) == [n[tuple(s[i : i + 4])] > 1 for i in range(len(s) - 3)]


# -- 3, 4, 9 ----------------------------------------------------------------------

def test_license_scan(spark):
    rows = [(1, "x\nReleased under the MIT license!\ny"), (2, "released under the mit license"), (3, "MIT"), (4, None), (5, ""), (5, "Released under the MIT License."), (None, "Licensed under the Apache License, Version 2.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(9))
    got = sorted(map(tuple, license_scan.scan(df).collect()), key=repr)
    assert got == sorted([(1, 0, "mit", 0.8), (1, 2, "mit", 1.0), (2, 1, "mit", 1.0), (5, 1, "mit", 1.0), (None, 1, "apache-2.0", 1.0)], key=repr)
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_scan_reports_each_kind_of_line(spark):
    """Every licence line of the given documents, and every CC variant in both forms."""
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", "\n")).alias("text")).where("text rlike '^(Licensed|Released|This work is licensed) under '").distinct()
    kinds = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-short", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in license_scan.scan(lines.withColumn("doc_id", F.col("text"))).collect()}
    assert got == {k: (v, 1.0) for k, v in kinds.items()}
    cc = {k: v for k, v in license_scan.TEMPLATES.items() if k.startswith("cc-")}
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in license_scan.scan(spark.createDataFrame(list(cc.items()), "doc_id string, text string")).collect()}
    assert len(cc) == 12 and got == {k: (k, 1.0) for k in cc}


def test_license_scan_equals_sql_on_planted_notices(spark):
    """Notices on a line, wrapped, within lines, changed, twice, and next to each other, in texts of other words: the SQL says the same."""
    import textwrap

    import duckdb

    rng = random.Random(8)
    prose = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    rows = [(1, None), (2, ""), (3, "MIT"), (4, "license\n\nlicense")]
    for k, (_, text) in enumerate(license_scan.TEMPLATES.items()):
        words = text.split()
        if len(words) > 12:
            words[rng.randrange(len(words))] = "changed"
        other = rng.choice(list(license_scan.TEMPLATES.values()))
        wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(" ".join(words), rng.choice((72, 40, 30)), break_long_words=False))
        rows += [(10 * k + 10, text), (10 * k + 11, f"{prose(40)}\n{wrapped}\n{prose(30)}"), (10 * k + 12, f"{prose(20)} {text} {prose(20)} {other}\n{prose(5)}"), (10 * k + 13, f"{text} {other}\n{text}"), (10 * k + 13, wrapped), (None, f"{wrapped}\n{wrapped}\n{prose(60)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    theirs = sorted(con.sql(license_scan.sql()).fetchall(), key=repr)
    ours = sorted(map(tuple, license_scan.scan(df).collect()), key=repr)
    assert ours == theirs and len(ours) > 150


def test_license_scan_wrapped_notices(spark):
    """Notices wrapped over lines, or within a line, of longer texts; brute force over all word windows."""
    import textwrap

    rng = random.Random(3)
    prose = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    rows, want = [], {}
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        for width in (72, 30):
            wrapped = textwrap.wrap(text, width, break_long_words=False)
            key = f"{name}/{width}"
            rows.append((key, "\n".join([prose(100), *[f" * {x}" for x in wrapped], prose(100)])))
            want[key] = (name, 1.0, 2)
        rows.append((f"{name}/inside", f"{prose(100)} {text} {prose(100)}"))
        want[f"{name}/inside"] = (name, 1.0, 1)
    rows.append(("none", "\n".join(prose(12) for _ in range(20))))
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], r["dice"], r["line"]))
    assert "none" not in got and {k: v for k, v in want.items() if v not in got.get(k, ())} == {}
    # two notices one after the other, and one with words changed
    mit, isc = license_scan.TEMPLATES["mit-grant"].split(), license_scan.TEMPLATES["isc"].split()
    mit[20] = mit[40] = "changed"
    text = "\n".join([prose(300), *textwrap.wrap(" ".join(mit), 72), *textwrap.wrap(" ".join(isc), 72), prose(300)])
    own = {k: set(license_scan.bigram_set(t)) for k, t in license_scan.TEMPLATES.items() if k in ("mit-grant", "isc")}
    w = license_scan.normalised_words(text)
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    best = {k: max(2 * len(v & set(pairs[i:j])) / (len(v) + len(set(pairs[i:j]))) for i in range(290, len(pairs) - 290) for j in range(i + 1, min(i + 94, len(pairs)))) for k, v in own.items()}
    got = {r["license"]: r["dice"] for r in license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == best and best["mit-grant"] < 1


def test_media(spark, docs, texts):
    for r in media.digests(docs).collect():
        text = (texts[r["doc_id"]] or "").encode()
        pay = text.ljust(max(192, -(-len(text) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        stored = media.store(pay)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.load(stored) == (pay, media.RATE)
    assert media.digests(docs).where("n_bytes > 5000").groupBy("payload_sha256").agg(F.count_distinct("feature").alias("n")).where("n > 1").count() == 0
    assert media.digests(empty(spark)).count() == 0 and media.digests(strange(spark)).count() == 6
    table = media.tensor_table(media.features(docs.limit(4)).toArrow())
    assert table.schema.field("tensor").type.shape == [media.WINDOW, media.MELS] and table.num_rows >= 4


def test_media_digests_come_from_the_tensors(spark, docs, texts):
    kept = {}
    for r in media.features(docs).orderBy("doc_id", "window").collect():
        kept.setdefault(r["doc_id"], []).append(r)
    for r in media.digests(docs).collect():
        _, mel, found = media.analyse(media.store(media.payload((texts[r["doc_id"]] or "").encode())))
        rows = media.tensors(mel, found)
        assert rows.schema.field("tensor").type.shape == [media.WINDOW, media.MELS] and np.array_equal(media.frames_of(rows), mel)
        assert [[x[k] for k in ("window", "start_s", "end_s", "active_frames")] for x in kept[r["doc_id"]]] == [list(x.values())[:4] for x in rows.select(["window", "start_s", "end_s", "active_frames"]).to_pylist()]
        flat = np.array([y for x in kept[r["doc_id"]] for y in x["tensor"]], np.float32).reshape(-1, media.MELS)
        assert r["feature"].startswith(f"{len(mel)}x{media.MELS};{len(found)};{zlib.crc32(flat[: len(mel)].tobytes()):08x};") and not flat[len(mel) :].any()


def test_log_mel_equals_plain_arithmetic():
    """Convolution with the whole filter, frames one by one and triangles by hand; and blocks join without a seam."""
    rng = np.random.default_rng(3)
    for size in (192, 960, 5 * 192 * media.BLOCK // 2):
        samples = rng.integers(0, 256, size).astype(np.uint8)
        got = media.log_mel(samples)
        x = (samples.astype(np.float64) - 128) / 128
        half = 6 * media.DOWN
        n = np.arange(-half, half + 1)
        h = np.sinc(n / media.DOWN) * np.hamming(len(n)) * media.UP / media.DOWN
        wide = np.zeros(len(x) * media.UP)
        wide[:: media.UP] = x
        total = -(-len(x) * media.UP // media.DOWN)
        delay = media._PHASES.shape[1] * media.UP // 2
        y = np.concatenate([np.convolve(wide, h), np.zeros(4 * media.FRAME)])[delay :: media.DOWN][:total] if size < 10_000 else media.resample(x)
        assert np.allclose(y, media.resample(x), atol=1e-12)
        frames = -(-total // media.HOP) + 1
        y = np.concatenate([np.zeros(media.FRAME // 2), y, np.zeros(media.FRAME + media.HOP)])
        assert len(got) == frames
        mels = np.linspace(0, 2595 * np.log10(1 + media.RATE * media.UP / media.DOWN / 2 / 700), media.MELS + 2)
        hz = 700 * (10 ** (mels / 2595) - 1)
        f = np.arange(media.FFT // 2 + 1) * media.RATE * media.UP / media.DOWN / media.FFT
        for k in sorted({0, frames // 2, frames - 1, min(media.BLOCK - 1, frames - 1), min(media.BLOCK, frames - 1)}):
            power = np.abs(np.fft.fft(y[k * media.HOP : k * media.HOP + media.FRAME] * np.hanning(media.FRAME))[: media.FFT // 2 + 1]) ** 2
            band = [sum(p * max(0.0, min((a - lo) / (mid - lo), (hi - a) / (hi - mid))) for p, a in zip(power, f, strict=True)) for lo, mid, hi in zip(hz, hz[1:], hz[2:], strict=False)]
            assert np.abs(got[k] - np.log(np.array(band) + 1e-6)).max() < 0.0051


def test_media_features_tell_texts_apart(spark):
    """Every sample counts: texts that differ in their first letters, or their last, have features of their own."""
    texts = ["", "x y z", "X Y Z", "Reorea. Nd.", "a" + "b" * 222, "c" + "b" * 222, "b" * 222 + "a", "b" * 222 + "c", *[f"{w} is the word that these two hundred and some bytes begin with, and all of them go on alike " * 2 for w in ("this", "that", "what")]]
    rows = media.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r["feature"] for r in rows}) == len(texts)


def test_media_memory_of_long_texts():
    import tracemalloc

    text = b"some words " * 800_000
    tracemalloc.start()
    media.analyse(media.store(media.payload(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text) + (100 << 20)


def test_media_signal():
    t = np.arange(16_000) / 16_000
    y = media.resample(np.sin(2 * np.pi * 440 * t))
    assert len(y) == 12_000 and np.abs(np.fft.rfft(y[: 12_000])).argmax() == 440
    x = np.concatenate([np.zeros(50), np.ones(30), np.full(20, 0.18), np.zeros(50)])
    assert media.segments(x) == [(50, 100)]


def hard_texts(texts):
    rng = random.Random(9)
    parts = ["<s>", "<0x41>", " ", "  ", "    ", "\n", "\t", "\xa0", "\u3000", "\x00", "a", "Ab", "don't", "e\u0301", "ß", "日本", "\U0001f600", "...", "$$$", "x" * 100, " !", "he", "llo", " world", "aaaa", "  aaa"]
    return [t or "" for t in texts] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]


def test_pieces_are_the_library_ids(texts):
    """Of the shipped model, which merges by rank, by chunks and as one stream."""
    import sentencepiece

    path = pieces.default_path("piece_bpe_32k.model")
    lib, e, raw = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_encoder(path), hard_texts(texts) + ["a\u2581 b"]
    ids, at = e.encode_texts([t.encode() for t in raw])
    data, offs = e.model.decode_all(ids, at)
    for k, t in enumerate(raw):
        want = lib.encode(t)
        assert ids[at[k] : at[k + 1]].tolist() == want and data[offs[k] : offs[k + 1]].decode() == t.replace("\u2581", " ")
        if t:
            runs = list(pieces.stream_encode(e.model, iter(pieces.SPACE + t.replace(" ", pieces.SPACE)), every=5))  # blocks of one character
            assert [x for _, r in runs for x in r] == want


def test_pieces_of_a_unigram_model(texts, tmp_path):
    """The library's ids for a model of the shipped pieces with scores of their own; none is trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path("piece_bpe_32k.model"), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    rng = random.Random(2)
    for k, p in enumerate(spec.pieces):
        if p.type == 1:
            p.score = -(10 + k % 1000 + rng.randrange(1024)) / 1024 * len(p.piece) ** 0.5 // (1 / 1024) / 1024
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    lib, e, raw = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(pieces.PieceModel(path)), hard_texts(texts)
    ids, at = e.encode_texts([t.encode() for t in raw])
    data, offs = e.model.decode_all(ids, at)
    for k, t in enumerate(raw):
        assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t) and data[offs[k] : offs[k + 1]].decode() == t


def test_stream_keeps_a_bounded_window():
    """Ids are committed while a text without any certain boundary is read."""
    m = pieces.piece_encoder(pieces.default_path("piece_bpe_32k.model")).model
    read = 0

    def chars():
        nonlocal read
        for _ in range(5000):
            read += 2
            yield "ab"

    done = 0
    for ends, _ in pieces.stream_encode(m, chars()):
        done = ends[-1]
        assert read - done < 64 + 2 * m.longest
    assert done == 10_000


def test_pieces(spark, docs, texts):
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    got = pieces.decode(pieces.encode(docs), digest=True).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in enumerate(texts)}
    assert sorted(got) == sorted(pieces.round_trip(docs).collect())
    assert pieces.encode(empty(spark)).count() == 0 and pieces.decode(pieces.encode(strange(spark)), digest=True).count() == 6


# -- 5, 8 -------------------------------------------------------------------------

def test_lm_scoring(spark, docs, texts):
    rows = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, head=150).collect()}
    use = {k: zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(texts))}
    words = {k: [*(w.lower() for w in word_list(t)), b""] for k, t in enumerate(texts)}
    c = Counter(w for k, ws in words.items() if use[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in words.items():
        r = rows[k]
        base = sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not use[k], len(ws), sum(w in c for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert lm_scoring.score_texts(empty(spark)).count() == 0
    assert sorted(r["held_out"] for r in lm_scoring.score_texts(strange(spark)).select("held_out", "doc_id").where("doc_id is null").collect()) == [True, True]


def test_lm_edges(spark):
    """Without training documents the base; a long word that every document holds is no hot key."""
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    none = spark.createDataFrame([(k, "some words") for k in ids], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm_scoring.score_texts(none).collect()} == {(0, 0, 0.0, 0.0)}
    banner = "http://" + "x" * 80
    df = spark.createDataFrame([(k, f"{banner} a{k} b") for k in range(300)], "doc_id long, text string")
    rows = lm_scoring.score_texts(df, head=50).collect()
    n = sum(not r["held_out"] for r in rows)
    assert {(r["n_tokens"], r["n_known"]) for r in rows} == {(4, 4), (4, 3)} and {r["train_tokens"] for r in rows} == {4 * n}
    for r in rows:
        base = 3 * log10((n + 1) / (4 * n + n + 4)) + log10((1 if r["held_out"] else 2) / (4 * n + n + 4))
        assert abs(r["base_score"] - base) < 1e-9 and r["score"] > base


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(8)
    words = 30
    count = np.append(np.sort(rng.integers(1, 40, words))[::-1], 0).astype(np.float64)
    klass = np.append(rng.integers(0, lm_scoring.CLASSES, words), lm_scoring.CLASSES)
    klass[:-1][count[:-1] == 1] = lm_scoring.CLASSES
    tables = [rng.normal(0, 0.5, (64, lm_scoring.CLASSES + 1)) for _ in range(3)]
    return lm_scoring.Vocabulary(np.arange(words, dtype=np.uint64), np.ones(words, np.uint64), count, klass), lm_scoring.Model(tables, rng.normal(0, 0.5, lm_scoring.CLASSES + 1))


def brute_class_logs(model, ids):
    """Natural log of the probability of every class at every place of one text, by plain softmax."""
    out = []
    for k in range(len(ids)):
        one, two = (np.array([ids[k - d] if k >= d else -2]) for d in (1, 2))
        f = lm_scoring._features(one, two, model.rows)[:, 0]
        z = model.bias + sum(t[r] for t, r in zip(model.tables, f, strict=True))
        out.append(z - np.log(np.exp(z).sum()))
    return np.array(out)


def test_lm_score_equals_brute_force(small_model):
    from types import SimpleNamespace

    import pyarrow as pa

    v, model = small_model
    rng = random.Random(6)
    docs = [[rng.randrange(-1, 30) for _ in range(n)] for n in (1, 2, 3, 50, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array([0] * 5, pa.int32()), pa.array(docs, pa.list_(pa.int32()))], names=["key", "doc_id", "shard", "ids"])
    once, tail_mass = 0.4, 0.4 * (v.count[:-1] == 1).sum() + 7.0
    mass = {k: sum(c + 1 for c, x in zip(v.count[:-1], v.klass[:-1], strict=True) if x == k) for k in range(lm_scoring.CLASSES)}

    def in_class(w):
        return (once if v.count[w] == 1 else 1.0) / (tail_mass if v.count[w] == 1 else 1.0) if v.klass[w] == lm_scoring.CLASSES else (v.count[w] + 1) / mass[v.klass[w]]

    rows = [r for b in lm_scoring._score(iter([batch]), SimpleNamespace(value=v), SimpleNamespace(value=model), once, tail_mass) for r in b.to_pylist()]
    for r, ids in zip(rows, docs, strict=True):
        logs = brute_class_logs(model, ids)
        want = sum(logs[k][v.klass[w]] / np.log(10) + (log10(in_class(w)) if w >= 0 else 0) for k, w in enumerate(ids))
        assert abs(r["model"] - want) < 1e-6 * max(1, abs(want)) and r["n_tokens"] == len(ids) and r["head_known"] == sum(w >= 0 for w in ids)
    # all words and the unseen one (weight 7) together have probability 1
    for row in np.exp(brute_class_logs(model, docs[3])[:5]):
        empty_classes = sum(p for k, p in enumerate(row[:-1]) if not mass[k])
        assert abs(sum(row[v.klass[w]] * in_class(w) for w in range(30)) + row[-1] * 7.0 / tail_mass + empty_classes - 1) < 1e-9


def test_lm_gradient_is_the_derivative(small_model):
    v, model = small_model
    rng = np.random.default_rng(2)
    ids, offs = rng.integers(-1, 30, 300), np.array([0, 1, 120, 300])
    got = np.zeros((3, model.rows, lm_scoring.CLASSES + 1))
    lm_scoring.gradient(model, ids, offs, v.klass, got)

    def loss(m):
        return -sum(brute_class_logs(m, ids[a:b])[np.arange(b - a), v.klass[ids[a:b]]].sum() for a, b in zip(offs[:-1], offs[1:], strict=True))

    for k, row, c in [(int(rng.integers(3)), int(rng.integers(64)), int(rng.integers(49))) for _ in range(12)]:
        ends = []
        for d in (1e-4, -1e-4):
            tables = [t.copy() for t in model.tables]
            tables[k][row, c] += d
            ends.append(loss(lm_scoring.Model(tables, model.bias)))
        assert abs((ends[0] - ends[1]) / 2e-4 - got[k, row, c]) < 1e-4


def test_lm_does_not_depend_on_partitions(spark):
    """Held-out log10 a token above the base, and the same for 1, 16 and 64 partitions."""
    docs, means = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for parts in (1, 16, 64):
        got = lm_scoring.score_texts(docs.repartition(parts)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
        means.append(got["s"] / got["n"])
        assert means[-1] > got["b"] / got["n"] + 0.5
    assert max(means) - min(means) < 1e-5


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op8_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    model = quality_rules.train_on(spark, sf)
    assert quality_rules.RuleModel.from_json(model.to_json()) == model
    scores = [r["score"] for r in quality_rules.score(strange(spark), model).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    none = quality_rules.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_rules.score(strange(spark), none).collect()} == {0.5}


# -- 7, 10 ------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"hot_sets": 2, "group_tokens": 300}, {"hot_sets": 3, "group_sets": 4}])
def test_jaccard(docs, texts, options):
    sets = {}
    for k, t in enumerate(texts):
        w = [x.lower() for x in word_list(t)]
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 10 * i >= 9 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, **options).collect()}
    assert got == {k: (len(s), root(k)) for k, s in sets.items()}


def test_jaccard_of_form_letters(spark):
    """Letters of 20 shingles: 20,000 share 18 of them, which is no link; 3000 others share 19, which is."""
    import time

    common, other = " ".join(f"c{k}" for k in range(20)), " ".join(f"o{k}" for k in range(21))
    rows = [(k, f"{common} a{k} b{k}") for k in range(20_000)] + [(k, f"{other} z{k}") for k in range(20_000, 23_000)]
    began = time.time()
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), group_sets=1000).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: min(k, 20_000) for k in range(23_000)} and {r["n_shingles"] for r in got} == {20}
    assert time.time() - began < 120


def test_prefix_roles_lose_no_link():
    """For random sets over few tokens: of a linked pair the smaller has the first common token in its index prefix, the larger in its prefix."""
    rng = random.Random(12)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        met = 0
        for _ in range(4000):
            base = rng.sample(range(60), rng.randrange(1, 40))
            x, y = ({*base} - {*rng.sample(range(60), rng.randrange(4))} for _ in range(2))
            x, y = sorted((x, y), key=len)
            if x and den * len(x & y) >= num * len(x | y):
                first = min(x & y)
                met += 1
                assert sorted(x).index(first) < jaccard_join.index_length(len(x), num, den) and sorted(y).index(first) < jaccard_join.prefix_length(len(y), num, den)
        assert met > 100


def test_jaccard_edges(spark):
    rows = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(strange(spark)).collect()), key=repr)
    assert rows == sorted([(1, 1), (1, 1), (None, None), (None, None), (2, 2), (3, 1)], key=repr)
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def best_of(kept, asked, k):
    """Brute force over (id, vector) rows."""
    out = {}
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept if i != q and len(w) == len(v))[:k]
        out[q] = [(i + 1, j, -s) for i, (s, j) in enumerate(best)]
    return out


def found_by(rows):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in got.items()}


@pytest.mark.parametrize("options", [{}, {"shard_values": 120}, {"shard_values": 120, "slice_queries": 4, "most_boxes": 3}])
def test_topk_edges(spark, options):
    rng = random.Random(2)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25]) for _ in range(3)]) for k in range(300)] + [(900, None), (None, [1.0, 1.0, 1.0]), (920, [float("nan"), 0.0, 0.0]), (940, [None, 0.0, 0.0]), (960, [1.0, 2.0])]
    rows += [(20, [9.0, 9.0, 9.0]), (40, [-9.0, 9.0, 9.0]), (980, []), (981, []), (982, []), *[(1001 + k, [0.25, 0.25, 0.25]) for k in range(200)]]
    whole = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    kept = sorted((r["vec_id"], r["v"]) for r in whole.collect())
    asked = {}
    for k, v in kept:
        if k % 20 == 0:
            asked[k] = min(asked.get(k, v), v)
    got = found_by(topk.top_k(whole, whole.where("vec_id % 20 = 0"), k=5, **options).collect())
    want = {q: x for q, x in best_of(kept, asked, 5).items() if x}
    assert got == want and got[980] == [(1, 981, 0), (2, 982, 0)] and 960 not in got
    assert topk.top_k(whole.where("false"), whole.where("false")).count() == 0


def test_topk_of_large_components(spark):
    """Integers beyond 2^31 and beyond what floats hold are exact; what doesn't fit 64 bits raises."""
    rng = random.Random(4)
    rows = [(k, [rng.choice([2.0**40, 2.0**26, -(2.0**33), 1.0 / 64, 3.0]), rng.choice([1.0, -1.0 / 64, 0.0])]) for k in range(60)]
    rows = [(k, [x, y if abs(x) < 2.0**30 else y / 64]) for k, (x, y) in rows if k % 20 or abs(x) < 2.0**20]
    whole = topk.integer_vectors(spark.createDataFrame([*rows, (0, [2.0**40, 1.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<double>"))
    kept = sorted((r["vec_id"], r["v"]) for r in whole.collect())
    queries = whole.where("vec_id in (20, 40)")
    assert found_by(topk.top_k(whole, queries, k=7).collect()) == best_of(kept, {k: v for k, v in kept if k in (20, 40)}, 7)
    assert max(abs(x) for _, v in kept for x in v) == 2**46
    pair = topk.integer_vectors(spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<double>"))
    assert topk.top_k(pair, pair.where("vec_id = 0")).first()["score"] == 2**46 * 192 + 64 * 64 == 13510798882115584
    for bad in ([[1e300, 0.0]], [[2.0**57, 1.0]]):  # a component, a product
        df = spark.createDataFrame([(k, v) for k, v in enumerate(bad * 2)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(topk.integer_vectors(df), topk.integer_vectors(df).where("vec_id = 0")).collect()


def test_topk_visits_few_nodes_and_ships_vectors_once(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (40, 4))
    v = (centres[rng.integers(0, 40, 20_000)] + rng.integers(-5, 5, (20_000, 4))).astype(np.int64)
    tree, seen = topk.KDTree(v, np.arange(len(v))), []
    tree._leaf = lambda rows, s, *more: (seen.append(s.size), topk.KDTree._leaf(rows, s, *more))
    q, i, s = tree.search(v[:50], np.arange(50), np.full(50, topk.NONE + 1), 10)
    scores = v[:50] @ v.T
    scores[np.arange(50), np.arange(50)] = topk.NONE
    assert np.array_equal(np.sort(s.reshape(50, 10), 1), np.sort(np.partition(scores, -10, 1)[:, -10:], 1)) and sum(seen) < 50 * len(v) / 10
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v[:4000])], "vec_id long, v array<long>")
    few, many = (topk.top_k(df, df.where(f"vec_id % {m} = 0"), k=3, shard_values=2000)._jdf.queryExecution().optimizedPlan().toString().count("Generate") for m in (200, 4))
    assert few == many


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [df.count()]
    from tallyseal.llm.common import Scratch

    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, scratch.keep(stage(spark, df, sf), name)
        assert df.columns == before.columns or name == "packing"
        sizes.append(df.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[4]
    for _, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, strange(spark), sf)
        assert kept.columns == ["doc_id", "text", "key", "_row"]
        kept.count()


def test_stages_with_clashing_columns(spark):
    """Columns with the names that stages and operators use inside, or with strange ones, neither crash nor change what is kept."""
    import corpus_pipeline

    rows = [(1, " ".join(f"a{k}" for k in range(50)), 50), (2, " ".join(f"b{k}" for k in range(80)), 80), (3, " ".join(f"a{k}" for k in range(50)) + " end", 51), (4, "", 0), (4, None, None), (None, "x y z", 3)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    names = ["stats", "_stats", "score", "_score", "n_words", "n_removed", "kept_sha256", "row", "_row", "n", "key", "hits", "kept", "component_id", "set_id", "sid", "a.b", "c`d"]
    more = plain.select("*", *[F.lit(5).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:3]:
        base, got = stage(spark, plain, SF), stage(spark, more, SF)
        assert got.columns == more.columns
        assert sorted(map(tuple, got.select("doc_id", "text", "n_chars").collect()), key=repr) == sorted(map(tuple, base.collect()), key=repr), name
        assert {tuple(r)[3:] for r in got.collect()} <= {(5,) * len(names)}
    assert {r["doc_id"] for r in corpus_pipeline.substrings(spark, more, SF).collect()} == {2, 3, 4, None}
    with pytest.raises(ValueError, match="name the three"):
        substring_dedup.remove_repeats(more, texts=True)


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tallyseal.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077", applicationId="a", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_root(cluster)


def test_near_duplicates_without_a_key(spark):
    """Unlike texts under one id both stay, copies go whatever their ids, and the smallest id stays."""
    import corpus_pipeline

    t = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcd"}
    rows = [(5, t["a"], 1), (5, t["b"], 2), (3, t["b"] + " end", 3), (7, t["a"], 4), (None, t["c"], 5), (None, t["c"], 6), (None, t["d"], 7), (9, t["d"] + " end", 8), (4, None, 9), (4, "", 10), (None, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    got = sorted(r["n"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert got in ([1, 3, 5, 8, 9, 10, 11], [1, 3, 6, 8, 9, 10, 11])


def brute_score(model, stats):
    total = model.bias
    for weight, terms in model.rules:
        if all(stats[name] is not None and (stats[name] > bound if above else stats[name] <= bound) for name, above, bound in terms):
            total += weight
    return 1 / (1 + np.exp(-total))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() with its own parameters: documents of sf0.001 and planted near copies and passages around the limits."""
    import corpus_pipeline

    rng = random.Random(11)
    real = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = [t for t in real.values() if 80 <= len(word_list(t)) <= 400][:12]
    for t in base:
        w = t.split()
        for changed in (1, len(w) // 50, len(w) // 45, len(w) // 40, len(w) // 20):
            v = list(w)
            for k in rng.sample(range(len(v)), changed):
                v[k] = f"new{k}"
            real[max(real) + 1] = " ".join(v)
        for n in (34, 35, 36, len(w)):
            at = rng.randrange(len(w) - n + 1)
            real[max(real) + 1] = " ".join([*rng.choice(base).split()[:30], *w[at : at + n], *(f"own{n}x{k}" for k in range(60))])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame(list(real.items()), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    # quality: the rules of the model one by one, over the statistics of each text
    model = quality_rules.train_on(spark, str(tmp_path))
    stats = quality_rules.statistics(F.col("text"))
    measured = docs.select("doc_id", *[x.cast("double").alias(k) for k, x in stats.items()]).collect()
    scores = {r["doc_id"]: brute_score(model, r.asDict()) for r in measured}
    left = {k: t for k, t in real.items() if scores[k] >= 0.3}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()} == left and len(left) < len(real)

    # near duplicates: five words, 0.8
    sets = {}
    for k, t in left.items():
        w = [x.lower() for x in word_list(t)]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b]) if b < a else 0
            if i and 5 * i >= 4 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    single = {k: t for k, t in left.items() if root(k) == k}
    assert len(single) < len(left)

    # substrings: windows of 35 words
    words = {k: word_list(t) for k, t in single.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    kept = {}
    for k, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        if False not in keep:
            kept[k] = single[k]
        elif True in keep:
            kept[k] = b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()
    assert len(kept) < len(single) and any(kept[k] != single[k] for k in kept)

    # packing: all ids of each kept text, in pieces without gaps, in sequences of at most 1024
    e = tokens.encoder(tokens.default_path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == kept.keys()
    for k, t in kept.items():
        ids, at = [*e.encode_texts([t.encode()])[0].tolist(), 0], 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], np.uint32))
            at += r["length"]
        assert at == len(ids)
    for got in by_seq.values():
        got.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in got] == [0, *np.cumsum([r["length"] for r in got])[:-1]] and sum(r["length"] for r in got) <= 1024
