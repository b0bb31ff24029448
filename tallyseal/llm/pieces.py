"""SentencePiece encoding and decoding by streaming Viterbi.

The encoder reads a text in blocks and holds a window of the longest piece ahead and
the back-pointers since the last commit; whenever all surviving back-pointer paths meet
in one boundary, the ids up to it are committed.

Unigram models: the best path has the greatest sum of piece scores; equal sums go to
the longer last piece. Merge models: their scores are ranks, not probabilities, so a
path's weight is whether each two neighbours stay apart when their text is merged by
rank (0 if so, minus infinity otherwise). A row of pieces is what rank-order merging
gives for its text just where all neighbours stay apart, so one path has weight 0 and
the ids are the library's. Characters without a piece become their byte pieces.

Texts are looked up by chunks that no piece reaches out of; a slice's distinct chunks
that the store doesn't know go through the encoder as one stream.

Edge cases: null and empty texts give no ids and decode to an empty text; every text
without U+2581 comes back byte for byte; null ids and repeated rows are carried through;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseal.llm.common import arrow_map, text_slices
from tallyseal.llm.tokens import ChunkEncoder, default_path, gather

SPACE = "▁"
SLICE_IDS = 1 << 18
MERGES = 2  # fixed value of the format: model type of merge models


class PieceModel:
    MOST_PAIRS = 250_000

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(sp.serialized_model_proto())
        kind = spec.normalizer_spec
        if kind.precompiled_charsmap or kind.remove_extra_whitespaces or not kind.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are behind one space are known")
        self.ranked = spec.trainer_spec.model_type == MERGES
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        byte_of = {k: int(self.pieces[k][3:5], 16) for k in range(n) if sp.is_byte(k)}
        self.byte_id = {v: k for k, v in byte_of.items()}
        normal = {self.pieces[k]: (k, sp.get_score(k)) for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, normal))
        self.fallback = min(s for _, s in normal.values()) - 10.0
        self.rank = {p: s for p, (_, s) in normal.items()}
        self.apart: dict[int, bool] = {}
        self.trie: dict = {}
        self.scores = [sp.get_score(k) for k in range(n)]
        nodes = {"": self.trie}  # a node has (child, piece or -1) by character
        for p in sorted({p[:k] for p in normal for k in range(1, len(p) + 1)}):
            nodes[p] = {}
            nodes[p[:-1]][p[-1]] = (nodes[p], normal[p][0] if p in normal else -1)
        self.stranger = next(c for c in map(chr, range(0x10FFFD, 0x100000, -1)) if c not in self.trie)
        # joined[x, y]: a piece may reach over the boundary of these two bytes (beyond ASCII: taken as true, but for a space behind)
        self.joined = np.zeros((256, 256), bool)
        self.joined[0x80:] = self.joined[:, 0x80:] = True
        for pair in {x for p in normal for x in zip(p.replace(SPACE, " "), p[1:].replace(SPACE, " "), strict=False) if max(x) < "\x80"}:
            self.joined[ord(pair[0]), ord(pair[1])] = True
        self.joined[0x80:, 0x20] = any(re.search(f"[^\\x00-\\x7f{SPACE}]{SPACE}", p) for p in normal)
        self.joined = self.joined.ravel()
        raw = [bytes([byte_of[k]]) if k in byte_of else b" \xe2\x81\x87 " if k == self.unknown else p.replace(SPACE, " ").encode() if p in normal else b"" for k, p in enumerate(self.pieces)]
        self.widths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging in rank order, leftmost first."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                found = rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, before: int, piece: int) -> bool:
        """Does merging leave piece whole, and apart from the one before (-1: none that it could merge with)?"""
        key = before << 24 | piece
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= self.MOST_PAIRS:
                self.apart.clear()
            own = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
            found = self.apart[key] = self.merged("".join(own)) == own
        return found

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of runs of ids in a row, and their offsets; bytes that are no UTF-8 become U+FFFD."""
        lens = self.widths[ids]
        data = self.raw[gather(self.starts[ids], lens)]
        offs = np.concatenate([[0], np.cumsum(lens)])[cuts]
        lead = offs[:-1][offs[:-1] < offs[1:]]
        lead = lead[data[lead] == 0x20]  # the space that stands before every text
        keep = np.ones(len(data), bool)
        keep[lead] = False
        offs = offs - np.searchsorted(lead, offs)
        raw = data[keep].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            raw, offs = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return raw, offs.astype(np.int64)


def stream_encode(model: PieceModel, blocks: Iterator[str], every: int = 64) -> Iterator[tuple[list[int], list[int]]]:
    """Committed runs of (end positions, ids) of the text that comes in blocks. What is held reaches from the last commit to the longest piece ahead."""
    trie, ranked, fallback, longest = model.trie, model.ranked, model.fallback, model.longest
    apart, stays, scores, origin = model.apart, model.stays, model.scores, -1 if model.ranked else 0.0
    text, base, at, done, far, more = "", 0, 0, 0, 0, True  # base: position of text[0]; far: the farthest end of a piece that begins before at
    state, piece, back = [origin], [-1], [-1]  # of a position: last piece or sum, last piece (-1: a character without one), and where in the whole text that begins (-1: not reached)
    while True:
        if more and len(text) - at < longest:
            text, base, at, far = text[done:], base + done, at - done, far - done
            state, piece, back, done = state[done:], piece[done:], back[done:], 0
            while more and len(text) - at < longest:
                block = next(blocks, None)
                if block is None:
                    more = False
                else:
                    text += block
                    state += [origin] * len(block)
                    piece += [-1] * len(block)
                    back += [-1] * len(block)
            n = len(text)
        if at == n:
            break
        own, node, j = state[at], trie, at
        alone = True  # the character has no piece of its own
        while j < n:
            entry = node.get(text[j])
            if entry is None:
                break
            node, k = entry
            j += 1
            if k < 0:
                continue
            if j - at == 1:
                alone = False
            if j > far:
                far = j
            if ranked:
                if back[j] < 0:
                    good = apart.get(own << 24 | k)
                    if stays(own, k) if good is None else good:
                        state[j], piece[j], back[j] = k, k, base + at
            else:
                total = own + scores[k]
                if back[j] < 0 or total > state[j]:
                    state[j], piece[j], back[j] = total, k, base + at
        at += 1
        if alone and (back[at] < 0 or (not ranked and own + fallback > state[at])):
            state[at], piece[at], back[at] = -1 if ranked else own + fallback, -1, base + at - 1
            far = max(far, at)
        if far == at:  # every path goes through this position, and nothing merges across
            yield _path(model, text, piece, back, done, at, base)
            done, state[at] = at, origin
        elif (at - done) % every == 0:
            ends = {at, *(k for k in range(at + 1, far + 1) if back[k] >= 0)}
            while len(ends) > 1 and max(ends) > done:
                last = max(ends)
                ends.discard(last)
                ends.add(back[last] - base)
            meet = ends.pop()
            if meet > done:
                yield _path(model, text, piece, back, done, meet, base)
                done = meet


def _path(model: PieceModel, text: str, piece: list[int], back: list[int], start: int, end: int, base: int) -> tuple[list[int], list[int]]:
    ends, ids = [], []
    while end > start:
        if piece[end] >= 0:
            ends.append(base + end)
            ids.append(piece[end])
        else:
            own = [model.byte_id[b] for b in text[end - 1].encode()] if model.byte_id else [model.unknown]
            ends += [base + end] * len(own)
            ids += own[::-1]
        end = back[end] - base
    return ends[::-1], ids[::-1]


class PieceEncoder(ChunkEncoder):
    """Ids of texts; a text is its chunks behind one space."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def chunks(self, data, offs):
        lead = offs[:-1][offs[:-1] < offs[1:]]
        src = np.insert(data, lead, 0x20)
        begin = np.ones(len(src), bool)
        begin[1:] = ~self.model.joined[src[:-1].astype(np.uint16) << 8 | src[1:]]
        if (src == 0xE2).any():  # a mark of a space in the text counts as one
            mark = np.flatnonzero((src[:-2] == 0xE2) & (src[1:-1] == 0x96) & (src[2:] == 0x81))
            begin[mark] = begin[mark[mark + 3 < len(src)] + 3] = False
        begin[lead + np.arange(len(lead))] = True
        starts = np.flatnonzero(begin)
        return src, starts, np.append(starts[1:], len(src))[: len(starts)], None

    def encode(self, data, offs):
        more = np.concatenate([[0], np.cumsum(offs[:-1] < offs[1:])])
        return self.encode_spans(data, offs, offs + more)

    def learn(self, chunks, odd):
        """The chunks as one stream, a character without a piece between those that could merge."""
        texts, n = [c.decode().replace(" ", SPACE) for c in chunks], len(chunks)
        parted = np.array([k > 0 and (t[0] != SPACE or texts[k - 1][-1] == SPACE) for k, t in enumerate(texts)], np.int64)
        ends, ids = [], []
        stream = "".join([self.model.stranger + t if p else t for t, p in zip(texts, parted.tolist(), strict=True)])
        for e, i in stream_encode(self.model, (stream[k : k + 4096] for k in range(0, len(stream), 4096))):
            ends += e
            ids += i
        lens = np.array([len(t) for t in texts], np.int64)
        stops, at = np.cumsum(lens + parted), np.array(ends, np.int64)
        left, right = np.searchsorted(at, stops - lens, "right"), np.searchsorted(at, stops, "right")
        return np.array(ids, np.uint32)[gather(left, right - left)], right - left


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(PieceModel(path))
    return _encoders[path]


TEXT, IDS, DIGEST = "doc_id long, text string", "doc_id long, ids array<int>", "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string"


def _encode(batches, path: str) -> Iterator[pa.RecordBatch]:
    encoder = piece_encoder(path)
    for batch in batches:
        for i, j, data, offs in text_slices(batch):
            ids, cuts = encoder.encode(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])


def _decode(batches, path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    model = piece_encoder(path).model

    def part(names, ids, cuts):
        raw, offs = model.decode_all(ids, cuts)
        if not digest:
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(offs), pa.py_buffer(raw)]).cast(pa.large_string()).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, texts], names=["doc_id", "text"])
        words, at, ends = ids.astype(np.uint32), cuts.tolist(), offs.tolist()
        sums = [zlib.crc32(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        marks = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([names, pa.array(np.diff(cuts)), pa.array(sums, pa.int64()), pa.array(marks, pa.string())], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    for batch in batches:
        lists = batch.column(1)
        cuts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
        ids, i = np.asarray(lists.flatten()), 0
        while i < len(lists):  # some ids at a time
            j = min(max(int(np.searchsorted(cuts, cuts[i] + SLICE_IDS, "right")) - 1, i + 1), len(lists))
            yield part(batch.column(0).slice(i, j - i), ids[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
            i = j


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids)."""
    path = model or default_path("piece_bpe_32k.model")
    return arrow_map(_texts(docs), lambda it: _encode(it, path), IDS)


def decode(rows: DataFrame, *, model: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, ids) to (doc_id, text), or with digest to counts and checksums of both forms. Null ids are none."""
    path = model or default_path("piece_bpe_32k.model")
    return arrow_map(rows.select("doc_id", "ids"), lambda it: _decode(it, path, digest), DIGEST if digest else TEXT)


def round_trip(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """decode(encode(docs), digest=True) in one pass, so that a worker holds the model once."""
    path = model or default_path("piece_bpe_32k.model")
    return arrow_map(_texts(docs), lambda it: _decode(_encode(it, path), path, True), DIGEST)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
