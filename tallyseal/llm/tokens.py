"""Encoding of whole texts with the tokenizers library, with a bounded store of chunks met before.

A chunk ends where every tokenization of the text must break: in front of a run of
white space. Ids of a text are its chunks' ids in a row, so each distinct chunk is
encoded once while the store holds it. Chunks are found, and looked up by 128-bit
keys, by numpy over a slice of texts; a key is the chunk itself up to 15 bytes, and
120 bits of its BLAKE2b digest beyond.

The result is the library's with add_special_tokens=False: strings of special tokens
in a text become those tokens, as the library has it.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tallyseal.llm.common import LOWER, SPACE, mix, span_keys

#: Characters beyond ASCII that are white space, by their UTF-8 bytes (fixed values of Unicode).
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_TWO = np.array([int.from_bytes(x) for x in WIDE_SPACES if len(x) == 2], np.uint32)
_THREE = np.array([int.from_bytes(x) for x in WIDE_SPACES if len(x) == 3], np.uint32)
#: In a key: the chunk's letter case was kept.
_AS_IT_IS = np.uint64(1 << 63)


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of spans in a row."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def space_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of white space characters, those beyond ASCII included."""
    out = SPACE[data]
    if len(data) > 1 and (data >= 0x80).any():
        at = np.flatnonzero(data[:-1] == 0xC2)
        at = at[np.isin(data[at].astype(np.uint32) << 8 | data[at + 1], _TWO)]
        out[at] = out[at + 1] = True
        at = np.flatnonzero((data[:-1] >= 0xE1) & (data[:-1] <= 0xE3))
        at = at[at + 2 < len(data)]
        at = at[np.isin(data[at].astype(np.uint32) << 16 | data[at + 1].astype(np.uint32) << 8 | data[at + 2], _THREE)]
        out[at] = out[at + 1] = out[at + 2] = True
    return out


def glued_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that together are the texts: white space and what follows it."""
    begin = np.zeros(len(data), bool)
    unsure = space | ((data >= 0x1C) & (data <= 0x1F))  # white space to some libraries
    begin[1:] = space[1:] & ~unsure[:-1]
    begin[offs[:-1][offs[:-1] < offs[1:]]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], len(data))[: len(starts)]


def bare_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space."""
    inside = ~space
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    begin[first] = inside[first]
    last = first[1:] - 1
    stop[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


class ChunkStore:
    """Ids of chunks by key: an open-addressing table of entry numbers, and flat ids."""

    def __init__(self, most: int = 1_500_000, most_ids: int = 8_000_000):
        self.most, self.most_ids = most, most_ids
        self.clear()

    def clear(self) -> None:
        self.count = self.size = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.a, self.b = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.shown = np.zeros(1 << 14, bool)
        self.flat = np.zeros(1 << 16, np.uint32)

    def full(self) -> bool:
        return self.count > self.most or self.size > self.most_ids

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a ^ (b * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        slot, mask = self._slot(a, b), len(self.slots) - 1
        out = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[(self.a[out[open_]] != a[open_]) | (self.b[out[open_]] != b[open_])]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            got = self.slots[slot[open_]].astype(np.int64)
            out[open_] = got
            open_ = open_[(got >= 0) & ((self.a[got] != a[open_]) | (self.b[got] != b[open_]))]
        return out

    def _place(self, entries: np.ndarray) -> None:
        """Distinct keys that aren't in the table: each round the free slots take one entry each."""
        slot, mask = self._slot(self.a[entries], self.b[entries]), len(self.slots) - 1
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, lens: np.ndarray, shown: np.ndarray) -> np.ndarray:
        """Entry numbers of new chunks; those that aren't shown are not found again."""
        n, m = len(a), len(ids)
        while self.size + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.a):
            for k in ("a", "b", "starts", "lens", "shown"):
                setattr(self, k, np.concatenate([getattr(self, k), np.zeros_like(getattr(self, k))]))
        entries = np.arange(self.count, self.count + n)
        self.flat[self.size : self.size + m] = ids
        self.a[entries], self.b[entries], self.lens[entries], self.shown[entries] = a, b, lens, shown
        self.starts[entries] = self.size + np.cumsum(lens) - lens
        self.size += m
        self.count += n
        if self.count * 2 > len(self.slots):
            while self.count * 2 > len(self.slots):
                self.slots = np.full(len(self.slots) * 2, -1, np.int32)
            self._place(np.flatnonzero(self.shown[: self.count]))
        else:
            self._place(entries[shown])
        return entries

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset of each entry's first (one more than entries)."""
        lens = self.lens[entries].astype(np.int64)
        return self.flat[gather(self.starts[entries], lens)], np.concatenate([[0], np.cumsum(lens)])


class ChunkEncoder:
    """encode(data, offs) gives the ids of all texts in a row and the offset of each text's first id. Subclasses say how chunks are found and learnt."""

    LONG = 128  # longer chunks are encoded each time

    def __init__(self):
        self.store = ChunkStore()

    def chunks(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """(bytes to look up, starts, ends, chunks whose key must not meet those of others or None)."""
        raise NotImplementedError

    def learn(self, chunks: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row and the number of each."""
        raise NotImplementedError

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_spans(data, offs, offs)

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))

    def encode_spans(self, data: np.ndarray, offs: np.ndarray, ends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ends_at: the texts' offsets in the bytes that chunks() gives."""
        store = self.store
        if store.full():
            store.clear()
        src, starts, ends, odd = self.chunks(data, offs)
        a, b = span_keys(src, starts, ends)
        if odd is not None:
            b[odd] |= _AS_IT_IS
        at = store.find(a, b)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            order = missing[np.lexsort((b[missing], a[missing]))]
            first = np.ones(len(order), bool)
            first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            new = order[first]
            raw = src.tobytes()
            pieces = [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ids, lens = self.learn(pieces, np.zeros(len(new), bool) if odd is None else odd[new])
            entries = store.add(a[new], b[new], ids, lens, ends[new] - starts[new] <= self.LONG)
            at[order] = entries[np.cumsum(first) - 1]
        ids, cuts = store.ids(at)
        return ids, cuts[np.searchsorted(starts, ends_at)]


def _grouped(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ids, lens) of several lists of chunks to ids and lens in the order of the places."""
    lens, starts, flat, size = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
    for places, ids, counts in parts:
        lens[places] = counts
        starts[places] = size + np.cumsum(counts) - counts
        flat.append(ids)
        size += len(ids)
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint32))[gather(starts, lens)], lens


class LibraryEncoder(ChunkEncoder):
    """Of a file of the tokenizers library: byte-level ones and ones that drop white space."""

    MOST_PIECES = 200_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizers = json.dumps(spec.get("normalizer"))
        drops_space = '"Removed"' in json.dumps(spec.get("pre_tokenizer")) and "\\\\s+" in normalizers
        byte_level = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        if not drops_space and not (byte_level and not spec["pre_tokenizer"].get("add_prefix_space")):
            raise ValueError("chunks are known for byte-level and white-space-dropping tokenizers only")
        added = spec.get("added_tokens") or []
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] or len(x["content"].encode()) < 2 or len(x["content"].split()) != 1 for x in added):
            raise ValueError("chunks are known for added tokens that are matched as they are only")
        self.heads = sorted({x["content"].encode()[:2] for x in added})  # a chunk with one of these may hold an added token
        self.spans = bare_spans if drops_space else glued_spans
        self.widths = None
        if byte_level:
            self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, k in spec["model"]["vocab"].items():
                self.widths[k] = len(token)  # one character a byte
            for x in added:
                self.widths[x["id"]] = len(x["content"].encode())
        self.pieces, self.lower, self.marks = None, False, False
        if drops_space:
            import regex

            kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
            split = spec["pre_tokenizer"]["pretokenizers"][0]
            if kinds == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["invert"]:
                self.pieces = regex.compile(split["pattern"]["Regex"]).findall
                self.lower = True  # A-Z may be lowered before chunks are looked up
                self.marks = all(self.pieces("ab" + m) == ["ab", m] for m in (*".,;:!?", ".,;:!?", "?!:;,."))
        self.piece_ids: dict[bytes, list[int]] = {}

    def chunks(self, data, offs):
        starts, ends = self.spans(data, offs, space_mask(data))
        if not self.lower:
            return data, starts, ends, None
        # added tokens and marks of U+0300-036F, which may compose with one case of a letter only, keep their letters
        at = np.flatnonzero((data == 0xCC) | (data == 0xCD)) if (data >= 0x80).any() else np.zeros(0, np.int64)
        heads = [np.flatnonzero((data[:-1] == h[0]) & (data[1:] == h[1])) for h in self.heads]
        at = np.concatenate([at, *heads])
        src = LOWER[data]
        if not len(at):
            return src, starts, ends, None
        odd = np.zeros(len(starts), bool)
        owner = np.searchsorted(starts, at, "right") - 1
        odd[owner[owner >= 0]] = True
        where = gather(starts[odd], ends[odd] - starts[odd])
        src[where] = data[where]
        return src, starts, ends, odd

    def learn(self, chunks, odd):
        joint, apart, parts, wide = [], [], [], tuple(WIDE_SPACES)
        if self.widths is not None:  # chunks that begin with a space and end without one break off by themselves
            for k, c in enumerate(chunks):
                (joint if c[:1] == b" " and c[-1] > 0x20 and len(c) <= self.LONG and (c[-1] < 0x80 or not c.endswith(wide)) else apart).append(k)
        elif self.pieces is not None:
            apart = self._learn_pieces(chunks, odd, parts)
        else:
            apart = list(range(len(chunks)))
        encode = self.tokenizer.encode_batch_fast
        for i in range(0, len(joint), 4000):
            part = [chunks[k] for k in joint[i : i + 4000]]
            ids = np.array(encode([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(c) for c in part]), "left") + 1
            parts.append((np.array(joint[i : i + 4000]), ids, np.diff(ends, prepend=0)))
        for i in range(0, len(apart), 4000):
            got = [e.ids for e in encode([chunks[k].decode() for k in apart[i : i + 4000]], add_special_tokens=False)]
            parts.append((np.array(apart[i : i + 4000]), np.array([k for x in got for k in x], np.uint32), np.array([len(x) for x in got], np.int64)))
        return _grouped(parts, len(chunks))

    def _learn_pieces(self, chunks: list[bytes], odd: np.ndarray, parts: list) -> list[int]:
        """Chunks of letters below U+0250 by the words that the tokenizer's own pattern finds in them, each given to its model once; the places of others are returned."""
        if len(self.piece_ids) > self.MOST_PIECES:
            self.piece_ids.clear()
        known, tokenize = self.piece_ids, self.tokenizer.model.tokenize
        done, flat, lens, rest = [], [], [], []
        for k, (c, own) in enumerate(zip(chunks, odd.tolist(), strict=True)):
            n = len(flat)
            if own or len(c) > self.LONG:
                rest.append(k)
                continue
            word = c.rstrip(b".,;:!?") if self.marks else c
            if word.isalpha():  # ASCII letters: one word, and the marks behind it another
                for piece in (word, c[len(word) :]) if len(word) < len(c) else (word,):
                    ids = known.get(piece)
                    if ids is None:
                        ids = known[piece] = [t.id for t in tokenize(piece.decode().lower())]
                    flat += ids
            else:
                text = c.decode()
                if not c.isascii() and max(text) > "ɏ":
                    rest.append(k)
                    continue
                for piece in self.pieces(text.lower()):  # NFC leaves characters below U+0250 alone
                    raw = piece.encode()
                    ids = known.get(raw)
                    if ids is None:
                        ids = known[raw] = [t.id for t in tokenize(raw.decode("latin-1").translate(_BYTE_CHARS))]
                    flat += ids
            done.append(k)
            lens.append(len(flat) - n)
        if done:
            parts.append((np.array(done), np.array(flat, np.uint32), np.array(lens, np.int64)))
        return rest


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_runs(batch, encode: ChunkEncoder, end_id: int):
    """(first row, end row, ids, offsets) of slices of a batch; each text's ids end with end_id."""
    from tallyseal.llm.common import text_slices

    for i, j, data, offs in text_slices(batch):
        ids, firsts = encode.encode(data, offs)
        out = np.full(len(ids) + (j - i), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[firsts[1:] + np.arange(j - i)] = False
        out[keep] = ids
        yield i, j, out, firsts + np.arange(j - i + 1)
