"""BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut into words by the byte-level pre-tokenizer's rule, for whole slices at once in numpy. The distinct words
that a task has not met yet are sorted, so that going through them is a depth-first walk of their trie, and a stack
holds one state for each prefix on the way: the last token of the prefix's encoding. Prefixes that words share are
encoded once. The state of a prefix follows from shorter ones, because a BPE encoding is the one sequence of tokens in which
every neighbouring pair encodes to itself: the last token is the suffix that is a token and forms such a pair with the
state where it begins. An encoding is read back along the states.

The special tokens of the file are single tokens wherever their strings stand in a text, as the tokenizers library has it.

Nulls and edge cases: a null text counts as empty and has no tokens; rows with a null doc_id take no part; a text's bytes that
are not valid UTF-8 are read as U+FFFD. Repeated rows get a row each. Known words are found by 64-bit hashes: among a million that a worker keeps, a new word has a chance of 5e-14 to be
taken for another. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.shared import Slice, map_slices
from lodestone.llm.textops import span_hashes

#: Distinct words that a worker keeps before it starts anew; more only if a single slice has more.
CACHE = 1 << 20
#: Pairs of tokens that a worker remembers the verdict on.
PAIRS = 1 << 19
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, by Unicode's categories and properties."""
    global _classes
    if _classes is None:
        by_category = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
        _classes = np.array([by_category.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
        _classes[[*range(9, 14), 0x85]] = _SPACE  # the control characters among white space
    return _classes


def cut(part: Slice, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of a slice's words, and the offsets of its documents in them."""
    raw = part.buf.tobytes()
    segments, inside = part.offsets, []
    for special in specials:
        at = raw.find(special)
        while at >= 0:
            inside.append((at, at + len(special)))
            at = raw.find(special, at + len(special))
    if inside:
        doc = np.searchsorted(part.offsets, [a for a, _ in inside], side="right")
        inside = [(a, b) for (a, b), d in zip(inside, doc, strict=True) if b <= part.offsets[d]]
        segments = np.unique(np.concatenate([part.offsets, *inside]).astype(np.int64))
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    byte = np.concatenate([[0], np.cumsum(width)])
    kind = char_classes()[points]
    ends = np.searchsorted(byte, segments)  # code points where segments begin or end
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends[ends < n]] = True
    space, blank = kind == _SPACE, points == 32
    last_of_segment = np.zeros(n, bool)
    last_of_segment[ends[ends > 0] - 1] = True
    start = first.copy()
    run_end = np.ones(n, bool)
    run_end[:-1] = first[1:]
    before_text = space & run_end & ~last_of_segment  # the last white space of a run that text follows
    start |= before_text
    joins = np.flatnonzero(before_text & blank) + 1  # a blank belongs to the run that follows
    start[joins] = False
    quote = np.flatnonzero((points == 39) & start & run_end & ~last_of_segment)
    if len(quote):
        ahead = [np.where(quote + j < n, points[np.minimum(quote + j, n - 1)], 0) for j in (1, 2)]
        same = ~last_of_segment[np.minimum(quote + 1, n - 1)]
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = same & np.any([(ahead[0] == ord(a)) & (ahead[1] == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] |= ~(blank[after[after < n] - 1])
    for a, b in inside:
        start[np.searchsorted(byte, a) + 1 : np.searchsorted(byte, b)] = False
    at = np.flatnonzero(start)
    return byte[at], byte[np.append(at[1:], n)], np.searchsorted(byte[at], part.offsets)


class Bpe:
    """A byte-level BPE vocabulary, from the JSON text of a tokenizers file, and what has been encoded so far."""

    def __init__(self, text: str):
        model = json.loads(text)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        of_char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        raw = lambda token: bytes(of_char[c] for c in token)
        self.special = {x["content"].encode(): x["id"] for x in model["added_tokens"] if x["special"]}
        self.ids = {raw(token): i for token, i in model["model"]["vocab"].items() if token.encode() not in self.special}
        self.rank = {}
        for k, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[raw(a), raw(b)] = k
        self.suffixes = {t[i:] for t in self.ids for i in range(len(t))}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        size = max(self.bytes) + 1
        self.byte_length = np.array([len(self.bytes.get(i, b"")) for i in range(size)])
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_length)])
        self.all_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self, words: int = 0) -> None:
        """Forgets all words, and makes room for CACHE of them or as many as asked for."""
        self.room = max(CACHE, 1 << int(words + len(self.special)).bit_length())
        self.slot_key, self.slot_entry = np.zeros(4 * self.room, np.uint64), np.full(4 * self.room, -1, np.int32)
        self.entries, self.at, self.length = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0
        self._keep([list(self.special.values())[i : i + 1] for i in range(len(self.special))], np.array([span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for t in self.special], np.uint64))

    def merged(self, text: bytes) -> list[bytes]:
        """The encoding of a few bytes by merging the lowest rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pair(self, a: bytes, b: bytes) -> bool:
        """Whether a followed by b encodes to just these two tokens."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each of the words, which must be sorted."""
        out, last, before = [], [b""], b""  # last[i]: the last token of the encoding of the first i bytes
        ids, suffixes, pairs = self.ids, self.suffixes, self.pairs
        for word in words:
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found, at = [], end - 1
                while at >= 0 and (token := word[at:end]) in suffixes:
                    if token in ids:
                        found.append((at, token))
                    at -= 1
                for at, token in reversed(found):
                    if at == 0:
                        if self.alone(token):
                            break
                    elif known if (known := pairs.get((last[at], token))) is not None else self.pair(last[at], token):
                        break
                last.append(token)
            before, end, tokens = word, len(word), []
            while end:
                token = last[end]
                tokens.append(ids[token])
                end -= len(token)
            out.append(tokens[::-1])
        return out

    def alone(self, token: bytes) -> bool:
        """Whether a token's bytes encode to itself."""
        if (known := self.pairs.get((b"", token))) is None:
            known = self.pairs[b"", token] = self.merged(token) == [token]
        return known

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for those that are not kept."""
        mask = np.uint64(len(self.slot_key) - 1)
        slot, out, left = keys & mask, np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            entry = self.slot_entry[slot[left]]
            hit = (self.slot_key[slot[left]] == keys[left]) & (entry >= 0)
            out[left[hit]] = entry[hit]
            left = left[~hit & (entry >= 0)]
            slot[left] = (slot[left] + np.uint64(1)) & mask
        return out

    def _keep(self, encoded: list[list[int]], keys: np.ndarray) -> None:
        n, many = len(encoded), np.array([len(e) for e in encoded], np.int64)
        total = int(many.sum())
        while self.entries + n > len(self.at):
            self.at, self.length = np.resize(self.at, 2 * len(self.at)), np.resize(self.length, 2 * len(self.length))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = [i for e in encoded for i in e]
        self.at[self.entries : self.entries + n] = self.used + np.cumsum(many) - many
        self.length[self.entries : self.entries + n] = many
        mask, left, slot = np.uint64(len(self.slot_key) - 1), np.arange(n), keys & np.uint64(len(self.slot_key) - 1)
        while len(left):
            free = left[self.slot_entry[slot[left]] < 0]
            self.slot_entry[slot[free]], self.slot_key[slot[free]] = free + self.entries, keys[free]
            left = left[self.slot_entry[slot[left]] != left + self.entries]
            slot[left] = (slot[left] + np.uint64(1)) & mask
        self.entries, self.used = self.entries + n, self.used + total

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's documents one after another, and the documents' offsets in them."""
        try:
            starts, ends, offsets = cut(part, list(self.special))
        except UnicodeDecodeError:
            texts = [part.text(i).decode("utf-8", "replace").encode() for i in range(len(part))]
            part = Slice(part.ids, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
            starts, ends, offsets = cut(part, list(self.special))
        keys = span_hashes(part.buf, starts, ends)
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.entries + len(new) > self.room:
                new, first = np.unique(keys, return_index=True)
                self.clear(len(new))
                fresh = self._find(new) < 0
                new, first, missing = new[fresh], first[fresh], np.arange(len(keys))
            raw = part.buf.tobytes()
            words = [raw[a:b] for a, b in zip(starts[missing[first]].tolist(), ends[missing[first]].tolist(), strict=True)]
            order = sorted(range(len(words)), key=words.__getitem__)
            self._keep(self.encode_words([words[i] for i in order]), new[order])
            entry = self._find(keys)
        many = self.length[entry].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(many)])
        ids = self.flat[np.repeat(self.at[entry] - edge[:-1], many) + np.arange(edge[-1])]
        return ids, edge[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each document's tokens; not valid UTF-8 only if the ids were cut."""
        many = self.byte_length[ids]
        edge = np.concatenate([[0], np.cumsum(many)])
        raw = self.all_bytes[np.repeat(self.byte_at[ids] - edge[:-1], many) + np.arange(edge[-1])].tobytes()
        at = edge[offsets].tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_known: dict[int, Bpe] = {}


def worker_bpe(text: str) -> Bpe:
    """The vocabulary of this worker: kept between tasks, with the words that it has met."""
    if (key := hash(text)) not in _known:
        _known.clear()
        _known[key] = Bpe(text)
    return _known[key]


def utf8(texts: list[bytes]) -> pa.Array:
    """As strings; bytes that are not valid UTF-8 become U+FFFD."""
    try:
        return pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


def vocabulary(docs: DataFrame, path: str):
    """The tokenizer file, read once on the driver and sent to the tasks (its size doesn't grow with the data)."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (the text that these ids decode to; without
    ``decoded``: null) for every row of docs, by the tokenizers file at ``path``."""
    sent = vocabulary(docs, path)

    def make():
        bpe = worker_bpe(sent.value)

        def each(part: Slice) -> pa.RecordBatch:
            ids, offsets = bpe.encode(part)
            raw, at = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
            packed = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            texts = utf8(bpe.decode(ids, offsets)) if decoded else pa.nulls(len(part), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(np.diff(offsets)), packed, texts], ["doc_id", "n_tokens", "ids", "decoded"])

        return each

    return map_slices(docs, make, "doc_id long, n_tokens long, ids binary, decoded string")
