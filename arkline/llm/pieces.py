"""SentencePiece encoding and decoding by a streaming Viterbi search.

A model file's pieces span a lattice over the text's characters. For a unigram model a
path's weight is the sum of its pieces' scores; for a BPE model a piece may follow another
only if merging by rank keeps the two apart, which leaves exactly one path to every
boundary, and that path is the one BPE merging ends with: every neighbouring pair of a BPE
encoding is the encoding of its own text, and a sequence whose neighbouring pairs all are
is an encoding. Both kinds therefore run through the same search and give the library's ids.

The search keeps back pointers for the characters since the last commit. No piece is longer
than ``longest`` characters, so later paths start from the last ``longest`` boundaries only;
once the back pointers of all of these lead to one boundary, everything before it is final,
its ids go out and the window slides. Memory is bounded by that window, not by the text.
Where no piece spans a boundary (before a word's blank), paths meet at once. Texts stream by
in pieces of about SEGMENT bytes that end at such boundaries; of each piece every distinct
word is searched, decoded and compared once, and numpy deals its ids out to all places that
hold it (words are told apart by 64-bit hash and length). What was found is kept in caches
of a bounded size that end with the task.

Defined results: a null or empty text has no ids; characters without a piece become their
UTF-8 bytes' pieces (byte fallback) or the unknown id, one for a run of them; invalid UTF-8
reads as U+FFFD; pieces that the model marks unused are never used. A literal U+2581 decodes as a blank, as in the library. Normalisation is
that of the model (identity, with its blanks escaped and the leading one added); a model
with a character map is refused. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import chunks, span_hashes, utf8_column

BLANK = "▁"
#: What a task keeps at most: words, parts of pieces, judged neighbours; about 50 MB together.
WORDS, EDGES, NEIGHBOURS = 400_000, 20_000, 150_000
CACHED_LENGTH = 48
CHECK_EVERY = 64
SEGMENT = 1 << 18
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNKNOWN_PENALTY = 10.0  # as in the library


@dataclass
class ModelFile:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    dummy_prefix: bool
    trim_blanks: bool
    byte_fallback: bool
    unknown_surface: str

    @classmethod
    def parse(cls, data: bytes) -> ModelFile:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(data)
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if m.normalizer_spec.precompiled_charsmap:
            raise ValueError("models with a character map are not supported")
        if m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with escaped blanks before words are supported")
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.trainer_spec.byte_fallback, m.trainer_spec.unk_surface)


@dataclass
class _Edges:
    """How a piece comes to be: the parts at its left and right end, each with the score of the
    merge that ends it; whole: it is its own encoding; in_order: its merges' scores only fall."""

    whole: bool
    in_order: bool
    left: list
    right: list


class _Table:
    """Numbers by 64-bit keys (not -1), many at a time: open addressing in two arrays of 2**bits places."""

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        # probes may run over the end, so some places more
        self.keys, self.values, self.count = np.full((1 << self.bits) + 4096, -1, np.int64), np.full((1 << self.bits) + 4096, -1, np.int32), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of these keys, -1 for those that aren't held."""
        at, out = self._home(keys), np.full(len(keys), -1, np.int32)
        held = self.keys[at]
        hit = held == keys
        out[hit] = self.values[at[hit]]
        live = np.flatnonzero(~hit & (held != -1))
        while len(live):
            at[live] += 1
            held = self.keys[at[live]]
            hit = held == keys[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit & (held != -1)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that aren't held yet; there must be room."""
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            _, first = np.unique(at[left], return_index=True)
            mine = np.zeros(len(left), bool)
            mine[first] = True
            mine &= self.keys[at[left]] == -1
            self.keys[at[left[mine]]], self.values[at[left[mine]]] = keys[left[mine]], values[left[mine]]
            left = left[~mine]
            at[left] += 1
        self.count += len(keys)


class _Known:
    """Words met so far: the ids of a word's key, and whether they decode to the word."""

    def __init__(self):
        self.places = _Table((2 * WORDS).bit_length())
        self.clear()

    def clear(self) -> None:
        self.places.clear()
        self.ids, self.begins, self.equal = array("i"), array("q", [0]), array("b")

    @property
    def count(self) -> int:
        return len(self.equal)

    def extend(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Where the words of these keys, with so many ids each, are kept."""
        begin = self.count
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.begins.frombytes((self.begins[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
        self.equal.frombytes(equal.astype(np.int8).tobytes())
        where = np.arange(begin, begin + len(keys))
        self.places.add(keys, where)
        return where

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Copies, so that words can still be added."""
        return np.array(self.ids, np.int32), np.array(self.begins, np.int64), np.array(self.equal, bool)


def _is_plain(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether all texts are valid UTF-8 without a literal U+2581."""
    at = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
    if ((data[at + 1] == 0x96) & (data[at + 2] == 0x81)).any():
        return False
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    if (data[inner] & 0xC0 == 0x80).any():  # a text begins inside a character
        return False
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """Encodes and decodes with a model file; one per task."""

    def __init__(self, model: ModelFile):
        self.model = model
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.types[i] == _NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = model.types.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.types[i] == _BYTE}
        if _USER in model.types:
            raise ValueError("user-defined pieces are not supported")
        self.words_apart = all(BLANK not in p.lstrip(BLANK) for p in self.ids)
        self.trie: list = [-1, {}]  # the piece's id, or -1, and the nodes by the next character
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        self.steps: _Table | None = None
        self.neighbours = _Table((4 * NEIGHBOURS).bit_length())
        self.alone = {p for p in self.ids if len(p) == 1}  # characters that have a piece
        # an ASCII byte is a character of its own wherever it stands
        self.surfaces = [p if t == _NORMAL else chr(int(p[3:5], 16)) if t == _BYTE and int(p[3:5], 16) < 128 else None for p, t in zip(model.pieces, model.types, strict=True)]
        self.texts = list(model.pieces)  # with characters that have no piece appended as they come
        self.strange: dict[str, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.known = _Known()
        self.apart: dict[int, bool] = {}
        self.edges: dict[str, _Edges] = {}
        self.scores = [np.float32(x) for x in model.scores]
        normal = [x for x, t in zip(model.scores, model.types, strict=True) if t == _NORMAL]
        self.floor = np.float32(min(normal, default=0.0)) - np.float32(_UNKNOWN_PENALTY)

    # -------------------------------------------------- text to pieces

    def normalise(self, text: str) -> str:
        if self.model.trim_blanks:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.model.dummy_prefix else "") + text.replace(" ", BLANK)

    def encode(self, text: str) -> array:
        out = array("i")
        text = self.normalise(text)
        if not self.words_apart:
            out.extend(self._search(text))
            return out
        get = self.words.get
        for word in re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", text):
            found = get(word)
            if found is None:
                found = self._word(word)
            # a run of unknown characters is one id, also across words
            if not self.model.byte_fallback and out and found and out[-1] == found[0] == self.unknown:
                found = found[1:]
            out.extend(found)
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        found = tuple(self._search(word))
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= WORDS // 20:
                self.words.clear()
            self.words[word] = found
        return found

    # -------------------------------------------------- many texts at once

    def encode_all(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, ids, how many each text has, whether it decodes to itself) of a string or
        binary column, in parts of about SEGMENT bytes, one text at least."""
        data, offsets = utf8_column(column)
        by_words = self.words_apart and self.model.byte_fallback and self.model.dummy_prefix and not self.model.trim_blanks
        for i, j in chunks(offsets, SEGMENT):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if by_words and _is_plain(part, own):
                yield i, *self._dealt(part, own)
                continue
            ids, counts, equal = array("i"), [], []
            for a, b in zip(own[:-1], own[1:], strict=True):
                text = part[a:b].tobytes().decode("utf-8", "replace")
                found = self.encode(text)
                ids.extend(found)
                counts.append(len(found))
                equal.append(self.decode(found) == self.normalise(text)[1 if self.model.dummy_prefix else 0 :].replace(BLANK, " "))
            yield i, np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), np.array(counts, np.int64), np.array(equal, bool)

    def _dealt(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number for each text and whether it decodes to itself, word by word."""
        sizes = np.diff(offsets)
        filled = sizes > 0
        # a blank before each text that isn't empty
        spaced = np.insert(data, offsets[:-1][filled], 32)
        heads = offsets[:-1] + np.cumsum(filled) - filled  # where each text's blank stands
        blank = spaced == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[heads[filled]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(spaced))
        ids, counts, equal, at = [], [], [], 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
            got = self._words(spaced, starts[at:stop], ends[at:stop])
            for own, x in zip((ids, counts, equal), got, strict=True):
                own.append(x)
            at = stop
        if not ids:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool)
        counts, equal = np.concatenate(counts), np.concatenate(equal)
        first = np.searchsorted(starts, heads)
        first = np.append(first, len(starts))
        total, wrong = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(~equal))
        return np.concatenate(ids), total[first[1:]] - total[first[:-1]], wrong[first[1:]] == wrong[first[:-1]]

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of neighbouring words, how many each has, and whether it decodes to itself."""
        if len(starts) == 1 and ends[0] - starts[0] > SEGMENT:
            word = data[starts[0] : ends[0]].tobytes().decode()
            ids = np.fromiter(self._search(word.replace(" ", BLANK)), np.int32)
            return ids, np.array([len(ids)]), np.array([self.decode(ids.tolist()) == word[1:]])
        base = starts[0]
        hashes = span_hashes(data[base : ends[-1]], starts - base, ends - base)
        keys = (hashes + (ends - starts).astype(np.uint64)).view(np.int64)
        keys, at, where = np.unique(np.where(keys == -1, 0, keys), return_index=True, return_inverse=True)
        known = self.known
        if known.count + len(keys) > WORDS:
            known.clear()
        places = known.places.get(keys).astype(np.int64)
        fresh = np.flatnonzero(places < 0)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)]
        escaped = [w.replace(" ", BLANK) for w in words]
        if self.model.kind == BPE:
            short = np.array([len(w) <= CHECK_EVERY for w in words], bool)
            own = fresh[short]
            places[own] = known.extend(keys[own], *self._together([w for w, x in zip(escaped, short.tolist(), strict=True) if x]))
            fresh, escaped = fresh[~short], [w for w, x in zip(escaped, short.tolist(), strict=True) if not x]
        for k, word in zip(fresh.tolist(), escaped, strict=True):
            ids = array("i", self._search(word))
            places[k] = known.extend(keys[k : k + 1], np.array(ids, np.int32), np.array([len(ids)]), np.array([self.decode(ids) == word[1:].replace(BLANK, " ")]))[0]
        flat, begins, equal = known.arrays()
        own = places[where]
        counts = begins[own + 1] - begins[own]
        upto = np.cumsum(counts)
        take = np.repeat(begins[own] - (upto - counts), counts) + np.arange(upto[-1])
        return flat[take], counts, equal[own]

    def _strange(self, char: str) -> int:
        """A number for a character that has no piece."""
        number = self.strange.get(char)
        if number is None:
            number = self.strange[char] = len(self.texts)
            self.texts.append(char)
        return number

    def _search(self, text: str):
        """Ids of a text, committed as soon as all live paths agree.

        via, back and best belong to boundaries from ``base`` on: the piece that ends there,
        where it begins, and its path's score.
        """
        size, longest, bpe = len(text), self.longest, self.model.kind == BPE
        if bpe and size <= CHECK_EVERY:
            yield from self._short(text)
            return
        trie, scores, apart = self.trie, self.scores, self.apart
        room = min(size, CHECK_EVERY + longest) + 1
        via, back, best = [-1] * room, [-1] * room, [None] * room
        best[0] = np.float32(0)
        base, before, check, run = 0, -1, CHECK_EVERY, False
        begin = 0
        while begin < size:
            rel = begin - base
            if rel >= check:
                meet = self._meeting(back, rel)
                if meet:
                    ids, run = self._emit(via, back, meet, text, base, run)
                    yield from ids
                    before = via[meet]
                    del via[:meet], back[:meet], best[:meet]
                    back = [b - meet if b >= 0 else b for b in back]
                    base += meet
                    rel -= meet
                check = rel + CHECK_EVERY
            if len(via) <= rel + longest:
                more = rel + longest + CHECK_EVERY - len(via)
                via += [-1] * more
                back += [-1] * more
                best += [None] * more
            ahead = text[begin : begin + longest]
            at, node = rel, trie
            last = via[rel] if rel else before
            if bpe:
                row = (last + 1) << 32
                for c in ahead:
                    node = node[1].get(c)
                    if node is None:
                        break
                    at += 1
                    number = node[0]
                    if number >= 0 and via[at] < 0:
                        ok = apart.get(row + number)
                        if ok is None:
                            ok = self._judge(last, number)
                        if ok:
                            via[at], back[at] = number, rel
                if ahead[0] not in self.alone:
                    number = self._strange(ahead[0])
                    if via[rel + 1] < 0 and self._judge(last, number):
                        via[rel + 1], back[rel + 1] = number, rel
            else:
                reached = best[rel]
                for c in ahead:
                    node = node[1].get(c)
                    if node is None:
                        break
                    at += 1
                    number = node[0]
                    if number >= 0:
                        value = reached + scores[number]
                        if best[at] is None or value > best[at]:
                            best[at], via[at], back[at] = value, number, rel
                if ahead[0] not in self.alone:
                    value = reached + self.floor
                    if best[rel + 1] is None or value > best[rel + 1]:
                        best[rel + 1], via[rel + 1], back[rel + 1] = value, self._strange(ahead[0]), rel
            begin += 1
        yield from self._emit(via, back, size - base, text, base, run)[0]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many short words of a BPE model, their number for each, and whether they decode to
        the word. A step takes one boundary of each word further, its pieces by a walk of the
        prefixes and its path by the judged neighbours; no commit can come before a short word's end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(code)) - (ends - sizes)[owner]  # of a character in its word
        last = ends[owner]
        # pieces by where they begin and end
        if self.steps is None:
            self._flatten()
        get, piece = self.steps.get, self.piece_of
        if self.neighbours.count > NEIGHBOURS:
            self.neighbours.clear()
        begin, stop = np.arange(len(code)), np.arange(1, len(code) + 1)
        node = get(code).astype(np.int64)
        alone = np.where(node >= 0, piece[node], -1)
        odd = np.flatnonzero(alone < 0)
        found = [(begin[odd], stop[odd], np.array([self._strange(chr(c)) for c in code[odd].tolist()], np.int64))]
        while len(begin):
            on = node >= 0
            begin, stop, node = begin[on], stop[on], node[on]
            number = piece[node]
            is_piece = number >= 0
            found.append((begin[is_piece], stop[is_piece], number[is_piece]))
            on = stop < last[begin]
            begin, stop, node = begin[on], stop[on], node[on]
            node = get((node << 21) + code[stop]).astype(np.int64)
            stop = stop + 1
        begin, stop, number = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place[begin], kind="stable")
        begin, stop, number = begin[order], stop[order], number[order]
        cuts = np.searchsorted(place[begin], np.arange(int(sizes.max(initial=0)) + 1))
        # boundaries: a word of n characters has n + 1, numbered on through the words
        head = begin + owner[begin]
        tail = stop + owner[begin]
        via, back = np.full(len(code) + len(words), -2, np.int64), np.zeros(len(code) + len(words), np.int64)
        via[ends - sizes + np.arange(len(words))] = -1
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            open_ = lo + np.flatnonzero(via[tail[lo:hi]] == -2)
            before, these = via[head[open_]], number[open_]
            keys = (before + 1 << 32) + these
            ok = self.neighbours.get(keys)
            asked = np.flatnonzero(ok < 0)
            if len(asked):
                new, first, where = np.unique(keys[asked], return_index=True, return_inverse=True)
                found = np.array([self._apart(self.texts[x] if x >= 0 else "", self.texts[y]) for x, y in zip(before[asked[first]].tolist(), these[asked[first]].tolist(), strict=True)], np.int32)
                self.neighbours.add(new, found)
                ok[asked] = found[where]
            good = open_[ok > 0]
            via[tail[good]], back[tail[good]] = number[good], head[good]
        # back from every word's end
        at, word = ends + np.arange(len(words)), np.arange(len(words))
        steps = []
        while len(at):
            on = via[at] >= 0
            at, word = at[on], word[on]
            steps.append((word, via[at]))
            at = back[at]
        word, number = (np.concatenate(x) for x in zip(*steps[::-1], strict=True))
        order = np.argsort(word, kind="stable")
        word, number = word[order], number[order]
        counts = np.bincount(word, minlength=len(words))
        strange = np.zeros(len(words), bool)
        strange[owner[odd]] = True
        # the others decode at once: equal as a whole, and each as long as its word
        plain = ~strange[word]
        length = np.bincount(word[plain], self.length_of[number[plain]], len(words)).astype(np.int64)
        equal = length == sizes
        if "".join(map(self.surfaces.__getitem__, number[plain].tolist())) != "".join(w for w, x in zip(words, strange.tolist(), strict=True) if not x):
            equal[:] = False
        if not strange.any() and equal.all():
            return number.astype(np.int32), counts, equal
        known, first = len(self.model.pieces), np.append(0, np.cumsum(counts))
        paths = []
        for w, text in enumerate(words):
            path = number[first[w] : first[w + 1]].tolist()
            if strange[w] or not equal[w]:
                path = self._spelled(path, known)
                equal[w] = self.decode(path) == text[1:].replace(BLANK, " ")
            paths.append(path)
        return np.array([i for p in paths for i in p], np.int32), np.array([len(p) for p in paths], np.int64), equal

    def _spelled(self, path: list[int], known: int) -> list[int]:
        """A path's ids, characters without a piece as bytes or as one unknown id for a run."""
        out, run = [], False
        for number in path:
            if number < known:
                out.append(number)
                run = False
            elif self.model.byte_fallback:
                out.extend(self.bytes[x] for x in self.texts[number].encode("utf-8", "surrogatepass"))
            else:
                if not run:
                    out.append(self.unknown)
                run = True
        return out

    def _flatten(self) -> None:
        """The trie as one table: (node, character) to node, the root's without a node; and nodes' pieces."""
        keys, pieces, stack = [], [], [(0, self.trie)]
        while stack:
            above, node = stack.pop()
            for c, below in node[1].items():
                keys.append((above << 21) + ord(c))
                pieces.append(below[0])
                stack.append((len(keys), below))
        self.steps = _Table((2 * len(keys)).bit_length())
        self.steps.add(np.array(keys, np.int64), np.arange(1, len(keys) + 1))
        self.piece_of = np.array([-1, *pieces], np.int64)
        self.length_of = np.array([len(p) for p in self.model.pieces], np.int64)

    def _short(self, text: str) -> list[int]:
        """The search for a BPE model where no commit can come before the end."""
        size, apart, first = len(text), self.apart, self.trie[1]
        via, back = [-1] * (size + 1), [0] * (size + 1)
        for begin in range(size):
            last = via[begin]
            row = (last + 1) << 32
            node, at = first.get(text[begin]), begin
            if node is None or node[0] < 0:
                number = self._strange(text[begin])
                if via[begin + 1] < 0 and self._judge(last, number):
                    via[begin + 1], back[begin + 1] = number, begin
            while node is not None:
                at += 1
                number = node[0]
                if number >= 0 and via[at] < 0:
                    ok = apart.get(row + number)
                    if ok is None:
                        ok = self._judge(last, number)
                    if ok:
                        via[at], back[at] = number, begin
                if at == size:
                    break
                node = node[1].get(text[at])
        return self._emit(via, back, size, text, 0, False)[0]

    def _meeting(self, back: list, rel: int) -> int:
        """The last boundary that the paths to rel and to every boundary reached beyond it share."""
        live = {rel, *(k for k in range(rel + 1, len(back)) if back[k] >= 0)}
        while len(live) > 1:
            most = max(live)
            live.discard(most)
            live.add(back[most])
        return live.pop()

    def _emit(self, via, back, stop, text, base, run) -> tuple[list[int], bool]:
        """The ids of the path to stop; run: whether an unknown id came last."""
        path, out = [], []
        while stop > 0:
            path.append(via[stop])
            stop = back[stop]
        known = len(self.model.pieces)
        for number in reversed(path):
            if number < known:
                out.append(number)
                run = False
            elif self.model.byte_fallback:
                out.extend(self.bytes[x] for x in self.texts[number].encode())
            else:
                if not run:
                    out.append(self.unknown)
                run = True
        return out, run

    def _judge(self, last: int, number: int) -> bool:
        if len(self.apart) >= NEIGHBOURS:
            self.apart.clear()
        ok = self._apart(self.texts[last] if last >= 0 else "", self.texts[number])
        self.apart[((last + 1) << 32) + number] = ok
        return ok

    def _apart(self, left: str, right: str) -> bool:
        """Whether BPE of left + right gives these two pieces (right alone, if left is empty)."""
        x, y = self._edges(left), self._edges(right)
        if not left:
            return y.whole
        if not (x.whole and y.whole):
            return False
        if not (x.in_order and y.in_order):
            return self._merge(left + right)[0] == [left, right]
        # both sides merge by falling score; follow the parts that touch until one pair of
        # them would merge before either changes (of equal scores the leftmost merges first)
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = x.right[i], y.left[j]
            number = self.ids.get(a + b)
            if number is not None and (score := self.model.scores[number]) > until_a and score >= until_b:
                return False
            if i + 1 == len(x.right) and j + 1 == len(y.left):
                return True
            if until_a >= until_b:
                i += 1
            else:
                j += 1

    def _edges(self, piece: str) -> _Edges:
        found = self.edges.get(piece)
        if found is None:
            if len(self.edges) >= EDGES:
                self.edges.clear()
            parts, trace = self._merge(piece)
            left, right = [[piece[:1], -np.inf]], [[piece[-1:], -np.inf]]
            for score, start, text in trace:
                if start == 0:
                    left[-1][1] = score
                    left.append([text, -np.inf])
                if start + len(text) == len(piece):
                    right[-1][1] = score
                    right.append([text, -np.inf])
            scores = [t[0] for t in trace]
            found = self.edges[piece] = _Edges(len(parts) <= 1, scores == sorted(scores, reverse=True), left, right)
        return found

    def _merge(self, text: str) -> tuple[list[str], list[tuple[float, int, str]]]:
        """BPE of a short text by its definition: the best-ranked pair merges first, the leftmost
        of equals. Its parts, and each merge's score, place and result."""
        parts, trace = list(text), []
        ids, scores = self.ids, self.model.scores
        while True:
            best = None
            for i in range(len(parts) - 1):
                number = ids.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or scores[number] > best[0]):
                    best = (scores[number], i)
            if best is None:
                return parts, trace
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            trace.append((best[0], sum(map(len, parts[:i])), parts[i]))

    # -------------------------------------------------- ids to text

    def decode(self, ids) -> str:
        try:
            text = "".join(map(self.surfaces.__getitem__, ids))
        except TypeError:  # some ids have no text of their own
            text = self._surface(ids)
        if self.model.dummy_prefix or self.model.trim_blanks:
            text = text[1:] if text.startswith(BLANK) else text
        return text.replace(BLANK, " ")

    def _surface(self, ids) -> str:
        out, raw = [], bytearray()
        types, pieces = self.model.types, self.model.pieces
        for i in ids:
            kind = types[i]
            if kind == _BYTE:
                raw.append(int(pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append("" if kind == _CONTROL else self.model.unknown_surface if kind == _UNKNOWN else pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


# ---------------------------------------------------------------- Spark


def _codec(shared) -> Codec:
    """A codec of a broadcast model file, for one task."""
    return Codec(ModelFile.parse(shared.value))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """docs with ids and n_ids, and with check round_trip: whether the ids decode to the text
    (as normalised: a literal U+2581 counts as a blank). Texts stream by; nothing is shuffled."""
    with open(model_path, "rb") as f:  # the driver's file; a model is small and broadcast
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), *([T.StructField("round_trip", T.BooleanType())] if check else [])]
    kept = [c for c in docs.columns if c not in ("ids", "n_ids", "round_trip")]
    source = docs.select(*[docs[c] for c in kept], docs[text_col].cast("binary").alias("_ark_text"))
    schema = T.StructType([*source.schema.fields[:-1], *added])

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for begin, ids, counts, equal in codec.encode_all(batch.column(batch.num_columns - 1)):
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                own = batch.slice(begin, len(counts))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], lists, pa.array(counts), *([pa.array(equal)] if check else [])], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with text, the decoded ids; null ids decode to an empty text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in encoded.columns if c != "text"]
    source = encoded.select(*[encoded[c] for c in kept], encoded[ids_col].cast("array<int>").alias("_ark_ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            texts = pa.array([codec.decode(x.as_py() or ()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return source.mapInArrow(run, schema)


def default_model() -> str:
    import importlib.util
    import os

    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, "piece_bpe_32k.model")


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, default_model()).drop("text")
