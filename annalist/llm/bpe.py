"""Byte-level BPE with word ends: a compiled lexicon for frequent words, exact merging for the rest.

The words that the vocabulary itself has as whole tokens, and the frequent words
of a corpus (``frequent_words`` counts all of it), are compiled into a
minimal acyclic automaton: states with the same future are shared, and the
numbers on the path to a word add up to the word's place in a table of id
lists.  The automaton and all other tables are flat arrays in one file, which
every executor gets once and its workers map into memory.  A word that the
automaton lacks is merged pair by pair, by rank, many words at a time.

Words are found as spans of a byte buffer, by class of byte; only pieces with
characters beyond ASCII and the Latin-1 letters are split as text.  Lower case,
normal form and letter classes of these follow the tokenizers library, whose
Unicode tables are compared with Python's when the tables are compiled.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import tempfile
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import common as C
from annalist.llm.spans import KEEP

_NONE = np.int32(1 << 30)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


# ---------------------------------------------------------------- keys to places


def _home(keys: np.ndarray, size: int) -> np.ndarray:
    return (C.mix64(keys.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def place_keys(slots: np.ndarray, home: np.ndarray, rows: np.ndarray) -> None:
    """Put ``rows`` into the first free slot from ``home`` on; an open-addressing table with room to spare."""
    size = len(slots)
    while len(rows):
        free = slots[home] < 0
        slots[home[free]] = rows[free]
        left = slots[home] != rows
        home, rows = (home[left] + 1) & (size - 1), rows[left]


def slots_of(keys: np.ndarray) -> np.ndarray:
    """A table that ``find`` looks distinct integer keys up in."""
    slots = np.full(1 << max(4, int(len(keys) * 2).bit_length()), -1, np.int32)
    place_keys(slots, _home(keys, len(slots)), np.arange(len(keys), dtype=np.int32))
    return slots


def find(slots: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in ``keys``, or -1."""
    out = np.full(len(wanted), -1, np.int32)
    at, rows = _home(wanted, len(slots)), np.arange(len(wanted))
    while len(rows):
        got = slots[at]
        same = (got >= 0) & (keys[got] == wanted[rows])
        out[rows[same]] = got[same]
        on = ~same & (got >= 0)
        at, rows = (at[on] + 1) & (len(slots) - 1), rows[on]
    return out


# ---------------------------------------------------------------- the automaton


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct words.

    ``edges``: state * 256 + byte, rising; ``targets``: the state it leads to;
    ``skips``: the number of words that come before those on this edge;
    ``final``: whether a word ends in the state.  State 0 is the start.
    """
    # A node is [final, {byte: child}]; the nodes on the path of the last word are not frozen yet.
    registry: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, {}]]
    previous = b""

    def freeze(node: list) -> int:
        key = (node[0], tuple(sorted(node[1].items())))
        if key not in registry:
            registry[key] = len(frozen)
            frozen.append(key)
        return registry[key]

    def shrink(depth: int) -> None:
        while len(path) - 1 > depth:
            child = path.pop()
            path[-1][1][previous[len(path) - 1]] = freeze(child)

    for word in words:
        common = len(os.path.commonprefix([previous, word]))
        shrink(common)
        for _ in word[common:]:
            path.append([False, {}])
        path[-1][0] = True
        previous = word
    shrink(0)
    root = freeze(path[0])
    counts: list[int] = []
    for final, edges in frozen:  # children are frozen before their parents
        counts.append(final + sum(counts[t] for _, t in edges))
    number = np.array([root - i if i <= root else i for i in range(len(frozen))])  # the root is frozen last
    keys, targets, skips = [], [], []
    for i in range(len(frozen) - 1, -1, -1):
        final, edges = frozen[i]
        before = int(final)
        for byte, t in edges:
            keys.append(int(number[i]) * 256 + byte)
            targets.append(int(number[t]))
            skips.append(before)
            before += counts[t]
    finals = np.zeros(len(frozen), bool)
    finals[number] = [f for f, _ in frozen]
    return {"edges": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32), "final": finals}


def look_up(tables: dict[str, np.ndarray], letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted list that was compiled, or -1; ``letters`` has a row of bytes per word."""
    n, width = letters.shape
    place, found = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    edges = tables["edges"]
    slots = tables["edge_slots"] if "edge_slots" in tables else slots_of(edges)
    on, state = np.flatnonzero(lengths > 0), np.zeros(int((lengths > 0).sum()), np.int64)
    if not len(edges):
        return found
    for i in range(width):
        at = find(slots, edges, state * 256 + letters[on, i])
        hit = at >= 0
        on, at = on[hit], at[hit]
        state = tables["targets"][at].astype(np.int64)
        place[on] += tables["skips"][at]
        last = lengths[on] == i + 1
        ends = on[last & tables["final"][state]]
        found[ends] = place[ends]
        on, state = on[~last], state[~last]
        if not len(on):
            break
    return found


# ---------------------------------------------------------------- merging


def merge_words(tables: dict[str, np.ndarray], letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by merging their lowest-ranked pair, leftmost first, until none is left: (one after the other, counts).

    A row holds a word's symbols where they start, linked to their neighbours;
    each turn merges one pair of every word that still has one.
    """
    n, width = letters.shape
    rows = np.arange(n)
    used = np.arange(width) < lengths[:, None]
    ids = np.where(used, tables["inner"][letters], -1).astype(np.int32)
    some = lengths > 0
    ids[rows[some], lengths[some] - 1] = tables["outer"][letters[rows[some], lengths[some] - 1]]
    if width > 1:
        rank = np.full((n, width), _NONE, np.int32)
        pair = used[:, 1:]
        a, b = ids[:, :-1][pair], ids[:, 1:][pair]
        rank[:, :-1][pair] = _ranks(tables, a, b)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        flat, ranks, size = ids.reshape(-1), rank.reshape(-1), np.asarray(lengths, np.int32)
        live = rows
        while len(live):
            own = rank[live]
            m = own.argmin(1)
            best = own[np.arange(len(live)), m]
            go = best < _NONE
            live, m, best = live[go], m[go].astype(np.int32), best[go]
            if not len(live):
                break
            base, top = live * width, size[live]
            at = base + m
            gone = base + after[at]
            flat[at] = tables["merged"][best]
            flat[gone], ranks[gone] = -1, _NONE
            right = after[gone]
            after[at] = right
            ranks[at] = _NONE
            on = np.flatnonzero(right < top)
            before[base[on] + right[on]] = m[on]
            ranks[at[on]] = _ranks(tables, flat[at[on]], flat[base[on] + right[on]])
            left = before[at]
            on = np.flatnonzero(left >= 0)
            to = base[on] + left[on]
            ranks[to] = _ranks(tables, flat[to], flat[at[on]])
    keep = ids >= 0
    return ids[keep], keep.sum(1)


def _ranks(tables: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = find(tables["pair_slots"], tables["pairs"], a.astype(np.int64) * 65536 + b)
    return np.where(at >= 0, tables["ranks"][at], _NONE)


def merge_long(tables: dict[str, np.ndarray], word: bytes) -> list[int]:
    """The same for one word of any length, in n log n."""
    known = _pair_dict(tables)
    ids = [int(tables["inner"][b]) for b in word[:-1]] + [int(tables["outer"][word[-1]])]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    heap = [(known[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in known]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if gone[i] or (j := after[i]) >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i] = known[pair][1]
        gone[j] = True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (p := (ids[x], ids[y])) in known:
                heapq.heappush(heap, (known[p][0], x, p))
    return [x for x, g in zip(ids, gone, strict=True) if not g]


_dicts: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}


def _pair_dict(tables: dict[str, np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
    if id(tables) not in _dicts:
        _dicts.clear()
        pairs, ranks = tables["pairs"].tolist(), tables["ranks"].tolist()
        _dicts[id(tables)] = {(p >> 16, p & 65535): (r, int(tables["merged"][r])) for p, r in zip(pairs, ranks, strict=True)}
    return _dicts[id(tables)]


# ---------------------------------------------------------------- letters as the library has them


def _ranges(points: list[int]) -> str:
    """Code points as the body of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


def _unlike(points: list[int], theirs: Callable[[list[str]], object], ours: Callable[[list[str]], object]) -> list[int]:
    """The code points that two functions of lists of characters treat differently, found by halving."""
    own = [chr(c) for c in points]
    if not points or theirs(own) == ours(own):
        return []
    if len(points) == 1:
        return points
    k = len(points) // 2
    return _unlike(points[:k], theirs, ours) + _unlike(points[k:], theirs, ours)


def _normal_form(text: str, inert: regex.Pattern | None) -> str:
    """NFC, in which ``inert`` characters neither move nor compose."""
    if inert is None or not inert.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(x if inert.match(x) else unicodedata.normalize("NFC", x) for x in inert.splititer(text))


@lru_cache(1)
def letter_notes(path: str) -> dict:
    """Where the library's lower case, letters, digits and normal form differ from Python's.

    ``lower``: [character, its lower case]; ``no_letter``, ``no_digit``: classes
    of what only the newer tables here have; ``inert``: characters whose
    composition or order the library does not know.  Characters that only the
    library knows would need its tables, and are an error.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    lower, nfc, nfd = normalizers.Lowercase(), normalizers.NFC(), normalizers.NFD()
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    changed = [c for i in range(0, len(every), 4096) for c in _unlike(every[i : i + 4096], lambda x: lower.normalize_str("".join(x)), lambda x: "".join(c.lower() for c in x))]
    letters, digits = regex.findall(r"\p{L}", text), regex.findall(r"\p{N}", text)
    joined = {p for p, _ in split.pre_tokenize_str(" ".join(f"a{c}" for c in letters))}
    apart = {p for p, _ in split.pre_tokenize_str(" ".join(f"!{c}" for c in digits))}
    wrong = {"no_letter": [ord(c) for c in letters if "a" + c not in joined], "no_digit": [ord(c) for c in digits if "!" + c in apart]}
    rest = "!" + "".join(regex.findall(r"[^\p{White_Space}\p{L}\p{N}]", text)) + "".join(map(chr, wrong["no_letter"] + wrong["no_digit"]))
    marks = [lambda x, f=f: [f(a + c + b) for c in x for a, b in (("", ""), ("a\u0345", ""), ("a", "\u0334"))] for f in (nfd.normalize_str, lambda t: unicodedata.normalize("NFD", t))]
    # Most characters stay as they are and where they are, in both; those that move or decompose in one of them are compared one by one.
    moved = [c for c in every if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c))]
    quiet = sorted(set(every) - set(moved) - set(range(0xAC00, 0xD7A4)))
    still = "".join("a\u0345" + chr(c) for c in quiet), "".join("a" + chr(c) + "\u0334" for c in quiet)
    inert = set(_unlike(moved, *marks))
    known = all(nfd.normalize_str(t) == t for t in still) and not any(marks[0]([chr(c)]) != [chr(c), "a\u0345" + chr(c), "a" + chr(c) + "\u0334"] for c in inert)
    if [p for p, _ in split.pre_tokenize_str(rest)] != [rest] or not known:
        raise RuntimeError("the tokenizers library knows characters that this Python does not")
    parts = {c: unicodedata.normalize("NFD", chr(c)) for c in moved}
    old = {x for c, p in parts.items() if c not in inert for x in p}
    inert |= {ord(x) for c in inert for x in parts[c] if x not in old}
    shown = _ranges(sorted(inert))
    ours = regex.compile(f"([{shown}])") if shown else None
    if any(nfc.normalize_str(p) != _normal_form(p, ours) for p in parts.values()):
        raise RuntimeError("the tokenizers library composes characters unlike this Python")
    return {"lower": [[chr(c), lower.normalize_str(chr(c))] for c in changed], "no_letter": _ranges(wrong["no_letter"]), "no_digit": _ranges(wrong["no_digit"]), "inert": shown}


# ---------------------------------------------------------------- one file of tables


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max()) if len(words) else 0
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
    return flat.reshape(len(words), width), lengths


@lru_cache(4)
def compiled(path: str, words: tuple[bytes, ...] = ()) -> bytes:
    """All tables for the tokenizer file at ``path``, with ``words`` (byte strings as the pre-tokenizer gives them) added to the lexicon."""
    spec = json.loads(open(path, encoding="utf-8").read())
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    vocab: dict[str, int] = model["vocab"]
    symbols = byte_symbols()
    back = {s: b for b, s in enumerate(symbols)}
    pairs, merged = [], []
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append(vocab[a] * 65536 + vocab[b])
        merged.append(vocab[a + b])
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in [*vocab.items(), *added.items()]}
    shown = [names.get(i, "").encode() for i in range(max(names) + 1)]
    tables = {
        "pairs": np.array(pairs, np.int64), "pair_slots": slots_of(np.array(pairs, np.int64)), "ranks": np.arange(len(pairs), dtype=np.int32), "merged": np.array(merged, np.int32),
        "inner": np.array([vocab[s] for s in symbols], np.int32), "outer": np.array([vocab[s + end] for s in symbols], np.int32),
        "shown": np.frombuffer(b"".join(shown), np.uint8), "shown_ends": np.cumsum([len(s) for s in shown]).astype(np.int64),
        "special_ids": np.array(list(added.values()), np.int64), "special": np.frombuffer(json.dumps(list(added)).encode(), np.uint8),
        "letters": np.frombuffer(json.dumps(letter_notes(path)).encode(), np.uint8),
    }
    own = {bytes(back[c] for c in t.removesuffix(end)) for t in vocab if t.endswith(end) and t != end}
    lexicon = sorted(w for w in own | set(words) if 0 < len(w) <= 32)
    tables |= compile_words(lexicon)
    tables["edge_slots"] = slots_of(tables["edges"])
    tables["word_ids"], counts = merge_words(tables, *_matrix(lexicon))
    tables["word_ends"] = np.cumsum(counts)
    buffer = io.BytesIO()
    head = {}
    body = io.BytesIO()
    for name, x in tables.items():
        body.write(b"\0" * (-body.tell() % 16))
        head[name] = [str(x.dtype), list(x.shape), body.tell()]
        body.write(np.ascontiguousarray(x).tobytes())
    text = json.dumps(head).encode()
    buffer.write(len(text).to_bytes(8, "little") + text.ljust(-(-(len(text) + 8) // 16) * 16 - 8) + body.getvalue())
    return buffer.getvalue()


def mapped(path: str) -> dict[str, np.ndarray]:
    """The tables of a file with ``compiled``'s bytes, mapped into memory."""
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(bytes(data[:8]), "little")
    head, base = json.loads(bytes(data[8 : 8 + size])), -(-(size + 8) // 16) * 16
    out = {}
    for name, (kind, shape, at) in head.items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.asarray(data[base + at : base + at + n]).view(kind).reshape(shape)
    return out


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype, start: int = 0) -> None:
        self.data, self.size = np.zeros(1024, dtype), start

    def add(self, x: np.ndarray) -> None:
        need = self.size + len(x)
        if need > len(self.data):
            data = np.zeros(max(need, len(self.data) * 3 // 2), self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : need] = x
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.size]


_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
#: Class of each byte; the two bytes of the Latin-1 letters count as letters.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Second bytes after C3 of letters: all but the signs of multiplication and division.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_ONE, _TWO = np.frombuffer(b"stmd", np.uint8), (b"re", b"ve", b"ll")
LONG = 16


def segment(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as spans: (bytes in lower case, a space after each text; starts; ends; whether hard; words of each text).

    A hard span is a whole piece between white space with other characters than
    ASCII and the Latin-1 letters, or the opening of a special token; its bytes
    are as given.
    """
    n = len(offsets) - 1
    body = np.concatenate([np.insert(data, offsets[1:], 32), np.full(24, 32, np.uint8)])
    cls, low = _CLASS[body], _LOW[body]
    bad = np.zeros(len(body), bool)
    special = np.flatnonzero(body[:-1] == 60)
    bad[special[body[special + 1] == 124]] = True
    high = np.flatnonzero(body >= 0x80)
    if len(high):
        lead = high[body[high] == 0xC3]
        second = lead[_SECOND[body[lead + 1]]] + 1
        bad[high] = True
        bad[second - 1] = bad[second] = False
        low[second[body[second] <= 0x9E]] += 32
    change = np.empty(len(body), bool)
    if bad.any():
        solid = (cls != _SPACE).astype(np.int8)
        edge = np.diff(solid, prepend=np.int8(0))
        first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        hard = np.unique(np.searchsorted(first, np.flatnonzero(bad), "right") - 1)
        inside = C.ragged_index(first[hard], last[hard] - first[hard])
        cls[inside], low[inside] = _HARD, body[inside]
    change[0] = True
    change[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
    mark = np.flatnonzero((low[:-3] == 39) & change[:-3] & (cls[:-3] == _OTHER))
    if len(mark):
        a, b = low[mark + 1], low[mark + 2]
        letter, both = cls[mark + 1] == _LETTER, cls[mark + 2] == _LETTER
        one = mark[letter & np.isin(a, _ONE)]
        two = mark[letter & both & np.logical_or.reduce([(a == x) & (b == y) for x, y in _TWO])]
        change[one + 1] = change[two + 1] = False
        change[one + 2] = change[two + 3] = True
    cut = np.flatnonzero(change)
    own = cls[cut] != _SPACE
    starts, ends = cut[own], np.append(cut[1:], len(body))[own]
    edges = np.searchsorted(starts, offsets + np.arange(n + 1))
    return low, starts, ends, cls[starts] == _HARD, np.diff(edges)


class Encoder:
    """Ids of texts.  Every distinct word is encoded once and kept, up to ``keep`` of them."""

    def __init__(self, tables: dict[str, np.ndarray], keep: int = 1_500_000, show: bool = True) -> None:
        self.tables, self.keep, self.show = tables, keep, show
        self.special = dict(zip(json.loads(bytes(tables["special"])), tables["special_ids"].tolist(), strict=True))
        special = "|".join(map(regex.escape, self.special))
        self.split_special = regex.compile(f"({special})") if self.special else None
        notes = json.loads(bytes(tables["letters"]))
        self.lower = dict(notes["lower"])
        self.inert = regex.compile(f"([{notes['inert']}])") if notes["inert"] else None

        def class_of(kind: str, less: str) -> str:
            return rf"[[\p{{{kind}}}]--[{less}]]" if less else rf"[\p{{{kind}}}]"

        # The pre-tokenizer's pattern, with white space as Unicode has it, and the line feed that parts pieces here.
        letter, digit = class_of("L", notes["no_letter"]), class_of("N", notes["no_digit"])
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[^\p{{White_Space}}{letter}{digit}]+|\n", regex.V1)
        self.clear()

    def clear(self) -> None:
        self.ids, self.ends = Growing(np.int32), Growing(np.int64, 1)
        self.text, self.text_ends = Growing(np.uint8), Growing(np.int64, 1)
        # Short words are keys of two numbers and a length; longer ones and hard pieces are keys of a dictionary.
        self.first, self.second, self.length, self.row = Growing(np.uint64), Growing(np.uint64), Growing(np.uint8), Growing(np.int32)
        self.slots = np.full(1 << 16, -1, np.int32)
        self.other: dict[bytes, int] = {}

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = _normal_form(text, self.inert)
        # Characters are lowered one by one: a capital sigma would look at its neighbours.
        if "Σ" in text or any(c in text for c in self.lower):
            return "".join(self.lower[c] if c in self.lower else c.lower() for c in text)
        return text.lower()

    def _split(self, pieces: list[bytes]) -> list[str]:
        """Words of the pieces, each piece after a line feed; a special token is a word that starts with a line feed."""
        raw = b"\n".join(pieces).decode("utf-8", "replace")
        if self.split_special is None or not any(x in raw for x in self.special):
            return ["\n", *self.words.findall(self._normal(raw))]
        out = ["\n"]
        for part in self.split_special.split(raw):
            out += ["\n" + part] if part in self.special else self.words.findall(self._normal(part))
        return out

    # ------------------------------------------------------------ words that are new

    def _encoded(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that are spans of ``data``, one after the other, and their number in each."""
        rows, counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        ends, ids = self.tables["word_ends"], self.tables["word_ids"]
        for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 32)):
            fit = np.flatnonzero((lengths > lo) & (lengths <= hi))
            for i in range(0, len(fit), 1 << 14):
                own = fit[i : i + (1 << 14)]
                size = lengths[own]
                letters = np.zeros((len(own), hi), np.uint8)
                letters[np.arange(hi) < size[:, None]] = C.ragged(data, starts[own], size)
                place = look_up(self.tables, letters, size)
                hit = place >= 0
                start = np.where(place > 0, ends[np.maximum(place, 1) - 1], 0)[hit]
                n = ends[place[hit]] - start
                rows.append(own[hit])
                counts.append(n)
                flat.append(C.ragged(ids, start, n))
                if not hit.all():
                    got, n = merge_words(self.tables, letters[~hit], size[~hit])
                    rows.append(own[~hit])
                    counts.append(n)
                    flat.append(got)
        for r in np.flatnonzero(lengths > 32):
            got = merge_long(self.tables, data[starts[r] : starts[r] + lengths[r]].tobytes())
            rows.append(np.array([r]))
            counts.append(np.array([len(got)]))
            flat.append(np.array(got, np.int32))
        row, count, value = np.concatenate(rows), np.concatenate(counts), np.concatenate(flat)
        order = np.argsort(row, kind="stable")
        return C.ragged(value, (np.cumsum(count) - count)[order], count[order]), count[order]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for hard pieces."""
        tokens = self._split(pieces)
        body = [b"" if t[0] == "\n" else t.encode() for t in tokens]
        size = np.array(list(map(len, body)), np.int64)
        ids, n = self._encoded(np.frombuffer(b"".join(body) or b"\0", np.uint8), np.cumsum(size) - size, size)
        counts = np.zeros(len(tokens), np.int64)
        counts[size > 0] = n
        own = [i for i, t in enumerate(tokens) if t[0] == "\n" and len(t) > 1]
        ids = np.insert(ids, np.cumsum(counts)[own], [self.special[tokens[i][1:]] for i in own])
        counts[own] = 1
        first = np.flatnonzero([t == "\n" for t in tokens])
        return ids, np.add.reduceat(counts, first)

    def _append(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keep the ids of new words, and how they are shown; the words' rows."""
        row = self.ends.size - 1 + np.arange(len(counts), dtype=np.int32)
        upto = np.cumsum(counts)
        self.ends.add(self.ids.size + upto)
        self.ids.add(ids)
        if self.show:
            ends = self.tables["shown_ends"]
            stop = ends[ids]
            start = np.where(ids > 0, ends[np.maximum(ids, 1) - 1], 0)
            # Tokens with a space after each.
            body = np.append(self.tables["shown"], np.uint8(32))
            at = np.stack([start, np.full(len(ids), len(body) - 1)], 1).reshape(-1)
            size = np.stack([stop - start, np.ones(len(ids), np.int64)], 1).reshape(-1)
            self.text_ends.add(self.text.size + np.concatenate([[0], np.cumsum(stop - start + 1)])[upto])
            self.text.add(C.ragged(body, at, size))
        return row

    # ------------------------------------------------------------ words that are known

    def _hash(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (second ^ length) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)

    def _find(self, first: np.ndarray, second: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int32)
        last = np.uint64(len(self.slots) - 1)
        at, todo = (h & last).astype(np.int64), None
        a, b, n = self.first.all, self.second.all, self.length.all
        x, y, z = first, second, length
        while len(at):
            got = self.slots[at]
            some = got >= 0
            key = np.where(some, got, 0)
            same = some & (a[key] == x) & (b[key] == y) & (n[key] == z) if len(a) else some
            if todo is None:
                out = np.where(same, got, -1)
                todo = np.flatnonzero(some & ~same)
                on = todo
            else:
                out[todo[same]] = got[same]
                on = np.flatnonzero(some & ~same)
                todo = todo[on]
            at, x, y, z = (at[on] + 1) & int(last), x[on], y[on], z[on]
        return out

    def _short(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of words of at most LONG bytes; new ones are encoded."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        first = eight[starts] & KEEP[np.minimum(lengths, 8)]
        second = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(lengths > 8)
        second[more] = eight[starts[more] + 8] & KEEP[lengths[more] - 8]
        size = lengths.astype(np.uint8)
        h = self._hash(first, second, lengths.view(np.uint64))
        found = self._find(first, second, size, h)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((second[new], first[new], size[new]))]
            x, y, z = first[order], second[order], size[order]
            once = order[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))]
            place = self.first.size + np.arange(len(once), dtype=np.int32)
            self.first.add(first[once])
            self.second.add(second[once])
            self.length.add(size[once])
            self.row.add(self._append(*self._encoded(data, starts[once], lengths[once])))
            if 2 * self.first.size > len(self.slots):
                self.slots = np.full(1 << int(4 * self.first.size).bit_length(), -1, np.int32)
                a, b, n = self.first.all, self.second.all, self.length.all
                put, where = np.arange(len(a), dtype=np.int32), self._hash(a, b, n.astype(np.uint64))
            else:
                put, where = place, h[once]
            place_keys(self.slots, (where & np.uint64(len(self.slots) - 1)).astype(np.int64), put)
            found[new] = self._find(first[new], second[new], size[new], h[new])
        return self.row.all[found]

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """Rows of long words and hard pieces."""
        body = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = {x: (i, h) for i, (x, h) in enumerate(zip(body, hard.tolist(), strict=True)) if x not in self.other}
        if words := [x for x, (_, h) in new.items() if not h]:
            at = np.array([new[x][0] for x in words])
            self.other.update(zip(words, self._append(*self._encoded(data, starts[at], (ends - starts)[at])).tolist(), strict=True))
        if pieces := [x for x, (_, h) in new.items() if h]:
            self.other.update(zip(pieces, self._append(*self._pieces(pieces)).tolist(), strict=True))
        return np.array([self.other[x] for x in body], np.int32)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The known words of the texts, one after the other, and their number in each text."""
        if self.ends.size > self.keep:
            self.clear()
        low, starts, ends, hard, counts = segment(data, offsets)
        lengths = ends - starts
        other = hard | (lengths > LONG)
        rows = np.empty(len(starts), np.int32)
        rows[~other] = self._short(low, starts[~other], lengths[~other])
        if other.any():
            rows[other] = self._others(low, starts[other], ends[other], hard[other])
        return rows, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a buffer, one after the other, and their number in each text."""
        rows, counts = self.rows(data, offsets)
        return self._gather(rows, counts, self.ids.all, self.ends.all)

    @staticmethod
    def _gather(rows: np.ndarray, counts: np.ndarray, values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = ends[rows]
        size = ends[rows + 1] - start
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return C.ragged(values, start, size), np.diff(upto)

    def encode_and_show(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their number, bytes of the decoded texts, their number)."""
        rows, counts = self.rows(data, offsets)
        ids, n = self._gather(rows, counts, self.ids.all, self.ends.all)
        shown, m = self._gather(rows, counts, self.text.all, self.text_ends.all)
        some = m > 0
        last = np.cumsum(m)[some] - 1
        keep = np.ones(len(shown), bool)
        keep[last] = False  # no space after the last token
        return ids, n, shown[keep], m - some


# ---------------------------------------------------------------- tables

_sent: dict[tuple[str, str], str] = {}
_encoders: dict[tuple, Encoder] = {}
C.caches.append(_encoders.clear)


def send(spark: SparkSession, blob: bytes) -> str:
    """Give every executor one copy of a table file; its name there."""
    name = f"bpe-{hashlib.sha256(blob).hexdigest()[:24]}.tables"
    key = (spark.sparkContext.applicationId, name)
    if key not in _sent:
        path = Path(tempfile.mkdtemp(prefix="annalist-tables-")) / name
        path.write_bytes(blob)
        spark.sparkContext.addFile(str(path))  # as large as the vocabulary
        _sent[key] = name
    return name


def encoder_of(name: str, show: bool = True) -> Encoder:
    """The worker process's encoder for a file of ``send``."""
    if (name, show) not in _encoders:
        C.forget()
        _encoders[name, show] = Encoder(mapped(SparkFiles.get(name)), show=show)
    return _encoders[name, show]


def _texts(docs: DataFrame) -> DataFrame:
    C.ship(docs.sparkSession)
    return C.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequent_words(docs: DataFrame, most: int = 20_000) -> tuple[bytes, ...]:
    """The most frequent words of all texts, as the pre-tokenizer gives them: at most ``most``, all of the same class of counts or none.

    Counted in the tasks that read the texts and summed by one aggregate.  A
    histogram of the counts (a few hundred rows) sets the least count; only words
    with as many come to the driver.  Words of more than LONG bytes and of hard
    pieces are left to merging.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def summed() -> tuple[np.ndarray, ...]:
            x, y, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((y, x))
            x, y, n = x[order], y[order], n[order]
            first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            return x[first], y[first], np.add.reduceat(n, first)

        for batch in batches:
            data, offsets = C.text_buffers(batch.column(0))
            for i, j in C.slices(offsets, 2 << 20):
                low, starts, ends, hard, _ = segment(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = ends - starts
                own = ~hard & (size <= LONG)
                starts, size = starts[own], size[own]
                if not len(starts):
                    continue
                eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))
                held.append((eight[starts] & KEEP[np.minimum(size, 8)], np.where(size > 8, eight[starts + 8], 0) & KEEP[np.maximum(size - 8, 0)], np.ones(len(starts), np.int64)))
                if len(held) == 4:
                    held = [summed()]
                    if len(held[0][0]) > 500_000:
                        yield tallied(*held[0])
                        held = []
        if held:
            yield tallied(*summed())

    def tallied(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        body = np.stack([x, y], 1).astype("<u8").view("S16").reshape(-1)
        return pa.RecordBatch.from_arrays([pa.array(body.tolist(), pa.binary()), pa.array(n)], ["word", "n"])

    counts, path = C.stored(C.in_arrow(_texts(docs).select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    steps = counts.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    room, least = most, None
    for r in sorted(steps, reverse=True):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    found = counts.where(F.col("n") >= F.lit(least)).select("word").collect() if least is not None else []
    C.dropped(docs.sparkSession, path)
    return tuple(sorted(bytes(r["word"]) for r in found))


def bpe_encode(docs: DataFrame, path: str, words: tuple[bytes, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids (array<int>) and decoded (the tokens of the ids,
    joined by spaces, as the library decodes where the file names no decoder)
    per row.  Null text is empty and has no ids; a null doc_id stays null.  Rows
    may repeat; each is encoded by itself.  A text of any length is encoded
    whole, by itself if it is long.  An empty table gives an empty result.
    """
    tables = send(docs.sparkSession, compiled(path, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tables)
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.slices(offsets, 2 << 20):
                ids, n, shown, m = encoder.encode_and_show(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), arrays, C._cells(shown, np.cumsum(m)).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return C.in_arrow(_texts(docs), run, "doc_id long, n_tokens long, ids array<int>, decoded string", keep=True)
