"""Exact byte-pair encoding by backtracking.

A piece is scanned once with an Aho-Corasick automaton over the reversed vocabulary, which
yields every token that starts at every byte. The encoder takes the longest token, keeps it
if the pair it forms with its left neighbour is *compatible* (no merge of lower rank could
have crossed their border), else tries the next shorter one, and steps back where none is
left. Positions that failed are never tried again, so the work is linear in the piece. The
result equals that of replaying the merges.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np

#: White space as the tokenizers' patterns see it (property White_Space).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space with the visible run after it. Splitting into pieces never looks
#: beyond such a unit, so units can be cached whole.
UNIT = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
#: Pre-splitting pattern of the byte-level vocabularies.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+|[" + WS + r"]+(?![^" + WS + r"])|[" + WS + r"]+"


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id, and of each merged token the two ids it was merged from.

    A token is a string of symbols, one for each byte: the character of the byte's number, or of
    256 more for the byte that ends a word (``word_end``). ``normalizers`` are applied to a text
    one after the other, ``pattern`` finds its pieces.
    """

    tokens: list[str]
    left: np.ndarray
    right: np.ndarray
    pattern: str = PIECE
    normalizers: tuple[str, ...] = ()
    word_end: bool = False


def _lower(text: str) -> str:
    return text.replace("Σ", "σ").lower()  # every letter by itself, also a sigma that ends a word


_SPACES = re.compile(f"[{WS}]+")
NORMALIZERS = {
    "NFC": lambda t: t if t.isascii() else unicodedata.normalize("NFC", t),
    "Spaces": lambda t: _SPACES.sub(" ", t),
    "Lowercase": _lower,
}


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabulary files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    extra = (b for b in range(256) if b not in set(plain))
    letters.update((chr(256 + i), b) for i, b in enumerate(extra))
    return letters


def _merge_once(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 2:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _normalizers(spec: dict | None) -> tuple[str, ...]:
    """The normalizer of a vocabulary file as names in ``NORMALIZERS``."""
    if spec is None:
        return ()
    kind = spec.get("type")
    if kind == "Sequence":
        return tuple(x for part in spec["normalizers"] for x in _normalizers(part))
    if kind == "Replace" and spec.get("pattern") == {"Regex": "\\s+"} and spec.get("content") == " ":
        return ("Spaces",)
    if kind in ("NFC", "Lowercase"):
        return (kind,)
    raise ValueError(f"unknown normalizer {spec}")


def _pattern(spec: dict | None) -> str:
    """The pattern of a vocabulary file's pieces."""
    kind = (spec or {}).get("type")
    if kind == "ByteLevel" and spec.get("use_regex") and not spec.get("add_prefix_space"):
        return PIECE
    if kind == "Sequence" and [x.get("type") for x in spec["pretokenizers"]] == ["Split", "ByteLevel"]:
        split, level = spec["pretokenizers"]
        given = split["pattern"].get("Regex", "")
        whole = (split["behavior"], split["invert"], level["use_regex"], level["add_prefix_space"]) == ("Removed", True, False, False)
        if whole and given.count("\\s") == given.count("[^\\s"):  # white space only inside a class
            return given.replace("\\s", WS)
    raise ValueError(f"unknown splitting into pieces {spec}")


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level vocabulary: a ``.json`` with merges or a ``.tiktoken`` rank file.

    Of ``.json`` files the normalizer, the splitting into pieces and word ends are read too. What
    this encoder does not know, and ids that are no merge ranks, raise ValueError.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"no plain byte-pair model: {model.get('type')}, {odd}")
        letters, suffix = _byte_letters(), model.get("end_of_word_suffix") or ""

        def symbols(t: str) -> str | None:
            ends = bool(suffix) and t.endswith(suffix)
            t = t[: len(t) - len(suffix)] if ends else t
            if not t or any(c not in letters for c in t):
                return None
            plain = "".join(chr(letters[c]) for c in t)
            return plain[:-1] + chr(256 + ord(plain[-1])) if ends else plain

        ids = {s: i for t, i in model["vocab"].items() if (s := symbols(t)) is not None}
        size = max(ids.values()) + 1
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        tokens: list[str] = [""] * size
        for t, i in ids.items():
            tokens[i] = t
        last = -1
        for m in model["merges"]:
            a, b = (symbols(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i = ids[a + b]
            if left[i] < 0:  # a second way to merge a token never gets its turn
                left[i], right[i] = ids[a], ids[b]
                if i <= last:
                    raise ValueError("ids are not in the order of merges")
                last = i
        # special tokens have neither merges nor one byte: they are no text
        tokens = [t if len(t) == 1 or left[i] >= 0 else "" for i, t in enumerate(tokens)]
        merged = left >= 0
        if merged.any() and max((i for i, t in enumerate(tokens) if len(t) == 1), default=-1) > int(np.flatnonzero(merged)[0]):
            raise ValueError("ids are not in the order of merges")
        return Vocabulary(tokens, left, right, _pattern(spec.get("pre_tokenizer")), _normalizers(spec.get("normalizer")), bool(suffix))
    if not path.endswith(".tiktoken"):
        raise ValueError(f"no byte-level vocabulary: {path}")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = max(ranks.values()) + 1
    tokens = [""] * size
    left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    for t, i in ranks.items():
        tokens[i] = t.decode("latin-1")
        if len(t) > 1:
            a, b = _merge_once(t, ranks, i)
            left[i], right[i] = ranks[a], ranks[b]
    return Vocabulary(tokens, left, right)


class Encoder:
    """Backtracking encoder over one vocabulary, with bounded memories.

    ``memory`` bounds the number of remembered units; beyond it the memory starts anew, so a
    worker's footprint does not follow the corpus. Results never depend on it.
    """

    def __init__(self, vocabulary: Vocabulary, memory: int = 300_000):
        import ahocorasick
        import regex

        self.tokens = vocabulary.tokens
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.merged = {(a << 20) | b: i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        self.length = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single = [self.ids[chr(b)] for b in range(256)]
        self.ending = [self.ids[chr(256 + b)] for b in range(256)] if vocabulary.word_end else None
        for t, i in self.ids.items():
            if len(t) > 1:
                self.automaton.add_word(t[::-1], i)
        #: of each token the longest other token it begins with, -1 if none
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in self.tokens]
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.memory = memory
        self.find_pieces = regex.compile(vocabulary.pattern).findall
        self.normalizers = [NORMALIZERS[x] for x in vocabulary.normalizers]

    def split(self, text: str) -> list[str]:
        """The pieces of a text or unit, normalized."""
        for f in self.normalizers:
            text = f(text)
        return self.find_pieces(text)

    def _pair(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is what the merges leave of their joined bytes."""
        key = (a << 20) | b
        known = self.compatible.get(key)
        if known is not None:
            return known
        merged, left, right = self.merged, self.left, self.right
        bound, x, y, answer = 1 << 60, a, b, True
        while True:
            m = merged.get((x << 20) | y)
            if m is not None and m < bound:
                answer = False
                break
            # undo the later of the two merges; a base byte can't be undone
            undo_left = x > y
            if undo_left and left[x] < 0:
                undo_left = False
            elif not undo_left and left[y] < 0:
                undo_left = True
            if undo_left:
                if left[x] < 0:
                    break
                bound, x = x, right[x]
            else:
                if left[y] < 0:
                    break
                bound, y = y + 1, left[y]
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        symbols, ending = data.decode("latin-1"), self.ending
        if ending is not None:
            symbols = symbols[:-1] + chr(256 + data[-1])
        whole = self.ids.get(symbols)
        if whole is not None:
            return [whole]
        # longest[i]: the longest token that starts at byte i (of several ends the first is the longest)
        single, length = self.single, self.length
        longest = [single[b] for b in data]
        last = len(data) - 1
        if ending is not None:
            longest[last] = ending[data[last]]
        for end, token in self.automaton.iter(symbols[::-1]):
            if length[longest[last - end]] == 1:
                longest[last - end] = token
        out = [longest[0]]
        add, known, pair, shorter = out.append, self.compatible.get, self._pair, self.shorter
        previous = out[0]
        pos, n = length[previous], last + 1
        while pos < n:  # most pieces need no step back
            t = longest[pos]
            while True:
                ok = known((previous << 20) | t)
                if ok or (ok is None and pair(previous, t)):
                    break
                t = shorter[t]
                if t < 0:
                    return self._piece_with_steps_back(n, longest)
            add(t)
            pos += length[t]
            previous = t
        return out

    def _piece_with_steps_back(self, n: int, longest: list[int]) -> list[int]:
        pair, length, shorter = self._pair, self.length, self.shorter
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, t = 0, longest[0]
        while pos < n:
            previous = out[-1] if out else -1
            while t >= 0 and (dead[pos + length[t]] or (previous >= 0 and not pair(previous, t))):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                pos += length[t]
                t = longest[pos] if pos < n else -1
            elif out:
                dead[pos] = 1
                t = shorter[previous]
                pos -= length[out.pop()]
            else:
                raise ValueError("the vocabulary can't encode this piece")
        return out

    def unit(self, text: str) -> bytes:
        """Ids of one unit as little-endian int32, remembered."""
        known = self.units.get(text)
        if known is None:
            pieces, parts = self.pieces, []
            for p in self.split(text):
                ids = pieces.get(p)
                if ids is None:
                    ids = array("i", self.piece(p.encode("utf-8"))).tobytes()
                    if len(pieces) >= self.memory:
                        pieces.clear()
                    if len(p) < 200:
                        pieces[p] = ids
                parts.append(ids)
            known = b"".join(parts)
            if len(text) < 200:
                if len(self.units) >= self.memory:
                    self.units.clear()
                self.units[text] = known
        return known

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian int32; nothing for null and for the empty text."""
        if not text:
            return b""
        get, unit = self.units.get, self.unit
        return b"".join([get(u) or unit(u) for u in UNIT.findall(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()


class Decoder:
    """Decoding by an offset table: all tokens in one buffer, token ``i`` at ``offsets[i]``.

    A word's last token is followed by a space where the vocabulary marks word ends.
    """

    def __init__(self, vocabulary: Vocabulary):
        raw = [bytes(ord(c) & 255 for c in t) + (b" " if t and ord(t[-1]) > 255 else b"") for t in vocabulary.tokens]
        self.buffer = b"".join(raw)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).tolist()

    def decode_bytes(self, ids) -> bytes:
        """Bytes of a list of ids; null gives nothing. An id outside the table raises ValueError."""
        if ids is None:
            return b""
        o, b, size = self.offsets, self.buffer, len(self.offsets) - 1
        for i in ids:
            if i is None or not 0 <= i < size:
                raise ValueError(f"no token has id {i}")
        return b"".join([b[o[i] : o[i + 1]] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")
