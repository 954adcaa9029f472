"""Byte-pair encoding as a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges produce. It starts with one state
that loops on every byte. A merge (a, b) -> c adds a gadget: the target q of all a-arcs is copied
without its b-arc, the a-arcs are led to the copy, and every state with an a-arc gets a c-arc to
where b led from q. All arcs with one label therefore share one target, so a state is known by the
token that leads to it and the number of merges applied: its removed labels are those of the
gadgets on that token, and, from before it was made, those on its right part, and so on down that
spine. A new arc exists where the arc of its left part existed at that time. ``follows`` reads
this off the compiled tables and keeps each answer as an entry of the transition table.
"""

from __future__ import annotations

import json
import re

import regex

#: Fixed value: the published pattern that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII only, where it needs no Unicode classes.
SPLIT_ASCII = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Which byte each letter of the vocabulary file stands for: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    other = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(other)}


class TokenAutomaton:
    """Compiled from the contents of a byte-level BPE file with ``vocab`` and ``merges``."""

    def __init__(self, file: bytes, cache_words: int = 500_000):
        model = json.loads(file)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if all(c in letters for c in token):
                self.bytes_of[i] = bytes(letters[c] for c in token)
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[int, int] = {}  # (token, label) -> the merge whose gadget removed the label behind the token
        known = set(letters)
        for time, (a, b) in enumerate(pairs):
            c = a + b
            if a not in known or b not in known or a not in vocab or b not in vocab or c not in vocab:
                continue
            i, j, k = vocab[a], vocab[b], vocab[c]
            if not self._arc(i, j):  # q has no b-arc: the gadget changes nothing
                continue
            self.removed.setdefault(i << 20 | j, time)
            if c not in known:
                known.add(c)
                self.left[k], self.right[k], self.made[k] = i, j, time
        self.table: dict[int, bool] = {}
        self.prefix: dict[bytes, int] = {}  # every prefix of a token; the token's id, or -1
        for token in known:
            if token in vocab:
                word = self.bytes_of[vocab[token]]
                for n in range(1, len(word)):
                    self.prefix.setdefault(word[:n], -1)
                self.prefix[word] = vocab[token]
        self.words: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words
        self.split = regex.compile(SPLIT).findall
        self.split_ascii = re.compile(SPLIT_ASCII, re.ASCII).findall

    def _arc(self, state: int, label: int) -> bool:
        """Whether the state behind ``state`` has an arc ``label``."""
        made, right, left, removed = self.made, self.right, self.left, self.removed
        until = NEVER
        while True:
            at, limit = state, until
            while at >= 0:
                gone = removed.get(at << 20 | label)
                if gone is not None and gone < limit:
                    return False
                limit = min(limit, made[at]) if made[at] >= 0 else limit
                at = right[at]
            if made[label] < 0:
                return True
            until = min(until, made[label] + 1)
            label = left[label]

    def follows(self, state: int, label: int) -> bool:
        key = state << 20 | label
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            known = self.table[key] = self._arc(state, label)
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The one accepted path over ``word``: the longest arc first, leaving positions that led nowhere."""
        whole = self.prefix.get(word, -1)
        if whole >= 0:
            return (whole,)
        prefix, follows, n = self.prefix, self.follows, len(word)
        path: list[int] = []
        ends: list[int] = []
        options: list[list[tuple[int, int]]] = []
        dead: set[int] = set()

        def arcs(start: int) -> list[tuple[int, int]]:
            found = []
            for end in range(start + 1, n + 1):
                token = prefix.get(word[start:end])
                if token is None:
                    break
                if token >= 0:
                    found.append((end, token))
            return found  # the longest last, so that pop() takes it first

        options.append(arcs(0))
        while True:
            here = options[-1]
            while here:
                end, token = here.pop()
                if end in dead or (path and not follows(path[-1], token)):
                    continue
                path.append(token)
                ends.append(end)
                if end == n:
                    return tuple(path)
                options.append(arcs(end))
                break
            else:
                if not path:
                    raise ValueError("the vocabulary does not cover all bytes")
                options.pop()
                path.pop()
                # every prefix has one accepted path, so a position without a way on stays without one
                dead.add(ends.pop())

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self.words
        for word in self.split_ascii(text) if text.isascii() else self.split(text):
            found = words.get(word)
            if found is None:
                if len(words) >= self.cache_words:
                    words.clear()
                found = self.encode_word(word.encode("utf-8"))
                if len(word) <= 64:
                    words[word] = found
            ids += found
        return ids

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, emitted one after another."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


_compiled: dict[int, TokenAutomaton] = {}


def automaton(file: bytes) -> TokenAutomaton:
    """The automaton of a file's contents, compiled once in each Python worker."""
    key = hash(file)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = TokenAutomaton(file)
    return _compiled[key]


