"""Byte-level BPE: exact prefix states of words, shared by the token operators.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are: joined and merged
alone, they come apart into the same two tokens. So the last token of a prefix is found from the last
tokens of shorter prefixes, and every prefix of a word has a known last token and token count. Where the whole word
alone is asked for, a depth-first search over the trie of the vocabulary finds the one sequence whose neighbours all are.
"""

from __future__ import annotations

import array
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import regex

#: Fixed value: the split pattern of byte-level BPE pre-tokenisers. ``\s`` is Unicode white space there.
SPLIT_TEXT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(SPLIT_TEXT.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: Pieces never cross a single space between two visible characters.
_EDGE, _RUN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")
#: Contractions that are another piece when they are cut, and runs of white space.
_CUT, _RUNS = {"'re", "'ve", "'ll"}, regex.compile(r"\p{White_Space}{2,}")
#: Bytes that a worker remembers of words and of chunks; longer strings than ``LONG`` characters are never remembered.
WORD_BYTES, CHUNK_BYTES, HEAD_BYTES, LONG = 216 << 20, 216 << 20, 48 << 20, 48
#: The rank of pairs that never merge.
_NONE = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def chunks(text: str) -> list[str]:
    """Split at single spaces between visible characters; all but the first chunk have lost their leading space."""
    if _RUN.search(text) or text[:1] == " " or text[-1:] == " ":
        return _EDGE.split(text)
    return text.split(" ")


class Remembered(dict):
    """What is known of strings, up to about ``most`` bytes. Long strings stay until ``forget`` only: each is rarely met again, and texts without spaces are one."""

    def __init__(self, most: int):
        self.most, self.held, self.passing = most, 0, []

    def put(self, key: str, value: tuple | array.array) -> None:
        """Know a string, at least until ``forget``."""
        self[key] = value
        if len(key) > LONG:
            self.passing.append(key)
        else:
            self.held += 200 + 8 * len(key) + 8 * len(value)

    def keep(self, key: str, value: tuple | array.array) -> None:
        """Know a string if there is room."""
        if len(key) <= LONG and self.held <= self.most:
            self.put(key, value)

    def forget(self) -> None:
        for key in self.passing:
            self.pop(key, None)
        self.passing.clear()

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file with byte-level BPE."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()} | {-1: 0}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank[self.ids[bytes(map(letters.get, a))], self.ids[bytes(map(letters.get, b))]] = (r, self.ids[bytes(map(letters.get, a + b))])
        # a token by the two that its last merge joins
        self.parts = {joined: (r, a, b) for (a, b), (r, joined) in self.rank.items()}
        self.one_way = len(self.parts) == len(self.rank)
        # pairs that merge, sorted, with their ranks; what each rank gives; the ids of single bytes
        known = sorted((a << 20 | b, r) for (a, b), (r, _) in self.rank.items())
        self.pairs, self.ranks = np.array(known or [(-1, 0)], np.int64).T.copy()
        self.joined = np.zeros(len(merges) + 1, np.int64)
        for r, i in self.rank.values():
            self.joined[r] = i
        self.byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.first, self.later = Remembered(WORD_BYTES), Remembered(HEAD_BYTES), Remembered(CHUNK_BYTES)

    @cached_property
    def trie(self) -> tuple[dict[int, int], list[int]]:
        """The trie of all tokens: the node that a node and a byte lead to, and the token of each node, or -1."""
        steps, token_at = {}, [-1]
        for token, i in self.ids.items():
            node = 0
            for byte in token:
                found = steps.get(node << 8 | byte)
                if found is None:
                    found = steps[node << 8 | byte] = len(token_at)
                    token_at.append(-1)
                node = found
            token_at[node] = i
        return steps, token_at

    def merged(self, data: bytes) -> list[int]:
        """BPE of a short byte string by repeated lowest-rank merges."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best, at = min(((self.rank.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best == 1 << 60:
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        whole = self.one_way and self.whole(a) and self.whole(b)
        found = self._fits[a << 20 | b] = self.apart(a, b) if whole else self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge joins the end of a with the begin of b, both being encodings of their bytes by one way of merging.

        Their merges are taken back, the latest first; between the parts left at the seam, none may come before what was taken
        back last. Of two merges of one rank the left one comes first.
        """
        rank, parts, byte, limit = self.rank.get, self.parts.get, (-1, -1, -1), 1 << 60
        while True:
            across = rank((a, b))
            if across is not None and across[0] < limit:
                return False
            (ra, _, end), (rb, begin, _) = parts(a, byte), parts(b, byte)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, end
            else:
                limit, b = rb + 1, begin

    def whole(self, a: int) -> bool:
        found = self._whole.get(a)
        if found is None:
            found = self._whole[a] = self.merged(self.bytes_of[a]) == [a]
        return found

    def extend(self, word: bytes, last: list[int], counts: list[int]) -> None:
        """Add the last token and token count of every prefix of word that is longer than those in ``last``.

        One token fits only, so the order of trying is free: the token before, grown by a byte; the byte
        alone; then all others.
        """
        known, fits, sizes, token_of = self._fits.get, self.fits, self.sizes, self.ids.get
        grown = len(last) - 1 - sizes[last[-1]]
        for end in range(len(last), len(word) + 1):
            for begin in (grown, end - 1):
                token = token_of(word[begin:end])
                if token is not None:
                    if begin:
                        ok = known(last[begin] << 20 | token)
                        if ok is None:
                            ok = fits(last[begin], token)
                    else:
                        ok = self.whole(token)
                    if ok:
                        break
            else:
                for begin in range(max(0, end - self.longest), end - 1):
                    token = token_of(word[begin:end])
                    if token is not None:
                        if begin:
                            ok = known(last[begin] << 20 | token)
                            if ok is None:
                                ok = fits(last[begin], token)
                        else:
                            ok = self.whole(token)
                        if ok:
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            counts.append(counts[begin] + 1)
            grown = begin

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of a chunk in order; special strings come as their ids."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in (",", ".") and body[:-1].isalpha():
            return [chunk[:-1], body[-1]]
        if self._special is None or not self._special.search(chunk):
            return SPLIT.findall(chunk)
        out: list[str | int] = []
        for part in self._special.split(chunk):
            out += [self.special[part]] if part in self.special else SPLIT.findall(part)
        return out

    def starts(self, word: bytes, at: int) -> list[int]:
        """The tokens that begin at a place of the word, shorter ones first."""
        (steps, token_at), node, found = self.trie, 0, []
        for byte in word[at : at + self.longest]:
            node = steps.get(node << 8 | byte)
            if node is None:
                break
            if token_at[node] >= 0:
                found.append(token_at[node])
        return found

    def searched(self, word: bytes) -> tuple[int, ...]:
        """BPE of a word by depth-first search over the trie: the longest token that fits the one before is tried first.

        A place from which the end is out of reach is left for good: whatever leads to it is the encoding of the same prefix.
        """
        known, fits, sizes = self._fits.get, self.fits, self.sizes
        n, at, ids, untried, dead = len(word), 0, [], [self.starts(word, 0)], set()
        while at < n:
            left = untried[-1]
            while left:
                token = left.pop()
                end = at + sizes[token]
                if end in dead:
                    continue
                if ids:
                    ok = known(ids[-1] << 20 | token)
                    if ok is None:
                        ok = fits(ids[-1], token)
                else:
                    ok = self.whole(token)
                if ok:
                    ids.append(token)
                    untried.append(self.starts(word, end) if end < n else [])
                    at = end
                    break
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                untried.pop()
                at -= sizes[ids.pop()]
        return tuple(ids)

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.pairs, pairs)
        place[place == len(self.pairs)] = 0
        return np.where(self.pairs[place] == pairs, self.ranks[place], _NONE)

    def merged_together(self, words: list[str]) -> list[tuple[int, ...]]:
        """BPE of many short words at once: in every round each word makes its merge of lowest rank, the leftmost one of equals.

        Rounds are as many as a word has merges, and a word leaves when it has none left.
        """
        out: list[tuple[int, ...]] = [()] * len(words)
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        own, starts = np.arange(len(words)), np.cumsum(lengths) - lengths
        rank = self.ranks_of(np.append(ids[:-1] << 20 | ids[1:], 0))
        while len(own):
            rank[starts + lengths - 1] = _NONE  # nothing of its word follows the last id
            least = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            at, some = least & 0xFFFFFFFF, least < _NONE << 32
            if not some.all():
                for i, b, n in zip(own[~some].tolist(), starts[~some].tolist(), lengths[~some].tolist()):
                    out[i] = tuple(ids[b : b + n].tolist())
            at = at[some]
            ids[at] = self.joined[rank[at]]
            stay = np.repeat(some, lengths)
            at = np.cumsum(stay)[at] - 1 - np.arange(len(at))  # the place after this round: a row goes for each merge before it
            stay[least[some] + 1 & 0xFFFFFFFF] = False
            ids, rank, own, lengths = ids[stay], rank[stay], own[some], lengths[some] - 1
            starts = np.cumsum(lengths) - lengths
            for changed in (np.maximum(at - 1, 0), at):
                rank[changed] = self.ranks_of(ids[changed] << 20 | ids[np.minimum(changed + 1, len(ids) - 1)])
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, by chunks whose ids are remembered; each new word is searched for once."""
        split = [chunks(t) for t in texts]
        for known in (self.words, self.first, self.later):
            known.trim()
        heads = [s.pop(0) for s in split]
        new = [(self.later, c, " " + c) for c in set(chain.from_iterable(split)).difference(self.later)]
        new += [(self.first, c, c) for c in set(heads).difference(self.first)]
        parts = [self.pieces(c) for _, _, c in new]
        words = self.words
        unknown = {p for ps in parts for p in ps if isinstance(p, str)}.difference(words)
        for word in unknown:
            if len(word) > LONG:
                words.put(word, self.searched(word.encode()))
        short = [w for w in unknown if len(w) <= LONG]
        for word, ids in zip(short, self.merged_together(short)):
            words.put(word, ids)
        for (cache, key, _), ps in zip(new, parts):
            cache.put(key, words[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else tuple(i for p in ps for i in (words[p] if isinstance(p, str) else (p,))))
        try:
            for head, s in zip(heads, split):
                ids = list(self.first[head])
                ids.extend(chain.from_iterable(map(self.later.__getitem__, s)))
                yield ids
        finally:
            for known in (self.words, self.first, self.later):
                known.forget()

    def piece_counts(self, piece: str) -> array.array:
        """Token count of every non-empty prefix of a piece, in bytes."""
        counts = self.words.get(piece)
        if counts is None:
            found = [0]
            self.extend(piece.encode(), [-1], found)
            counts = array.array("i", found[1:])
            self.words.keep(piece, counts)
        return counts

    def prefix_counts(self, chunk: str) -> tuple[bytes, int]:
        """Token count of every non-empty prefix of a chunk, as 4-byte integers, and the whole count.

        A prefix is split as a text of its own: white space at its end is one piece, however the whole chunk splits
        it, a contraction that is cut falls into apostrophe and letter, and a special string that is cut is plain text.
        """
        parts = self.pieces(chunk)
        if len(parts) == 1 and isinstance(parts[0], str) and parts[0] not in _CUT:
            counts = self.piece_counts(parts[0])
            return counts.tobytes(), counts[-1]
        out, base, begin, segment = array.array("i"), 0, 0, (0, 0)
        for piece in parts:
            if isinstance(piece, int):
                special = self.bytes_of[piece].decode()
                since = chunk.encode()[segment[0] : len(out)].decode()
                for n in range(1, len(special)):
                    cut = segment[1] + sum(self.piece_counts(p)[-1] for p in SPLIT.findall(since + special[:n]))
                    out.extend([cut] * len(special[n - 1].encode()))
                base += 1
                out.extend([base] * len(special[-1].encode()))
                segment = len(out), base
                continue
            counts = self.piece_counts(piece)
            begin = len(out)
            out.extend([base + c for c in counts] if base else counts)
            if piece in _CUT:
                out[begin + 1] = base + 2
            base += counts[-1]
        for run in _RUNS.finditer(chunk):
            at = len(chunk[: run.start()].encode())
            before = out[at - 1] if at else 0
            counts = self.piece_counts(run.group())
            out[at : at + len(counts)] = array.array("i", [before + c for c in counts])
        return out.tobytes(), base


_loaded: dict[tuple[int, str], Vocabulary] = {}


def vocabulary(raw: str, use: str) -> Vocabulary:
    """One vocabulary for each file and use in a Python worker."""
    key = (hash(raw), use)
    if key not in _loaded:
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def in_groups(texts: Iterable, size: int = 2_000_000) -> Iterator[slice]:
    """Slices of consecutive texts of about ``size`` characters, so that memory is bounded by it and the longest text."""
    begin, total, at = 0, 0, 0
    for at, t in enumerate(texts, 1):
        total += len(t)
        if total >= size:
            yield slice(begin, at)
            begin, total = at, 0
    if begin < at:
        yield slice(begin, at)
