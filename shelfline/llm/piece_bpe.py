"""Byte-pair merging of sentencepiece vocabularies in numpy: words are ragged rows of one flat symbol array, and a
round merges in all words at once.

A word's round takes its lowest-ranked adjacent pair. sentencepiece merges one pair at a time, the leftmost of the
lowest rank. All of a word's pairs of that rank are merged in one round, from the left without overlap, where no pair
that a merge makes can rank lower or equal; else only the leftmost is. So the result is the same, pair by pair."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

NONE = np.int32(2**31 - 1)  # the rank of what doesn't merge
_UNKNOWN = 1 << 22  # symbols from here on are characters outside of the vocabulary
SPACE = "▁"
#: Words longer than this are cut first where no piece can span; what is still longer than LONGEST is merged singly.
LONG, LONGEST = 64, 4096


class PieceVocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        every = range(self.size)
        self.pieces = [model.id_to_piece(i) for i in every]
        plain = {self.pieces[i]: i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.bytes_of = [b""] * self.size
        for piece, i in plain.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])

        characters = sorted({c for p in plain for c in p})
        extra = [c for c in characters if c not in plain]
        self.extra = extra  # characters that only occur inside longer pieces
        symbol = plain | {c: self.size + k for k, c in enumerate(extra)}
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + _UNKNOWN
        for c in characters:
            self.symbol_of[ord(c)] = symbol[c]

        scores = {i: model.get_score(i) for i in plain.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (order[scores[i]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = keys
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int32)  # the last: no such pair
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [0], np.int64)
        # ranks after whose merge a neighbouring pair may rank as low
        own = np.full(_UNKNOWN, NONE, np.int64)
        for i in plain.values():
            if len(self.pieces[i]) > 1:
                own[i] = order[scores[i]]
        self.careful = np.zeros(len(order) + 1, bool)
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            low = (own[side] != NONE) & (self.ranks[:-1] <= own[side])
            self.careful[own[side[low]]] = True
        self.spans = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}  # character pairs inside pieces
        self._slots()

    def _slots(self) -> None:
        """An open-addressed table of the pairs: a look-up reads a slot or two in place of a binary search."""
        bits = max(8, (4 * len(self.keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, len(self.keys), np.int32)
        todo, step = np.arange(len(self.keys)), 0
        at = self._hash(self.keys)
        self.steps = 1
        while len(todo):
            slot = (at[todo] + step) & self.mask
            free = self.table[slot] == len(self.keys)
            first = np.unique(slot[free], return_index=True)[1]
            put = todo[free][first]
            self.table[(at[put] + step) & self.mask] = put
            todo = np.setdiff1d(todo, put)
            # what lost its slot tries the next one
            step += 1
        self.steps = step
        self.padded = np.append(self.keys, -1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair its number, or the last number where it isn't a pair."""
        keys = (left << 32) | right
        at = self._hash(keys)
        none = len(self.keys)
        got = self.table[at]
        found = np.where(self.padded[got] == keys, got, none)
        again = np.flatnonzero((found == none) & (got != none))
        for step in range(1, self.steps):
            if not len(again):
                break
            got = self.table[(at[again] + step) & self.mask]
            hit = self.padded[got] == keys[again]
            found[again[hit]] = got[hit]
            again = again[~hit & (got != none)]
        return found

    def units(self, word: str) -> list[str]:
        """A word, or if it is long its parts between characters that no piece has side by side."""
        if len(word) <= LONG:
            return [word]
        cuts = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.spans]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, one word after another, and how many each word has."""
        units, owner = [], []
        for k, word in enumerate(words):
            for unit in self.units(word):
                units.append(unit)
                owner.append(k)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        text = "".join(units)
        flat = self.symbol_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        done_symbols, done_rows = [], []
        huge = lengths > LONGEST
        rows = np.repeat(np.arange(len(units)), lengths)
        for k in np.flatnonzero(huge):
            single = self._one_by_one(flat[rows == k])
            done_symbols.append(single)
            done_rows.append(np.full(len(single), k))
        if huge.any():
            flat, rows = flat[~huge[rows]], rows[~huge[rows]]
        while len(flat):
            last = np.empty(len(rows), bool)
            last[-1] = True
            np.not_equal(rows[:-1], rows[1:], out=last[:-1])
            pair = np.full(len(flat), len(self.keys), np.int32)
            inner = np.flatnonzero(~last)
            pair[inner] = self._find(flat[inner], flat[inner + 1])
            flat, rows = self._rounds(flat, rows, pair, last, done_symbols, done_rows)
        symbols, rows = np.concatenate([*done_symbols, np.zeros(0, np.int64)]), np.concatenate([*done_rows, np.zeros(0, np.int64)])
        order = np.argsort(rows, kind="stable")
        counts = np.bincount(np.array(owner, np.int64)[rows], minlength=len(words)) if len(rows) else np.zeros(len(words), np.int64)
        return symbols[order], counts

    def _rounds(self, flat, rows, pair, last, done_symbols, done_rows):
        """Merge rounds until every word is finished; finished words are taken out of the arrays."""
        while len(flat):
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            sizes = np.diff(np.r_[starts, len(flat)])
            rank = self.ranks[pair]
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                out = np.repeat(over, sizes)
                done_symbols.append(flat[out])
                done_rows.append(rows[out])
                stay = ~out
                flat, rows, pair, last, rank = flat[stay], rows[stay], pair[stay], last[stay], rank[stay]
                sizes, least = sizes[~over], least[~over]
                if not len(flat):
                    break
            local = np.repeat(np.arange(len(sizes)), sizes)
            hits = np.flatnonzero(rank == least[local])
            # of hits side by side every second one, from the left
            opens = np.r_[True, np.diff(hits) > 1]
            run = np.maximum.accumulate(np.where(opens, np.arange(len(hits)), 0))
            take = (np.arange(len(hits)) - run) % 2 == 0
            careful = self.careful[least]
            if careful.any():
                word = local[hits]
                take &= ~careful[word] | np.r_[True, word[1:] != word[:-1]]
            at = hits[take]
            flat[at] = self.merged[pair[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            flat, rows, pair, last = flat[stay], rows[stay], pair[stay], last[stay]
            new = at - np.arange(len(at))
            before = new[new > 0] - 1
            touched = np.unique(np.r_[new, before[~last[before]]])
            ends = last[touched]
            pair[touched[ends]] = len(self.keys)
            inner = touched[~ends]
            pair[inner] = self._find(flat[inner], flat[inner + 1])
        return flat, rows

    def _one_by_one(self, flat: np.ndarray) -> np.ndarray:
        """The same for one very long unit, with a heap: n log n steps where rounds could take n times n."""
        symbols = flat.tolist()
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self._find(flat[:-1], flat[1:])
        heap = [(int(self.ranks[p]), i, symbols[i], symbols[i + 1]) for i, p in enumerate(first) if p != len(self.keys)]
        heapq.heapify(heap)
        number = {k: i for i, k in enumerate(self.keys.tolist())}
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = int(self.merged[number[(left << 32) | right]])
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := number.get((symbols[a] << 32) | symbols[b])) is not None:
                    heapq.heappush(heap, (int(self.ranks[p]), a, symbols[a], symbols[b]))
        return np.array([s for s, x in zip(symbols, alive) if x], np.int64)

    def ids(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word; characters outside of the vocabulary become the ids of their UTF-8 bytes."""
        symbols, counts = self.symbols(words)
        ends = np.cumsum(counts)
        strange = np.flatnonzero(symbols >= self.size)
        flat = symbols.tolist()
        bounds = list(zip((ends - counts).tolist(), ends.tolist()))
        got = [flat[a:b] for a, b in bounds]
        for k in np.unique(np.searchsorted(ends, strange, side="right")).tolist():
            got[k] = [i for s in got[k] for i in ([s] if s < self.size else self._fallback(s))]
        return got

    def token_counts(self, words: list[str]) -> list[int]:
        """How many ids each word has, without making them: surviving symbols, and bytes of unknown characters."""
        symbols, counts = self.symbols(words)
        strange = np.flatnonzero(symbols >= self.size)
        if len(strange):
            more = np.array([len(self._fallback(s)) - 1 for s in symbols[strange].tolist()])
            counts = counts + np.bincount(np.searchsorted(np.cumsum(counts), strange, side="right"), more, len(words)).astype(np.int64)
        return counts.tolist()

    def _fallback(self, symbol: int) -> list[int]:
        character = chr(symbol - _UNKNOWN) if symbol >= _UNKNOWN else self.extra[symbol - self.size]
        return [int(self.byte_ids[b]) for b in character.encode()]

    def decoded(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_TOKEN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The runs that no piece spans: spaces and what follows them, of the text with the dummy space in front; each
    without its first space. An empty text has none."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [m[1:] for m in _TOKEN.findall(" " + text)]
    return text.split(" ") if text else []


def marked(words: list[str]) -> list[str]:
    """Pre-tokens as the vocabulary writes them."""
    return [SPACE + w.replace(" ", SPACE) for w in words]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)
