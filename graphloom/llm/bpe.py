"""Exact byte-pair encodings by dynamic programming over prefixes.

A greedy byte-pair encoding has a property that makes a left-to-right programme
possible: the encoding of a prefix that ends at a token boundary is a prefix of
the encoding, and a sequence of tokens is an encoding exactly if each adjacent
pair is the encoding of its own concatenation.  So each position has one last
token: the one whose predecessor, the last token of the shorter prefix, may
stand before it.  The programme keeps one token, one back pointer and one count
for each position and never revisits the text.

``MergeTable`` answers whether two tokens may be neighbours, by running the
merges on the two alone; answers are remembered.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import regex

#: The split of text before byte-level merges: fixed values of the file format.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


class MergeTable:
    """Whether two tokens stay apart when the merges run on their concatenation.

    ``rank(left, right)`` gives the priority of a merge, smaller first, or None.
    Equal priorities merge from the left.  A token's derivation gives, for the
    symbols that stand at its right (left) end while it is built, the ranks at
    which each is made and is taken up by the next.  The seam between two tokens
    closes early exactly if a symbol of the one's right end and a symbol of the
    other's left end stand there together at the rank of their own merge.
    """

    LIMIT = 1_000_000
    NEVER = float("inf")

    def __init__(self, rank: Callable, atoms: Callable):
        self.rank, self.atoms = rank, atoms
        self.ends: dict = {}
        self.known: dict = {}

    def merge(self, parts: list) -> list[tuple]:
        """All merges on ``parts``: trees (symbol, rank, left tree, right tree)."""
        trees = [(p, -1, None, None) for p in parts]
        n = len(trees)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (r := self.rank(trees[i][0], trees[j][0])) is not None:
                heapq.heappush(queue, (r, i, id(trees[i]), j, id(trees[j])))

        for i in range(n - 1):
            offer(i)
        kept = list(trees)  # no id is used twice
        while queue:
            r, i, a, j, b = heapq.heappop(queue)
            if trees[i] is None or id(trees[i]) != a or j >= n or trees[j] is None or id(trees[j]) != b or right[i] != j:
                continue
            trees[i], trees[j] = (trees[i][0] + trees[j][0], r, trees[i], trees[j]), None
            kept.append(trees[i])
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t in trees if t is not None]

    def _ends(self, token):
        """Symbols at the right and the left end with their first and last rank; None if merges never make the token."""
        if (found := self.ends.get(token, 0)) != 0:
            return found
        trees = self.merge(self.atoms(token))
        if len(trees) != 1:
            self.ends[token] = None
            return None
        sides = []
        for side in (3, 2):
            tree, until, spine = trees[0], self.NEVER, []
            while tree is not None:
                spine.append((tree[0], tree[1], until))
                until, tree = tree[1], tree[side]
            sides.append(spine)
        self.ends[token] = sides
        return sides

    def made(self, token) -> bool:
        return self._ends(token) is not None

    def apart(self, a, b) -> bool:
        """``parted``, remembered."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[(a, b)] = self.parted(a, b)
        return found

    def parted(self, a, b) -> bool:
        """Both tokens must be ``made``."""
        rank = self.rank
        for x, born, until in self._ends(a)[0]:
            for y, born2, until2 in self._ends(b)[1]:
                if (r := rank(x, y)) is not None and born < r < until and born2 < r <= until2:
                    return False
        return True


def byte_alphabet() -> dict[str, int]:
    """Character to byte, as byte-level vocabularies print their tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(map(chr, plain), plain, strict=True))
    rest = [b for b in range(256) if b not in set(plain)]
    return shown | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteCounter:
    """Token counts of every prefix, for a byte-level vocabulary in a .json file."""

    MEMO = 500_000
    #: Pairs of tokens that are remembered, and characters of a piece that is.
    PAIRS, LONG = 1_000_000, 64

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = byte_alphabet()
        raw = lambda token: bytes(shown[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        ranks = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[(raw(a), raw(b))] = r
        self.table = MergeTable(lambda a, b: ranks.get((a, b)), lambda token: [token[i : i + 1] for i in range(len(token))])
        self.arcs = ahocorasick.Automaton()
        self.after: list[dict] = []  # by token: the tokens before it, and whether the two stay apart
        self.pairs = 0
        for token in self.ids:  # bytes as characters of the same number
            self.after.append({})
            self.arcs.add_word(token.decode("latin-1"), (token, len(token), self.after[-1]))
        self.arcs.make_automaton()
        self.pieces = regex.compile(BYTE_LEVEL_SPLIT).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.memo: dict[str, int] = {}  # of stretches between spaces
        self.known: dict[str, int] = {}  # of pieces

    def programme(self, word: bytes) -> list[int]:
        """Counts of all prefixes of one piece, from the empty one on.

        One pass of an automaton gives the tokens that end at each byte, the longest
        first; the first that stays apart from the last token before it is the one.
        """
        n = len(word)
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        allowed = self._allowed
        for at, (token, size, after) in self.arcs.iter(word.decode("latin-1")):
            end = at + 1
            if not last[end]:
                before = last[end - size]
                if after[before] if before in after else allowed(before, token, after):
                    last[end] = token
                    counts[end] = counts[end - size] + 1
        if not all(last[1:]):
            raise ValueError("the vocabulary lacks a byte")
        return counts

    def _allowed(self, before: bytes, token: bytes, after: dict) -> bool:
        """Whether ``token`` may stand after ``before``; remembered with the token."""
        if self.pairs >= self.PAIRS:
            for known in self.after:
                known.clear()
            self.pairs = 0
        self.pairs += 1
        table = self.table
        after[before] = out = table.made(token) and (not before or table.parted(before, token))
        return out

    def _chunk(self, chunk: str, space: str) -> int:
        """Tokens of ``chunk`` after ``space``; -1 if white space before or in it runs together."""
        if space and (not chunk or chunk[0].isspace()):
            n = -1
        else:
            n = 0
            for piece in self.pieces(space + chunk):
                if (own := self.known.get(piece)) is None:
                    own = self.programme(piece.encode("utf-8", "surrogatepass"))[-1]
                    if len(piece) <= self.LONG:
                        if len(self.known) >= self.MEMO:
                            self.known.clear()
                        self.known[piece] = own
                n += own
        if space and len(chunk) <= self.LONG:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[chunk] = n
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A single space before a character that isn't white space always starts a
        piece, so the stretches between such spaces are counted one by one.
        """
        memo, slow = self.memo, self._chunk
        first, *rest = text.split(" ")
        counts = [memo[c] if c in memo else slow(c, " ") for c in rest]
        if not counts or min(counts) >= 0:
            return sum(counts) + (slow(first, "") if first else 0)
        total, held = 0, first  # runs of white space: put back together what a split has parted
        for chunk, n in zip(rest, counts, strict=True):
            if n < 0:
                held += " " + chunk
            else:
                total += slow(held, "")
                held = " " + chunk
        return total + slow(held, "")

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; none for a null."""
        if not text:
            return 0
        if not any(s in text for s in self.special):
            return self._plain(text)
        return sum(k % 2 or self._plain(part) for k, part in enumerate(self.split_special(text)))

    def _prefixes(self, text: str) -> Iterator[tuple[str, int, list[int]]]:
        """The pieces of a text without special strings, the tokens before each, and the programme of each."""
        done = 0
        for piece in self.pieces(text):
            counts = self.programme(piece.encode("utf-8", "surrogatepass"))
            yield piece, done, counts
            done += counts[-1]

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of the text cut after 0, 1, 2, ... code points.

        Each piece's programme is run once and gives every cut inside it.  Three kinds
        of cut change the split itself, of a few characters before the cut: inside a
        contraction, after the space that a word takes from a run of white space, and
        inside a special string.  Of these the last pieces are counted as the shorter
        text is split.
        """
        out, done, before, tail = [0], 0, 0, ""
        text = text or ""
        for k, part in enumerate(self.split_special(text) if self.split_special else [text]):
            if k % 2:
                for i in range(1, len(part)):
                    out.append(before + self._plain(tail + part[:i]))
                done += 1
                out.append(done)
                continue
            base, run, before_run = done, "", done
            near = [(done, "")]  # the last pieces, and the tokens before them
            for piece, upto, counts in self._prefixes(part):
                done = base + upto
                near = [*near[-2:], (done, piece)]
                at = 0
                for i, c in enumerate(piece):
                    at += len(c.encode("utf-8", "surrogatepass"))
                    if run and i == 0 and c.isspace() and len(piece) > 1:
                        out.append(before_run + self._plain(run + c))
                    elif piece[0] == "'" and 0 < i < len(piece) - 1:
                        out.append(done + self._plain(piece[: i + 1]))
                    else:
                        out.append(done + counts[at])
                if piece.isspace():
                    before_run, run = (before_run, run + piece) if run else (done, piece)
                else:
                    run = ""
                done += counts[-1]
                if piece.isspace() and run != piece:
                    out[-1] = before_run + self._plain(run)
            before, tail = near[0][0], "".join(p for _, p in near)
        return out
