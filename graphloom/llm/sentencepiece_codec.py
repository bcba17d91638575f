"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has one node for each position between characters and one arc for
each vocabulary piece.  For a byte-pair model an arc may follow another exactly
if the merges keep the two pieces apart (see ``bpe.MergeTable``), so at each
node one arc survives.  Back pointers are kept for the part of the text that is
not yet settled: an arc spans at most the longest piece, hence as soon as the
paths of all nodes within that reach meet on one boundary, the ids before it
are final and are committed.

A unigram model is searched the same way with the pieces' scores as weights.

The ids equal those of the sentencepiece library for models with the identity
normaliser, a dummy prefix and kept white space; anything else raises.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField

from .bpe import SPACE, MergeTable
from .batches import map_text


class Viterbi:
    """The search over one run of characters without a space inside.

    One pass of an automaton over the text gives the arcs, for each node those that
    end there, the longest first.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], unigram: bool):
        import ahocorasick

        self.pieces, self.unigram = pieces, unigram
        self.longest = max((len(p) for p in pieces), default=1)
        ranks = {p: -score for p, (_, score) in pieces.items()}
        self.table = MergeTable(lambda a, b: ranks.get(a + b), list)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10.0  # the library's penalty for a character that no piece covers
        self.arcs = ahocorasick.Automaton()
        for p, (_, score) in pieces.items():
            self.arcs.add_word(p, (p, len(p), score if unigram else {"": True}))  # {piece before: whether the two stay apart}
        self.arcs.make_automaton()

    def stream(self, text: str | Iterable[str]) -> Iterator[str]:
        """Pieces, or single characters that no piece covers, in order.

        ``text`` is whole or comes in parts; of either, back pointers are held for a window.
        """
        far, search = 2 * self.longest, self._best if self.unigram else self._merged
        if isinstance(text, str):
            text = [text] if len(text) <= far else [text[i : i + self.longest] for i in range(0, len(text), self.longest)]
        base, window = 0, ""  # window: the text from the last boundary on
        last, best = [""], [0.0]  # by node of the window: the piece that ends there, and its sum
        arcs = None
        for part in text:
            if not part:
                continue
            if arcs is None:
                arcs = self.arcs.iter(part) if len(self.arcs) else iter(())
            elif len(self.arcs):
                arcs.set(part)
            window += part
            last += [""] * len(part)
            search(arcs, base, last, best)
            if len(window) >= far:
                keep = self._meeting(last, len(window))
                if not self.unigram:
                    keep -= len(last[keep]) or 1  # one piece stays, as its successor asks for it
                if keep > 0:
                    yield from self._path(window, last, keep)
                    base, window, last = base + keep, window[keep:], last[keep:]
                    best = [v - best[keep] for v in best[keep:]]
        yield from self._path(window, last, len(window))

    def _merged(self, arcs: Iterator, base: int, last: list[str], best: list[float]) -> None:
        """Byte pairs: of the arcs to a node, the one that stays apart from the piece before it."""
        allowed = self._allowed
        for at, (piece, size, after) in arcs:
            end = at + 1 - base
            if not last[end]:
                before = last[end - size]
                if after[before] if before in after else allowed(before, piece, after):
                    last[end] = piece

    def _allowed(self, before: str, piece: str, after: dict[str, bool]) -> bool:
        made = self.table.made
        if not made(piece):
            after.clear()
            after[""] = False
        after[before] = after[""] and self.table.parted(before, piece)
        return after[before]

    def _best(self, arcs: Iterator, base: int, last: list[str], best: list[float]) -> None:
        """Unigrams: of the arcs to a node, the one with the best sum; ties go to the longer piece."""
        arc = next(arcs, None)
        for end in range(len(best), len(last)):
            found, score, covered = "", float("-inf"), False
            while arc is not None and arc[0] + 1 - base == end:
                piece, size, value = arc[1]
                value += best[end - size]
                if value > score:
                    found, score = piece, value
                covered |= size == 1
                arc = next(arcs, None)
            if not covered and best[end - 1] + self.unknown > score:
                found, score = "", best[end - 1] + self.unknown
            last[end] = found
            best.append(score)

    def _meeting(self, last: list[str], end: int) -> int:
        """The last boundary on the paths of all nodes that a further piece can start from."""
        heads = set(range(max(0, end - self.longest + 1), end + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - (len(last[top]) or 1))
        return heads.pop()

    @staticmethod
    def _path(window: str, last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            piece = last[end] or window[end - 1]
            out.append(piece)
            end -= len(piece)
        return out[::-1]


class Codec:
    """Text to ids and back for one .model file."""

    #: Words, and parts of words, that a generation of the memo holds; there are two.
    MEMO = 200_000

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with a dummy prefix and kept white space is supported")
        if kind not in (1, 2) or not model.trainer_spec.byte_fallback:
            raise ValueError("only unigram and byte-pair models with byte fallback are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("pieces defined by the user, and unused ones, aren't supported")
        self.texts, plain, self.bytes = [], {}, {}
        for i, p in enumerate(model.pieces):
            self.texts.append(p.piece.replace(SPACE, " ") if p.type == 1 else "")
            if p.type == 1:
                plain[p.piece] = (i, p.score)
            elif p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unigram = kind == 1
        self.viterbi = Viterbi({p: v for p, v in plain.items() if self.unigram or p.strip(SPACE) or len(p) == 1}, self.unigram)
        runs = {p: v for p, v in plain.items() if not p.strip(SPACE)}
        self.runs = MergeTable(lambda a, b: -runs[a + b][1] if a + b in runs else None, list)
        self.ids = {p: i for p, (i, _) in plain.items()}
        self.whole = self.unigram or any(SPACE in p[1:] and p.strip(SPACE) for p in plain)
        self.joined = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.memo: dict[str, tuple[int, ...]] = {}  # of words
        self.old: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.old_parts: dict[str, tuple[int, ...]] = {}

    def _emit(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of characters that no piece joins to those around them."""
        if (ids := self.parts.get(part)) is None:
            if (ids := self.old_parts.get(part)) is None:
                ids = tuple(self._emit(self.viterbi.stream(part)))
            if len(part) <= 64:
                if len(self.parts) >= self.MEMO:
                    self.parts, self.old_parts = {}, self.parts
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one space and the characters after it.

        Where no piece holds two neighbouring characters, all paths meet between
        them, so the parts are settled one by one.
        """
        if len(self.memo) >= self.MEMO:
            self.old = self.memo.copy()
            self.memo.clear()  # its callers hold it
        if (ids := self.old.get(word)) is not None:
            self.memo[word] = ids
            return ids
        word_, start, joined = SPACE + word, 0, self.joined
        found: list[int] = []
        for i in range(1, len(word_)):
            if word_[i - 1 : i + 1] not in joined:
                found += self._part(word_[start:i])
                start = i
        ids = (*found, *self._part(word_[start:]))
        if len(word) <= 64:
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; none for a null or empty one.

        No piece has a space after another character, so all paths meet before
        each space and the words between are settled one by one.  A run of spaces
        merges among itself after everything else has.
        """
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.whole:
            return self._emit(self.viterbi.stream(SPACE + text.replace(" ", SPACE)))
        memo, slow = self.memo, self._word
        out: list[int] = []
        run = 0
        for word in text.split(" "):
            if not word:
                run += 1
                continue
            ids = memo[word] if word in memo else slow(word)
            if run:
                if self.texts[ids[0]] == " ":
                    out += self._emit(t[0] for t in self.runs.merge([SPACE] * (run + 1)))
                    ids = ids[1:]
                else:
                    out += self._emit(t[0] for t in self.runs.merge([SPACE] * run))
                run = 0
            out.extend(ids)
        if run:
            out += self._emit(t[0] for t in self.runs.merge([SPACE] * run))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids without the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
        texts, byte_of = self.texts, self.byte_of
        if not byte_of.keys() & set(ids):
            out = "".join([texts[i] for i in ids])
            return out[1:] if out[:1] == " " else out
        parts: list[bytes] = []
        for i in ids:
            parts.append(bytes((byte_of[i],)) if i in byte_of else texts[i].encode())
        out = b"".join(parts).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, made once in each Python worker."""
    if path not in CODECS:
        CODECS[path] = Codec(path)
    return CODECS[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` and a column of ids; with ``check``, also whether decoding gives the text back.

    A null or empty text has no ids.  U+2581, the model's own sign for a space,
    decodes as a space, and is compared as one.  Rows are neither dropped nor
    merged; a column of the same name as ``ids`` or ``check`` is replaced.
    """
    new = [StructField(ids, ArrayType(IntegerType(), False), False)]
    if check:
        new.append(StructField(check, BooleanType(), False))

    def run(texts: list[str | None]) -> list[list]:
        own = codec(model)
        found = [own.encode(t) for t in texts]
        if not check:
            return [found]
        same = lambda t, i: own.decode(i) == (t or "").replace(SPACE, " ")
        return [found, [same(t, i) for t, i in zip(texts, found, strict=True)]]

    return map_text(docs, text, new, run)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` and the text of their ids; empty for a null or empty array."""
    from pyspark.sql.types import StringType

    def run(values: list) -> list[list]:
        own = codec(model)
        return [[own.decode(v) if v is not None and len(v) else "" for v in values]]

    return map_text(rows, ids, [StructField(text, StringType(), False)], run)


def op1(docs: DataFrame, model: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids, round_trip."""
    out = encode(docs.select("doc_id", "text"), model, check="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


