"""Encoding, decoding and token counts against the public libraries."""

import random

import public_tokenizers
import pytest

from graphloom.llm import sentencepiece_codec as S
from graphloom.llm import token_counts as T
from graphloom.llm.bpe import ByteCounter, MergeTable

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'ll", "'s", "é", "日", "12", "<|endoftext|>", "the", "ing", "\t", "!!", " ", "😀", "ll", "   ", "internationalization", "==========", "　", "▁"]


def texts(n, seed):
    r = random.Random(seed)
    out = ["", " ", "   ", "\n\n", "x" * 3000, "a b " * 500, " " * 100 + "a"]
    return out + ["".join(r.choice(PARTS) for _ in range(r.randrange(16))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = S.Codec(MODEL)
    for t in texts(800, 1):
        ids = library.encode(t)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids)
    assert own.encode(None) == []


def test_stream_holds_a_window():
    """Ids are committed while the text still comes, and no more than a few pieces are held."""
    search = S.Codec(MODEL).viterbi
    fed = 0

    def feed():
        nonlocal fed
        for c in "abcdefghij" * 300:
            fed += 1
            yield c

    held = 0
    given = 0
    for piece in search.stream(feed()):
        given += len(piece)
        if fed < 3000:
            held = max(held, fed - given)
    assert 0 < held <= 6 * search.longest


def test_unigram_search_is_best():
    """Against all segmentations of short strings."""
    scores = {"a": -1.0, "b": -1.5, "ab": -1.8, "aba": -3.3, "ba": -2.2, "bb": -4.0}
    search = S.Viterbi({p: (i, s) for i, (p, s) in enumerate(scores.items())}, True)

    def best(t):
        if not t:
            return 0.0
        return max(scores[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in scores)

    r = random.Random(2)
    for n in range(1, 12):
        t = "".join(r.choice("ab") for _ in range(n))
        found = list(search.stream(t))
        assert "".join(found) == t
        assert sum(scores[p] for p in found) == pytest.approx(best(t))
    long = "abba" * 50
    assert "".join(search.stream(long)) == long


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    own = ByteCounter(VOCABULARY)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in texts(400, 3):
        assert own.count(t) == size(t), t
        if len(t) < 60:
            assert own.prefix_counts(t) == [size(t[:i]) for i in range(len(t) + 1)], t


def test_long_pieces_and_prefixes():
    """A text without any space, and cuts around special strings after a long text."""
    import time

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    own = ByteCounter(VOCABULARY)
    r = random.Random(5)
    cjk = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(100_000))
    start = time.time()
    assert own.count(cjk) == size(cjk) and time.time() - start < 10
    own.PAIRS, own.pairs = 3, 3  # forgets all the time
    for t in texts(60, 8):
        assert own.count(t) == size(t), t
    for t in ["word " * 50 + "end!<|endoftext|><|endoftext|> x <|endoftext|>", "<|endoftext|>a  <|endoftext|>  \n<|endoftext|>"]:
        assert own.prefix_counts(t) == [size(t[:i]) for i in range(len(t) + 1)]


def test_stored_prefixes_answer_budgets(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", 3), (1, "the cat sat on the mat", 99), (2, "", 0), (3, None, 1), (4, "x", None)], "doc_id long, text string, Most int")
    stored = T.prefix_counts(docs, VOCABULARY).drop("text")
    found = T.fit(stored, "Most").select("doc_id", "truncated_at", "truncated_whole").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(1, 11, False), (1, 22, True), (2, 0, True), (3, 0, True), (4, None, None)]))
    assert T.fit(stored.limit(0), 5).count() == 0 and T.truncate(docs.limit(0), VOCABULARY, 5).count() == 0


def test_pieces_of_other_types_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces.add(piece="<sep>", score=0.0, type=4)
    (tmp_path / "own.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="user"):
        S.Codec(str(tmp_path / "own.model"))


def test_neighbours():
    """Two tokens stay apart exactly if merging their atoms gives the two."""
    ranks = {("a", "b"): 0, ("b", "a"): 1, ("ab", "a"): 2, ("a", "a"): 3, ("aa", "b"): 4}
    table = MergeTable(lambda x, y: ranks.get((x, y)), list)
    tokens = [t for t in ["a", "b", "ab", "ba", "aba", "aa"] if table.made(t)]
    for x in tokens:
        for y in tokens:
            assert table.apart(x, y) == ([t[0] for t in table.merge(list(x + y))] == [x, y]), (x, y)


def test_frames(spark):
    rows = [(1, "the cat", 5, "u"), (1, "the cat", 5, "u"), (None, None, None, None), (2, "", 6, "v"), (3, "é▁ x", 7, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_tokens long, IDS string")
    out = S.encode(docs, MODEL, check="same")
    assert out.columns == ["doc_id", "text", "N_tokens", "ids", "same"] and out.count() == 5
    assert all(r["same"] for r in out.collect())
    back = S.decode(out.select("doc_id", "ids"), MODEL)
    assert sorted(r["text"] for r in back.collect()) == sorted(["the cat", "the cat", "", "", "é  x"])
    found = {r["doc_id"]: r for r in T.op2(docs, VOCABULARY).collect()}
    assert (found[1]["n_bytes"], found[1]["n_tokens"], found[1]["over_limit"]) == (7, 2, False)
    assert (found[None]["n_bytes"], found[None]["n_tokens"]) == (0, 0) and found[3]["n_bytes"] == 7
    cut = {r["doc_id"]: (r["truncated_at"], r["truncated_whole"]) for r in T.truncate(docs, VOCABULARY, 1).collect()}
    assert cut[1] == (3, False) and cut[2] == (0, True)
    long = T.op2(spark.createDataFrame([(1, "word " * 2000)], "doc_id long, text string"), VOCABULARY, 1024).first()
    assert long["n_tokens"] == 2001 and long["over_limit"]
    none = docs.limit(0)
    assert S.op1(none, MODEL).count() == 0 and T.op2(none, VOCABULARY).count() == 0
