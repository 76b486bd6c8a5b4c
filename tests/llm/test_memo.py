"""The memo of words of the piece encoder."""

import numpy as np

from lexmill.llm import pieces


def test_words_met_again_after_many_others_are_not_encoded_again():
    p = pieces.Pieces(pieces.piece_model(pieces.tokenizer_path()))
    learned, learn = [], p.learn
    p.learn = lambda words: learned.append(len(words)) or learn(words)
    texts = [" ".join(f"w{i}" for i in range(at, at + 10_000)) for at in range(0, 100_000, 10_000)]
    first = [p.encode(t) for t in texts]
    n = sum(learned)
    assert [p.encode(t) for t in texts] == first
    assert sum(learned) == n


def test_a_small_memo_keeps_few_words_and_gives_the_same_ids():
    model = pieces.piece_model(pieces.tokenizer_path())
    large, small = pieces.Pieces(model), pieces.Pieces(model, memo_words=1000)
    texts = [" ".join(f"w{i}" for i in range(at, at + 400)) + f"  a\u2581b \u2581\n {at}é" for at in range(0, 8_000, 400)] * 2
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts] == [np.array([small.bos, *small.library.encode(t), small.eos], "<u4").tobytes() for t in texts]
    assert len(small.memo) + len(small.old) <= 1500 < len(large.memo)
    assert all(w.isascii() for w in small.memo if "é" not in w)
