import numpy as np

from inkmesh.llm import pieces
from inkmesh.llm.packing import tokenizer_path


def test_decoding_together_is_decoding_each():
    coder = pieces.PieceCoder(tokenizer_path(pieces.VOCABULARY), 3)
    rng = np.random.default_rng(1)
    plain = lambda ids: b"".join(coder.table[i] for i in np.frombuffer(ids, "<u4")).decode("utf-8", "replace").removeprefix(" ")
    for _ in range(500):
        most = 40 if rng.random() < 0.5 else len(coder.table)
        many = [rng.integers(0, most, rng.integers(0, 6)).astype("<u4").tobytes() for _ in range(3)]
        assert coder.decode_all(many) == list(map(plain, many))
    for text in ("", "a  b\nc", "x" * 300, "𝔞 ½ 漢字"):
        assert set(coder.decode_all([ids for _, ids in coder.encode([text])[0]])) == {text}
