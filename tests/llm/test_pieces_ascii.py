"""Texts of ASCII alone are cut by a pattern of their own, which must find what the general one finds."""

import itertools
import random
import re

from sedge.llm import pieces


def test_ascii_cut():
    own, general = re.compile(pieces.ASCII_CUT), re.compile(pieces.CUTS[0])
    kinds = "aZ 09_.-\n\t\x00\x1c\x7f"
    draw = random.Random(3)
    texts = ["".join(x) for n in range(5) for x in itertools.product(kinds[:9], repeat=n)]
    texts += ["".join(draw.choices([chr(i) for i in range(128)] + list(kinds), k=draw.randrange(60))) for _ in range(4000)]
    for text in texts:
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert own.findall(marked) == general.findall(marked)
    with open(pieces.model_path(), "rb") as f:
        codec = pieces.MergeCodec(f.read())
    assert [codec.encode(x) for x in texts] == codec.library.encode(texts, num_threads=1)
    assert codec.ascii_cut.pattern == pieces.ASCII_CUT
