"""Runs of anything but white space are cut and merged once each, however often they occur."""

import random
import unicodedata

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import bpe  # noqa: E402


def test_each_run_is_cut_once(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    v, t = bpe.Vocabulary(path), Tokenizer.from_file(path)
    e, d = bpe.Encoder(v, bpe.lookahead_of(path)), bpe.Decoder(v)
    cut, seen = e.cut, []
    monkeypatch.setattr(e, "cut", lambda run: seen.append(run) or cut(run))
    new = [chr(i) for i in [0x558, 0x88F, 0xC5C, 0x1C89] if unicodedata.category(chr(i)) == "Cn"]
    rng = random.Random(3)
    words = ["Straße", "it's,", "été", "ΑΣ", "a\x1cb", "́x", "a­b", "12", "!?", *["q" + c + "É2" for c in new]]
    gaps = [" ", " ", "\x85 ", "\n\t", "\xa0", " \x1f "]
    text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(3000)) + "x" * 100 + "<|endoftext|>it's,"
    hits = [h for some in e.pieces(text, d) for h in some]
    ids = t.encode(text, add_special_tokens=False).ids
    assert " ".join(h[0] for h in hits) == " ".join(map(str, ids)) and sum(h[2] for h in hits) == len(ids)
    assert " ".join(h[1] for h in hits) == t.decode(ids, skip_special_tokens=False)
    assert e.encode(text) == ids
    seen.clear()
    list(e.pieces(text, d))
    assert seen == ["x" * 100]  # only what is too long to be remembered
