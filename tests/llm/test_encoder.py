"""The cached encoder against the tokenizer itself."""

import random

from tokenizers import Tokenizer

from quire.llm import tokens

#: Characters and strings on which normal forms, splits or special tokens could differ.
PARTS = [*"abcxyzSTIİıſßΣςé.,'’;:-_<>|/0123 \t\n\r\x0b\x0c\x1c\x85\xa0 日本😂✅", "é", "́", "̸", "ﬁ", "<|endoftext|>", "'s", "'LL", "I'm", "..,", "a.,'s"]


def test_encoder_equals_the_tokenizer_while_its_cache_turns_over():
    draw = random.Random(3)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 60))) for _ in range(4000)] + [None, "", " "]
    plain, cached = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path(), keep=3000)
    got = [b.tolist() for i in range(0, len(texts), 200) for b in cached.many(texts[i : i + 200])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert cached.names.nbytes <= 3000
    assert cached.counts(texts) == [len(x) for x in got]


def test_long_texts_in_parts_and_the_cache_within_its_bytes(monkeypatch):
    draw = random.Random(5)
    text = " ".join("".join(draw.choices("abcdeé.,'", k=draw.randint(1, 9))) for _ in range(3000))
    plain = Tokenizer.from_file(tokens.default_path())
    monkeypatch.setattr(tokens, "_TOGETHER", 500)
    enc = tokens.Encoder(tokens.default_path(), keep=4000)
    texts = [text, "", text[:700], None, "x" * 2000, text[:10]]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [a.tolist() for a in enc.many(texts)] == want
    assert enc.counts(texts) == [len(w) for w in want] and enc.names.nbytes <= 4000


def test_every_letter_and_mark_beside_others():
    marks = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x530), 0x1E9E, 0xFB01, 0x212B, 0x300, 0x301]]
    texts = [t for m in marks for t in (f"a{m}", f"é{m}b", f"{m}.x", f"a{m}'s")]
    enc = tokens.Encoder(tokens.default_path())
    assert [a.tolist() for a in enc.many(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
