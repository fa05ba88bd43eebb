"""Vectorised functions for what has no column expression: hashes, stems, likeness, slugs and HTML blocks."""

from __future__ import annotations

import difflib
import functools
import hashlib
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def fnv1a(data: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


@F.pandas_udf(ST.StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, in hexadecimal."""
    return text.map(lambda t: None if t is None else fnv1a(t.encode()))


def normal(text: str) -> str:
    return " ".join(re.sub(r"[*_`]", "", text).split()).lower()


@F.pandas_udf(ST.StringType())
def card_identity(book: pd.Series, kind: pd.Series, prompt: pd.Series, answer: pd.Series) -> pd.Series:
    """<book>-card-<hash> or <book>-sc-<hash> over type, prompt and answer in normal form; where a card stands does not matter."""

    def one(b: str, k: str, p: str, a: str) -> str:
        scenario = k == "scenario"
        a = re.sub(r"^\(\w\)\s*", "", a) if scenario else a
        return f"{b}-{'sc' if scenario else 'card'}-{fnv1a(chr(31).join([k, normal(p), normal(a)]).encode())}"

    return pd.Series([one(*r) for r in zip(book, kind, prompt, answer, strict=True)])


@F.pandas_udf(ST.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger ratio of matching blocks of both orders; 1 where one holds the other."""

    def one(x: str, y: str) -> float:
        if x in y or y in x:
            return 1.0
        return max(difflib.SequenceMatcher(None, *p, autojunk=False).ratio() for p in ((x, y), (y, x)))

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(ST.StringType())
def book_slug(title: pd.Series) -> pd.Series:
    """A folder name from a title: marks dropped, ASCII runs joined by hyphens; other scripts get eight digits of a hash."""

    def one(t: str) -> str:
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        s = re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:80]
        return s if s and not re.search(r"[^\x00-ɏ]", t) else "-".join(filter(None, [s, hashlib.sha256(t.encode()).hexdigest()[:8]]))

    return title.map(lambda t: None if t is None else one(t))




def _measure(stem: str) -> int:
    shape = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", shape))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") for i, c in enumerate(stem))


def _cvc(s: str) -> bool:
    con = lambda i: s[i] not in "aeiou" and not (s[i] == "y" and i and s[i - 1] not in "aeiou")
    return len(s) > 2 and con(len(s) - 3) and not con(len(s) - 2) and con(len(s) - 1) and s[-1] not in "wxy"


#: Suffixes of Porter's published steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """Porter's stem of a lower-case word (Q06)."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        end = max((e for e in rules if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + rules[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@functools.lru_cache(1 << 17)
def _stem(term: str) -> str:
    return porter("".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c)))


@F.arrow_udf(ST.ArrayType(ST.StringType()))
def stems(terms: pa.Array) -> pa.Array:
    """Stems of lower-case terms, marks dropped. Each different word of a batch is stemmed once."""
    words = terms.flatten().dictionary_encode()
    found = pa.array([_stem(t) for t in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), found)


class _Blocks(HTMLParser):
    SKIP, ENDS = {"head", "script", "style", "template", "nav"}, {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "blockquote", "pre", "footer", "header", "dt", "dd"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.kind, self.skip = [], [], "p", 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append({"kind": self.kind, "text": text})
        self.text, self.kind = [], "p"

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.ENDS:
            self.cut()
            self.kind = tag if tag in ("li", "blockquote", "pre", "dt") or re.fullmatch("h[1-6]", tag) else "p"
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.ENDS:
            self.cut()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_blocks(html: str | None) -> list[dict]:
    """Headings, paragraphs, list items, quotes and code of a page in order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.cut()
    return p.out


@F.pandas_udf(ST.ArrayType(ST.StructType([ST.StructField("kind", ST.StringType()), ST.StructField("text", ST.StringType())])))
def blocks_of_html(html: pd.Series) -> pd.Series:
    return html.map(html_blocks)
