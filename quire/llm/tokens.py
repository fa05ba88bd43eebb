"""Token ids by a public tokenizer, many texts at once, through a bounded cache of words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "word_bpe_49k.json"
VOCABULARY_SIZE = 49_408
END = 2
#: How the tokenizer splits its normalised text before merging; a fixed value of its file.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks that are one piece: letters up to U+024F and small Cyrillic ones, all normal forms, that stay one letter in lower case.
_LETTERS = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0430-\u045f]+$"
_BLANK = regex.compile(r"[\x20\x09-\x0D]")
#: Characters of texts that are encoded together, pieces in one call of the tokenizer, and bytes of words in the cache.
_TOGETHER, _AT_ONCE, _KEEP = 3_000_000, 20_000, 6_000_000
_TEXT = pa.large_string()
#: Before an ASCII mark (an apostrophe may go with what follows it) that stands after a small letter, a piece ends in any case.
_SPLIT = r"(\p{Ll})([!-&(-/:-@\[-`{-~])"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _pieces(chunk: str) -> list[str] | None:
    """The pieces of a chunk; None where its normal form may be split otherwise."""
    if not chunk.isascii() and (len(chunk.lower()) != len(chunk) or not unicodedata.is_normalized("NFC", chunk)):
        return None
    return _PIECES.findall(chunk)


def _parts(text: str) -> list[str]:
    """A text in parts of at most about _TOGETHER characters, cut at blanks."""
    if len(text) <= _TOGETHER:
        return [text]
    out, at = [], 0
    while len(text) - at > _TOGETHER:
        cut = _BLANK.search(text, at + _TOGETHER)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other: starts[0], starts[0] + 1, ..., starts[1], ..."""
    ends = np.cumsum(sizes)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    """Ids of whole texts, exactly the tokenizer's.

    It drops white space, lowers case and never merges over white space or between letters, digits and marks. So a text's ids
    are those of its blank-separated chunks in turn, a chunk's those of its pieces; a mark after a small letter starts a chunk
    of its own. Distinct chunks of many texts are found by dictionary encoding; those seen before are looked up in
    an Arrow array of at most _KEEP bytes (beyond that it starts again from the last texts' chunks), and new ones are
    encoded in one call. Texts that hold a special token's opening, and chunks whose normal form is another, go to the
    tokenizer as they are.
    """

    def __init__(self, path: str, keep: int = _KEEP) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.last = np.zeros(VOCABULARY_SIZE, bool)  # tokens that end a piece
        for name, i in self.tokenizer.get_vocab().items():
            self.last[i] = name.endswith("</w>")
        self.names, self.ids, self.sizes = pa.array([], _TEXT), np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces, each of which the tokenizer leaves whole."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for lo in range(0, len(pieces), _AT_ONCE):
            part = pieces.slice(lo, _AT_ONCE)
            line = pc.binary_join(pa.LargeListArray.from_arrays([0, len(part)], part), pa.scalar(" ", _TEXT))[0].as_py()
            found = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(part):
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:  # a piece that the tokenizer splits on
                alone = [self._whole(p) for p in part.to_pylist()]
                ids += alone
                sizes.append(np.array([len(a) for a in alone], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct chunks."""
        plain = pc.match_substring_regex(chunks, _LETTERS).to_numpy(zero_copy_only=False)
        ids, sizes = self._encode(chunks.filter(pa.array(plain)))
        if plain.all():
            return ids, sizes
        rest = chunks.filter(pa.array(~plain)).to_pylist()
        found = [_pieces(c) for c in rest]
        places: dict[str, int] = {}
        at = [places.setdefault(p, len(places)) for f in found if f for p in f]
        part_ids, part_sizes = self._encode(pa.array(list(places), _TEXT))
        odd = [self._whole(c) if f is None else None for c, f in zip(rest, found, strict=True)]
        # Pieces in turn, a chunk that goes whole being one more piece.
        extra = [o for o in odd if o is not None]
        pool = np.concatenate([ids, part_ids, *extra])
        pool_sizes = np.concatenate([sizes, part_sizes, np.array([len(o) for o in extra], np.int64)])
        pool_starts = np.cumsum(pool_sizes) - pool_sizes
        many = np.array([1 if f is None else len(f) for f in found], np.int64)
        turn, walk, whole = [], iter(at), iter(range(len(sizes) + len(part_sizes), len(pool_sizes)))
        for f in found:
            turn += [next(whole)] if f is None else [len(sizes) + next(walk) for _ in f]
        turn = np.array(turn, np.int64)
        # All chunks in their order: a plain one is one piece.
        count = np.ones(len(chunks), np.int64)
        count[~plain] = many
        first = np.cumsum(count) - count
        order = np.empty(int(count.sum()), np.int64)
        order[first[plain]] = np.arange(len(sizes))
        order[runs(first[~plain], many)] = turn
        each = pool_sizes[order]
        total = np.concatenate([[0], np.cumsum(each)])
        return pool[runs(pool_starts[order], each)], total[first + count] - total[first]

    def _some(self, texts: list[str], expand: bool) -> tuple[np.ndarray | None, np.ndarray]:
        low = pc.replace_substring_regex(pc.ascii_lower(pa.array(texts, _TEXT)), _SPLIT, r"\1 \2")
        lists = pc.ascii_split_whitespace(low)
        flat = lists.flatten().dictionary_encode()
        del low
        names, at = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        known = pc.index_in(names, value_set=self.names)
        fresh = pc.is_null(known)
        new = names.filter(fresh)
        new_ids, new_sizes = self._new(new)
        fresh = fresh.to_numpy(zero_copy_only=False)
        place = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[fresh] = len(self.sizes) + np.arange(len(new))
        ids, sizes = np.concatenate([self.ids, new_ids]), np.concatenate([self.sizes, new_sizes])
        starts = np.cumsum(sizes) - sizes
        if self.names.nbytes + new.nbytes <= self.keep:
            self.names, self.ids, self.sizes = pa.concat_arrays([self.names, new]), ids, sizes
        else:
            self.names, self.ids, self.sizes = pa.array([], _TEXT), np.zeros(0, np.uint16), np.zeros(0, np.int64)
            if names.nbytes <= self.keep:
                self.names, self.ids, self.sizes = names, ids[runs(starts[place], sizes[place])], sizes[place]
        word = place[at]
        lengths = sizes[word]
        offsets = lists.offsets.to_numpy()
        total = np.concatenate([[0], np.cumsum(lengths)])
        counts = total[offsets[1:]] - total[offsets[:-1]]
        return ids[runs(starts[word], lengths)] if expand else None, counts

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[bool], list[bool]]]:
        """Groups of parts of texts, whether each goes whole to the tokenizer, and whether it ends its text."""
        group, odd, last, size = [], [], [], 0
        for t in texts:
            t = t if isinstance(t, str) else ""
            special = "<|" in t
            parts = [t] if special else _parts(t)
            for i, p in enumerate(parts):
                group.append(p)
                odd.append(special)
                last.append(i == len(parts) - 1)
                size += len(p)
                if size >= _TOGETHER:
                    yield group, odd, last
                    group, odd, last, size = [], [], [], 0
        if group:
            yield group, odd, last

    def counts(self, texts: list[str | None]) -> list[int]:
        """Numbers of ids of the texts; null ones are empty."""
        out, have = [], 0
        for group, odd, last in self._groups(texts):
            n = self._some(["" if o else t for t, o in zip(group, odd, strict=True)], expand=False)[1].tolist()
            for t, o, k, end in zip(group, odd, n, last, strict=True):
                have += len(self._whole(t)) if o else k
                if end:
                    out.append(have)
                    have = 0
        return out

    def many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn as unsigned 16-bit numbers; null ones are empty. A group of texts is in memory at a time."""
        held: list[np.ndarray] = []
        for group, odd, last in self._groups(texts):
            ids, n = self._some(["" if o else t for t, o in zip(group, odd, strict=True)], expand=True)
            ends = np.cumsum(n)
            for t, o, k, e, end in zip(group, odd, n.tolist(), ends.tolist(), last, strict=True):
                part = self._whole(t) if o else ids[e - k : e]
                if held or not end:
                    held.append(part)
                    if not end:
                        continue
                    part, held = np.concatenate(held), []
                yield part


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
