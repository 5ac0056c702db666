"""Token ids of whole texts by a public tokenizer file, with a bounded memory of pieces seen before.

Two kinds of files never let a token reach over a single space that
stands between two other characters: their first step cuts the text there.
So a text is cut at these spaces, and the ids of its pieces in a row are the
ids of the text. Pieces recur, and the library encodes a new one only once.
Texts with other white space than single spaces and line ends between
characters, or with the string of an added token, go to the library as a whole,
and so do all texts where the file is of another kind.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Set after each piece when many are encoded in one text; a piece that holds it is encoded alone.
_MARK = " ~"
# First steps (normaliser, pre-tokenizer, end of words) that cut a text at its single spaces.
_CUTTING = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "</w>",
    ),
)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
#: Pieces that a worker remembers; more are encoded each time they come up.
REMEMBERED = 500_000


def _odd_space(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the texts at ``joined[start:end]`` have white space other than single spaces and line ends between characters."""
    space = (joined == 0x20) | (joined == 0x0A)
    at = np.flatnonzero(space[1:] & space[:-1])
    other = np.flatnonzero(((joined >= 0x09) & (joined <= 0x1F) & (joined != 0x0A)) | (joined == 0xC2) | ((joined >= 0xE1) & (joined <= 0xE3)))
    lead, b, c = joined[other], joined[np.minimum(other + 1, len(joined) - 1)], joined[np.minimum(other + 2, len(joined) - 1)]
    wide = (lead == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    wide |= ((lead == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((lead == 0xE1) & (b == 0x9A)) | ((lead == 0xE3) & (b == 0x80) & (c == 0x80))
    odd = np.zeros(len(starts), bool)
    for found in (at[(np.searchsorted(starts, at, "right") == np.searchsorted(starts, at + 1, "right"))], other[wide | (lead < 0x20)]):
        odd[np.searchsorted(starts, found, "right") - 1] = True
    some = ends > starts
    odd[some] |= space[starts[some]] | space[ends[some] - 1]
    return odd


class Encoder:
    """Encodes texts as the library does with the tokenizer in ``path``, without adding special tokens.

    The string of a special token in a text becomes that token, as is the library's way; with ``plain`` it is text like any other.
    Pieces are told apart by two 64-bit hashes, computed with array operations.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain
        added = [] if plain else [re.escape(t.content.encode()) for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._added = re.compile(b"|".join(added), re.IGNORECASE) if added else None
        form = json.loads(self._tokenizer.to_str())
        self._cuts = (form["normalizer"], form["pre_tokenizer"], form["model"].get("end_of_word_suffix")) in _CUTTING and form["model"].get("type") == "BPE"
        if not self._cuts:
            return
        (self._mark,) = self._tokenizer.encode(_MARK, add_special_tokens=False).ids
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._by_word = "a</w>" in vocabulary
        self._edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self._edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self._by_word else t.startswith("\u0120"))]] = True
        self._remembered = remembered
        self._known = np.zeros((2, 0), np.uint64)
        self._slots = np.zeros(0, np.int64)
        self._powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._flat = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 12, np.int64)
        self._lengths = np.zeros(1 << 12, np.int64)
        self._n = self._end = 0

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keeps the ids of new pieces behind those kept so far."""
        while self._n + len(lengths) > len(self._starts):
            self._starts, self._lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self._starts, self._lengths))
        while self._end + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._end : self._end + len(ids)] = ids
        self._starts[self._n : self._n + len(lengths)] = self._end + np.cumsum(lengths) - lengths
        self._lengths[self._n : self._n + len(lengths)] = lengths
        self._n += len(lengths)
        self._end += len(ids)

    def _encode_each(self, pieces: list[str]) -> None:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._put(np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def _encode(self, pieces: list[str], marked: bool) -> None:
        """Encodes new pieces that begin with a space, many in one text, cut again by what shows where a piece begins or ends.

        With the byte-level vocabulary that is a first token with a space; with the word vocabulary a token that ends a word, for
        pieces of letters only. All others (``marked``) get a mark after each piece.
        """
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            text = _MARK.join([*some, ""]) if marked else "".join(some)
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == self._mark if marked else self._edge[ids]
            cuts = np.flatnonzero(marks)
            if len(cuts) != len(some):
                self._encode_each(some)
            elif marked:
                self._put(ids[~marks], np.diff(cuts, prepend=-1) - 1)
            else:
                self._put(ids, np.diff(cuts, prepend=-1) if self._by_word else np.diff(cuts, append=len(ids)))

    def _directly(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False) if texts else []
        return [np.array(e.ids, np.uint32) for e in found]

    def _hashes(self, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(joined)
        if not self._powers or len(self._powers[0][0]) < n:
            self._powers = []
            for base in _BASES:
                steps = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 2**64))]
                for x in steps:
                    x[0] = 1
                self._powers.append(tuple(np.multiply.accumulate(x) for x in steps))
        out, values = [], joined.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for powers, inverses in self._powers:
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(values * powers[:n], out=sums[1:])
                out.append((sums[ends] - sums[starts]) * inverses[starts])
        return np.stack(out)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8) in a row, and how many each has."""
        if not self._cuts:
            whole = self._directly(texts)
            return np.concatenate([np.zeros(0, np.uint32), *whole]), np.array([len(x) for x in whole], np.int64)
        data = b" ".join(texts) + b" "
        joined = np.frombuffer(data, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_starts = np.cumsum(sizes + 1) - sizes - 1
        odd = _odd_space(joined, text_starts, text_starts + sizes)
        if self._added and self._added.search(data):
            odd |= np.array([bool(self._added.search(t)) for t in texts], bool)
        edges = np.flatnonzero(np.diff(joined != 0x20, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        owner = np.searchsorted(text_starts, starts, "right") - 1
        keep = ~odd[owner]
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
        hashes = self._hashes(joined, starts, ends)
        leads = starts == text_starts[owner]  # no space stands before
        hashes[:, leads] ^= np.uint64(0x5DEECE66D)
        first, where, inverse = np.unique(hashes[0], return_index=True, return_inverse=True)
        second = hashes[1, where]
        if (second[inverse] != hashes[1]).any():  # two pieces with one hash: as good as never
            all_ids = self._directly(texts)
            return np.concatenate([*all_ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in all_ids], np.int64)
        at = np.minimum(np.searchsorted(self._known[0], first), max(0, self._known.shape[1] - 1))
        slots = np.full(len(first), -1, np.int64)
        if self._known.shape[1]:
            hit = (self._known[0, at] == first) & (self._known[1, at] == second)
            slots[hit] = self._slots[at[hit]]
        n, end = self._n, self._end
        lost = np.flatnonzero(slots < 0)
        if len(lost):
            pieces = [data[a:b].decode() if lead else data[a - 1 : b].decode() for a, b, lead in zip(starts[where[lost]].tolist(), ends[where[lost]].tolist(), leads[where[lost]].tolist(), strict=True)]
            kind = np.array([2 if p[0] != " " or _MARK[1] in p or len(p) > 64 else int(self._by_word and not p[1:].isalpha()) for p in pieces], np.int8)
            order = np.argsort(kind, kind="stable")
            lost, pieces = lost[order], [pieces[k] for k in order.tolist()]
            joined_up, marked = (int(np.count_nonzero(kind <= k)) for k in (0, 1))
            plain, others = lost[:marked], lost[marked:]
            kept = plain[: max(0, self._remembered - self._known.shape[1])]
            if len(kept):
                place = np.searchsorted(self._known[0], first[kept])
                fresh = (place == self._known.shape[1]) | (self._known[0, np.minimum(place, self._known.shape[1] - 1)] != first[kept]) if self._known.shape[1] else np.ones(len(kept), bool)
                new = np.flatnonzero(fresh)
                new = new[np.argsort(kept[new])]  # by hash: pieces of two kinds may go to one place
                self._known = np.stack([np.insert(k, place[new], v[kept[new]]) for k, v in zip(self._known, (first, second), strict=True)])
                self._slots = np.insert(self._slots, place[new], n + new)
            self._encode(pieces[:joined_up], False)
            self._encode(pieces[joined_up:marked], True)
            slots[plain] = np.arange(n, self._n)
            held = self._n - len(plain) + len(kept), int(self._starts[n + len(kept) - 1] + self._lengths[n + len(kept) - 1]) if len(kept) else end
            self._encode_each(pieces[marked:])
            slots[others] = np.arange(self._n - len(others), self._n)
            n, end = held
        words = slots[inverse]
        lengths = self._lengths[words]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        ids = self._flat[np.repeat(self._starts[words] - upto + lengths, lengths) + np.arange(total)]
        self._n, self._end = n, end
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64)
        if odd.any():
            cuts = np.cumsum(counts)
            direct = iter(self._directly([texts[k] for k in np.flatnonzero(odd)]))
            parts = [next(direct) if o else ids[e - c : e] for o, e, c in zip(odd.tolist(), cuts.tolist(), counts.tolist(), strict=True)]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
