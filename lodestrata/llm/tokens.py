"""Exact, fast calls of the `tokenizers` library: words are encoded once and looked up after that."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np

#: Words whose ids a worker keeps; beyond it, new words are encoded again for each slice of texts.
CACHE_WORDS = 600_000
#: Words encoded in one call. A mark that no such word holds, or the blank itself, shows where each begins.
JOINED_WORDS, MARK = 2000, "\x01"
#: Marks that may end a word: a token never joins them to the letters before. Not the apostrophe, which opens 's and others.
TAIL = """!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""
#: Letters beyond ASCII that a simple word may hold.
LATIN = "".join(map(chr, range(0xC0, 0x100))).replace("\u00d7", "").replace("\u00f7", "")
LEAD = "\u00c3"
SIMPLE = re.compile(f"[A-Za-z{LATIN}]+")
#: Characters of text turned into ids at a time.
SLICE_CHARS = 2_000_000

_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Encodes texts through a tokenizer file, as `encode_batch(texts, add_special_tokens=False)` does.

    A byte-level BPE splits before each blank that stands between two other characters, and a word BPE
    that drops white space splits at every blank, so the parts between blanks can be encoded on their own.
    Where that isn't certain (runs of white space in the byte-level kind, added tokens such as an end mark written
    out in a text), the whole text is encoded.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        if keeps_space:
            self.opens[[i for word, i in vocab.items() if word.startswith("\u0120")]] = True
            self.mark, self.joint = "", " "
            # The same model over words that are cut already: letters spelled as bytes, one piece between blanks.
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False)
            self.spelled = {c: spell.pre_tokenize_str(c)[0][0] for c in LATIN}
            self.pieces = Tokenizer.from_file(path)
            self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.tails: dict = {}
        else:
            (mark_id,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            self.opens[mark_id] = True
            self.mark, self.joint = MARK, f" {MARK} "
        # A text with an added token has a part with each of the token's own.
        self.added_parts = [max(t.lower().split() or [t.lower()], key=len) for t in self.added if t.strip()]
        self.watch = True
        self.slots: dict = {}
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each word (with the blank before it, if the tokenizer keeps blanks).

        Of the byte-level kind, a simple word is its letters and the marks at its end: only letters not known as a word
        of their own are encoded, each once.
        """
        if not self.keeps_space:
            return self._joined(words)
        cut = [w.rstrip(TAIL) for w in words]
        of = np.array([s.isalpha() and (s.isascii() or SIMPLE.fullmatch(s) is not None) for s in cut], bool)
        rest_ids, rest_n = self._joined([words[i] for i in np.flatnonzero(~of).tolist()])
        simple = np.flatnonzero(of).tolist()
        stems = [cut[i] for i in simple]
        ends = [words[i][len(cut[i]) :] for i in simple]
        for tail in set(ends) - self.tails.keys():
            self.tails[tail] = np.array(self.whole([tail])[0], np.uint32)
        slot = np.fromiter(map(self.slots.get, stems, repeat(-1)), np.int64, len(stems))
        unknown = np.flatnonzero(slot < 0).tolist()
        new = dict.fromkeys(stems[i] for i in unknown)
        new_ids, new_n = self._letters(list(new))
        place = dict(zip(new, range(len(self.lens), len(self.lens) + len(new))))
        slot[unknown] = np.fromiter((place[stems[i]] for i in unknown), np.int64, len(unknown))
        tail_at = dict(zip(self.tails, range(len(self.tails))))
        tail_n = np.array([len(x) for x in self.tails.values()], np.int64)
        # Each word is two pieces of one array; that of the others is whole, its second empty.
        flat = np.concatenate([self.flat, new_ids, rest_ids, *self.tails.values()])
        known = np.concatenate([self.starts, len(self.flat) + np.cumsum(new_n) - new_n])
        known_n = np.concatenate([self.lens, new_n])
        rest_at, tails_at = len(self.flat) + len(new_ids), len(self.flat) + len(new_ids) + len(rest_ids)
        starts, lens = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        starts[of, 0], lens[of, 0] = known[slot], known_n[slot]
        starts[~of, 0], lens[~of, 0] = rest_at + np.cumsum(rest_n) - rest_n, rest_n
        tail = np.fromiter(map(tail_at.__getitem__, ends), np.int64, len(ends))
        starts[of, 1], lens[of, 1] = (tails_at + np.cumsum(tail_n) - tail_n)[tail], tail_n[tail]
        return _gather(flat, starts.reshape(-1), lens.reshape(-1)), lens.sum(axis=1)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `words`, of words of plain letters alone."""
        texts = []
        for i in range(0, len(words), JOINED_WORDS):
            text = "\n".join(words[i : i + JOINED_WORDS])
            used = set() if text.isascii() else set(text)
            # The letter that spells the first byte of all is replaced before it is written.
            for c in sorted(used & self.spelled.keys(), key=lambda c: c != LEAD):
                text = text.replace(c, self.spelled[c])
            texts.append("\u0120" + text.replace("\n", " \u0120"))
        found = self.pieces.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found] or [np.zeros(0, np.uint32)])
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `words`, of any.

        Many words make one text: a blank always opens a token of the byte-level kind, and the mark is a token
        of its own in the other.
        """
        texts = ["".join(self.joint + w for w in words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self.whole(texts)] or [np.zeros(0, np.uint32)])
        opens = self.opens[ids]
        if self.keeps_space:
            return ids, np.diff(np.append(np.flatnonzero(opens), len(ids)))
        n = np.diff(np.append(np.flatnonzero(opens), len(ids))) - 1
        return ids[~opens], n

    def _parts(self, text: str) -> list:
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        words: list = text.split(" ")
        words[0] = (words[0],)
        return words

    def _unsafe(self, part) -> bool:
        word = part[0] if isinstance(part, tuple) else part
        if self.watch and any(t in word.lower() for t in self.added_parts):
            return True
        if not self.keeps_space:
            return MARK in part
        return (not word and not isinstance(part, tuple)) or word.strip() != word

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts: all their ids in one array, and the number of ids of each text."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            yield self._slice(texts[at:end])
            at = end

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            parts += self._parts(text)
            ends[i + 1] = len(parts)
        slot = np.fromiter(map(self.slots.get, parts, repeat(-1)), np.int64, len(parts))
        starts, lens, flat = self.starts, self.lens, self.flat
        unknown = np.flatnonzero(slot < 0)
        if len(unknown):
            asked = [parts[i] for i in unknown.tolist()]
            missing = list(dict.fromkeys(asked))
            # One look at all new parts together tells whether any may hold an added token.
            first, plain = [p for p in missing if type(p) is tuple], [p for p in missing if type(p) is str]
            joined = "\n".join([p[0] for p in first] + plain).lower()
            self.watch = any(t in joined for t in self.added_parts)
            unsafe = [p for p in missing if self._unsafe(p)] if self.watch or not self.keeps_space else [p for p in first if p[0].strip() != p[0]] + [p for p in plain if not p or p.strip() != p]
            if unsafe:
                apart = set(unsafe)
                first, plain = [p for p in first if p not in apart], [p for p in plain if p not in apart]
            missing = unsafe + first + plain
            heads = self.whole([p[0] for p in first])
            ids, m = self.words(plain)
            n = np.concatenate([np.full(len(unsafe), -1), np.array([len(x) for x in heads], np.int64), m]).astype(np.int64)
            used = np.maximum(n, 0)
            starts = np.concatenate([starts, len(flat) + np.cumsum(used) - used])
            lens = np.concatenate([lens, n])
            flat = np.concatenate([flat, np.array([x for one in heads for x in one], np.uint32), ids])
            extra = dict(zip(missing, range(len(self.lens), len(lens))))
            if len(lens) <= CACHE_WORDS:
                self.slots.update(extra)
                self.starts, self.lens, self.flat = starts, lens, flat
            slot[unknown] = np.fromiter(map(extra.__getitem__, asked), np.int64, len(asked))
        n = lens[slot]
        if (n < 0).any():
            return self._mixed(texts, slot, ends, starts, lens, flat)
        total = np.concatenate([[0], np.cumsum(n)])
        return _gather(flat, starts[slot], n), np.diff(total[ends])

    def _mixed(self, texts, slot, ends, starts, lens, flat):
        """As above, with the texts that hold an uncertain part encoded whole."""
        out, count = [], []
        for i, text in enumerate(texts):
            own = slot[ends[i] : ends[i + 1]]
            n = lens[own]
            ids = np.array(self.whole([text])[0], np.uint32) if (n < 0).any() else _gather(flat, starts[own], n)
            out.append(ids)
            count.append(len(ids))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(count, np.int64)


def _gather(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    shift = starts - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(int(n.sum()))]


def encoder(path: str, keeps_space: bool) -> Encoder:
    """The worker's own encoder for a file; workers are reused between tasks."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = Encoder(path, keeps_space)
    return _encoders[path, keeps_space]
