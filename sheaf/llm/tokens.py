"""Whole texts to token ids, with the tokenizers library, at a cost that follows the distinct words."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts whose words are encoded together, each distinct one once. A longer text is taken by itself, in parts.
GROUP = 8 << 20
#: Bytes of words and their ids that a worker keeps of texts that are cut by patterns, with what Python adds to each.
CACHED_BYTES, ENTRY_BYTES = 64 << 20, 150
#: Characters of the longest word that is kept; a longer one, such as a text without white space, is encoded each time.
LONGEST = 64
#: The white space of the tokenizers' patterns (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
#: Characters of a long text that are cut into words at a time.
PART = 1 << 20
#: Marks that close a word: ASCII ones but the apostrophe, which the pre-tokenizers join to letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of Latin letters alone, which are single pieces to the pre-tokenizers and to any normalisation.
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Words that go to the model in one call.
TOGETHER = 128
#: The patterns of the two known kinds of pre-tokenizer, as their files state them.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Ids one after the other, and how many each unit has.
Units = tuple[np.ndarray, np.ndarray]


def byte_alphabet() -> dict[int, str]:
    """Each byte's letter in byte-level vocabularies: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts as little-endian ids of ``width`` bytes each, as the tokenizer's plain call does.

    The vocabularies' pre-tokenizers never join across white space but for one leading space, so a text is cut
    there into words, and a word's ids don't depend on its neighbours. ``batches`` takes many texts at once: Arrow
    cuts them, each distinct word is encoded once, and a gather puts the ids of all together. Words of Latin
    letters go to the file's BPE model at once; marks at their end are a piece of their own. All others go through
    the whole tokenizer. Texts with white space that ids may reach across are cut by the pre-tokenizer's pattern.
    Where a text holds an added token as it is written, that is its id, and the text is cut there. A file whose
    pre-tokenizer is of neither known kind, or whose added tokens take more than their own letters, has its texts
    encoded whole.
    """

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"  # executors are little-endian machines
        self.kind = np.dtype(f"<u{self.width}")
        steps = pre.get("pretokenizers", [])
        self.lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.spaces = pre == BYTE_LEVEL and not spec.get("normalizer")
        if self.spaces:
            self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        elif [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_SPLIT} and self.lowers:
            self.cut = re.compile(f"[^{SPACE}]+").findall
        else:
            self.cut = None
        self.added = {t["content"]: array(self.code, [t["id"]]).tobytes() for t in spec.get("added_tokens", [])}
        if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            self.cut = None
        self.apart = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split
        self.plain = self.letters = self.joint = None
        if self.cut and model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges"):
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            extra = {k: model[k] for k in ("end_of_word_suffix", "continuing_subword_prefix") if model.get(k)}
            self.plain = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **extra)
            self.letters = byte_alphabet()
            # a byte that no UTF-8 text has and no merge takes keeps words apart that go to the model together
            merged = {c for pair in merges for part in pair for c in part}
            between = [b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if self.letters[b] not in merged and self.letters[b] in model["vocab"]]
            if between and not extra and not model.get("unk_token"):
                self.joint, self.between, self.between_id = Tokenizer(self.plain), bytes(between[:1]), model["vocab"][self.letters[between[0]]]
        self.known, self.tails = Known(self._ids, cached), Known(self._whole, cached >> 4)

    def batches(self, texts: pa.Array, end: int, most: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, starts) of stretches of ``texts``, with ``end`` after each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        sizes, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while first < len(texts):
            done = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield first, last, *self._group(texts.slice(first, last - first), end)
            first = last

    def _group(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        slow = np.ones(len(texts), bool)
        found, uneven = None, np.zeros(0, bool)
        if self.plain and (len(texts) > 1 or pc.binary_length(texts)[0].as_py() <= GROUP):
            slow = self._odd(texts)
            fast = texts.filter(pa.array(~slow))
            if len(fast):
                units, order, ends, bad = self._lines(fast, end) if self.spaces else self._words_of(fast, end)
                found, uneven = gathered(units, order, ends), np.diff(np.concatenate([[0], np.cumsum(bad[order])[ends - 1]])) > 0
                if not slow.any() and not uneven.any():
                    return found
        places, out = np.flatnonzero(~slow), [b""] * len(texts)
        for n, place in enumerate(places.tolist()):
            if not uneven[n]:
                out[place] = found[0][found[1][n] : found[1][n + 1]].tobytes()
        slow[places[uneven]] = True
        for place in np.flatnonzero(slow).tolist():
            out[place] = self.encode(texts[place].as_py(), end)
        return np.frombuffer(b"".join(out), self.kind), np.cumsum([0, *map(len, out)]) // self.width

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts with an added token, or with white space that Arrow doesn't cut as the tokenizer does."""
        signs = [pc.match_substring(texts, t) for t in self.added]
        if self.spaces:
            signs += [pc.match_substring(texts, "\n\n\n"), pc.match_substring(texts, "\n\n "), pc.ends_with(texts, "\n\n")]
        else:
            signs.append(pc.match_substring_regex(texts, "[\x1c-\x1f]"))
        return np.logical_or.reduce([s.to_numpy(zero_copy_only=False) for s in signs])

    def _lines(self, texts: pa.Array, end: int) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
        """Lines between line feeds, and words between single spaces in them: a line's first word has no space before it.

        Units of ids, their order, where each text's end in it, and which units have white space that may join other.
        """
        lines = pc.split_pattern(texts, "\n")
        per_text, lines = lines.value_lengths().to_numpy().astype(np.int64), lines.flatten()
        pieces = pc.split_pattern(lines, " ")
        per_line, pieces = pieces.value_lengths().to_numpy().astype(np.int64), pieces.flatten()
        begins = np.zeros(len(pieces), bool)
        begins[np.cumsum(per_line) - per_line] = True
        first, rest = (pieces.filter(pa.array(m)).dictionary_encode() for m in (begins, ~begins))
        firsts, bad = self._units(first.dictionary, False)
        rests, worse = self._units(rest.dictionary, True)
        closing = self._of([self._whole("\n"), array(self.code, [end]).tobytes()])
        place = np.empty(len(pieces), np.int64)
        place[begins], place[~begins] = first.indices.to_numpy(), rest.indices.to_numpy() + len(bad)
        order, at = np.empty(len(pieces) + len(per_line), np.int64), np.cumsum(per_line) + np.arange(len(per_line))
        order[np.arange(len(pieces)) + np.repeat(np.arange(len(per_line)), per_line)] = place
        order[at] = len(bad) + len(worse)
        ends = at[np.cumsum(per_text) - 1]
        order[ends] = len(bad) + len(worse) + 1
        return joined(firsts, rests, closing), order, ends + 1, np.concatenate([bad, worse, [False, False]])

    def _words_of(self, texts: pa.Array, end: int) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
        """Words between white space of any kind; else as ``_lines``."""
        words = pc.utf8_split_whitespace(texts)
        counts, words = words.value_lengths().to_numpy().astype(np.int64), words.flatten().dictionary_encode()
        found, bad = self._units(words.dictionary, False)
        order, ends = np.empty(len(words) + len(counts), np.int64), np.cumsum(counts + 1)
        order[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words.indices.to_numpy()
        order[ends - 1] = len(bad)
        return joined(found, self._of([array(self.code, [end]).tobytes()])), order, ends, np.concatenate([bad, [False]])

    def _of(self, ids: list[bytes]) -> Units:
        return np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // self.width

    def _units(self, words: pa.Array, spaced: bool) -> tuple[Units, np.ndarray]:
        """The ids of distinct words, with a space before each if ``spaced``; and where white space beside other white space may join.

        A word is its Latin body and its marks, either of which may be empty, or goes whole to the tokenizer.
        """
        bodies = pc.utf8_rtrim(words, characters=MARKS)
        latin = pc.match_substring_regex(bodies, LATIN).to_numpy(zero_copy_only=False)
        coded = bodies.filter(pa.array(latin)).dictionary_encode()
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[latin] = coded.indices.to_numpy() + 1
        sizes = pc.utf8_length(bodies).to_numpy()
        cut = np.flatnonzero(latin & (sizes < pc.utf8_length(words).to_numpy()))
        tails = {"": 0}
        if len(cut):
            pairs = zip(words.take(cut).to_pylist(), sizes[cut].tolist(), strict=True)
            second[cut] = [tails.setdefault(w[size:], len(tails)) for w, size in pairs]
        other, bad = np.flatnonzero(~latin), np.zeros(len(words), bool)
        whole = []
        for place, text in zip(other.tolist(), words.take(other).to_pylist(), strict=True):
            uneven = not text or text[0] in WHITE or text[-1] in WHITE
            bad[place] = uneven and (spaced or bool(text))
            whole.append(b"" if uneven else self._cut(f" {text}" if spaced else text))
        first[other] = np.arange(len(other)) + 1 + len(coded.dictionary)
        body = joined(self._of([b""]), self._model(coded.dictionary, spaced), self._of(whole))
        units = joined(body, self._of([self.tails[t] if t else b"" for t in tails]))
        order = np.column_stack([first, second + len(body[1])]).ravel()
        ids, starts = gathered(units, order, np.arange(2, len(order) + 1, 2))
        return (ids, np.diff(starts)), bad

    def _model(self, words: pa.Array, spaced: bool) -> Units:
        """The model's ids of words of Latin letters."""
        if self.lowers:
            words = pc.utf8_lower(words)
        space = b" " if spaced else b""
        if not self.joint:
            texts = (f"{' ' if spaced else ''}{w}".encode().decode("latin-1").translate(self.letters) for w in words.to_pylist())
            ids = [[t.id for t in self.plain.tokenize(t)] for t in texts]
            return np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids))
        if not len(words):
            return self._of([])
        ends = pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32())
        groups = pc.binary_join(pa.ListArray.from_arrays(ends, words.cast(pa.binary())), self.between + space).to_pylist()
        texts = [(space + g).decode("latin-1").translate(self.letters) for g in groups]
        made = self.joint.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(chain(e.ids, (self.between_id,)) for e in made), self.kind)
        apart = np.flatnonzero(ids == self.between_id)
        return np.delete(ids, apart), np.diff(apart, prepend=-1) - 1

    def _ids(self, word: str) -> bytes:
        if self.plain:
            stem = word[1:] if word[0] == " " else word
            body = stem.rstrip(MARKS)
            if re.match(LATIN, body):
                kept = word[: len(word) - len(stem) + len(body)]
                if body != stem:
                    return self.known[kept] + self.tails[stem[len(body) :]]
                text = (kept.lower() if self.lowers else kept).encode().decode("latin-1").translate(self.letters)
                return array(self.code, [t.id for t in self.plain.tokenize(text)]).tobytes()
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def encode(self, text: str, end: int) -> bytes:
        """One text's ids, with ``end`` after them."""
        last = array(self.code, [end]).tobytes()
        if not self.cut:
            return self._whole(text) + last
        if any(token in text for token in self.added):
            return b"".join([self.added[x] if k % 2 else self._words(x) for k, x in enumerate(self.apart(text))]) + last
        return self._words(text) + last

    def _words(self, text: str) -> bytes:
        return self._cut(text) if len(text) <= PART else b"".join(map(self._cut, parts(text)))


def joined(*units: Units) -> Units:
    return np.concatenate([ids for ids, _ in units]), np.concatenate([sizes for _, sizes in units])


def gathered(units: Units, order: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in ``order``, and where those of each text begin and end, given where its units end."""
    store, size = units
    at = np.cumsum(size) - size
    lengths = size[order]
    done = np.cumsum(lengths)
    total = int(done[-1]) if len(done) else 0
    ids = store[np.repeat(at[order] - (done - lengths), lengths) + np.arange(total)]
    return ids, np.concatenate([[0], done[ends - 1]])


def parts(text: str) -> Iterator[str]:
    """A long text cut before single spaces between words, where ids don't reach across: words of one part at a time are in memory."""
    start = 0
    while len(text) - start > PART:
        at = text.find(" ", start + PART)
        while at > 0 and (text[at - 1] in WHITE or text[at + 1 : at + 2] in WHITE):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Known(dict):
    """Words' ids; an unknown word is learned as it is asked for. Long words are not kept, and what is kept is bounded in bytes."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        self.learn, self.most, self.held = learn, most, 0

    def __missing__(self, word: str) -> bytes:
        found = self.learn(word)
        if len(word) <= LONGEST:
            size = ENTRY_BYTES + len(word) + len(found)
            self.held += size
            if self.held > self.most:
                self.clear()
                self.held = size
            self[word] = found
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; Python workers are used again."""
    return WordEncoder(path)
