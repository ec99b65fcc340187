"""Whole texts to ids, by the tokenizer libraries, with what each distinct chunk gives kept for the next time it occurs.

A tokenizer that never joins characters across certain blanks gives a text the ids of its chunks, one after the other.
Words recur, so most chunks are looked up, and only new ones go through the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks, and lower-case words, that a Python worker keeps before it drops the rarer ones: a bound on its memory.
CACHE_CHUNKS = 300_000
CACHE_WORDS = 700_000
#: Words that a worker still keeps once a task has ended: it lives on, and so would all that it keeps.
REST_WORDS = 50_000
#: Characters that are taken through numpy at a time.
BATCH_CHARS = 1_000_000


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkStore:
    """Arrays of numbers for each distinct chunk, all arrays of a chunk equally long, and gathered for many chunks at once.
    When it holds `most` chunks it keeps those that came more than once since the last time, if they are few enough.

    learn: gets new chunks and returns, for each, a tuple of equally long lists; or, for all of them, what gather() gives.
    """

    def __init__(self, learn: Callable[[list[str]], list[tuple] | tuple[np.ndarray, list[np.ndarray]]], kinds: tuple[type, ...], most: int = CACHE_CHUNKS):
        self.learn, self.kinds, self.most = learn, kinds, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.values = [np.zeros(0, k) for k in self.kinds]

    def shrink(self) -> None:
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > self.most // 2:
            return self.clear()
        chunks = np.array(list(self.at), object)[kept]  # in the order of their numbers
        self.lengths, self.values = self.gather(kept)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = dict(zip(chunks, range(len(kept)), strict=True))
        self.used = np.zeros(len(kept), np.int64)

    def rest(self, most: int) -> None:
        """Keep the `most` chunks that came most often. They are copied, so that no memory is held for the sake of a few that
        lie scattered in it."""
        if len(self.at) <= most:
            return
        kept = np.sort(np.argpartition(self.used, -most)[-most:]) if most else np.zeros(0, np.int64)
        chunks = pa.array(np.array(list(self.at), object)[kept], pa.large_string())
        (self.lengths, self.values), self.used = self.gather(kept), self.used[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = {}
        self.at = dict(zip(chunks.to_pylist(), range(len(kept)), strict=True))

    def rows(self, chunks: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """The number of each chunk, after learning those that are new. times: how often each came, if not once."""
        if len(self.at) > self.most:
            self.shrink()
        if new := list(set(chunks).difference(self.at)):
            found = self.learn(new)
            n = len(self.at)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
            if isinstance(found, tuple):
                lengths, values = found
            else:
                lengths = np.fromiter((len(x[0]) for x in found), np.int64, len(found))
                values = [np.fromiter((v for x in found for v in x[k]), kind, int(lengths.sum())) for k, kind in enumerate(self.kinds)]
            self.starts = np.concatenate([self.starts, len(self.values[0]) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.values = [np.concatenate(both) for both in zip(self.values, values, strict=True)]
        rows = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        self.used = np.bincount(rows, times, len(self.at)).astype(np.int64) + np.pad(self.used, (0, len(self.at) - len(self.used)))
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(how many values each row gives, the values of all rows on end)."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - lengths), lengths)
        return lengths, [v[where] for v in self.values]


def groups(texts: Iterable[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) for runs of about `most` characters; null is the empty text. A longer text stands alone."""
    first, run, chars = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and chars + len(t) > most:
            yield first, run
            first, run, chars = i, [], 0
        run.append(t)
        chars += len(t)
    if run:
        yield first, run


def split_chunks(texts: list[str], pattern: re.Pattern) -> tuple[list[str], np.ndarray]:
    """All chunks on end and how many each text has."""
    chunks, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = pattern.findall(t)
        counts[i] = len(found)
        chunks += found
    return chunks, counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of `counts` values; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


#: Marks that end a word. They are tokens of their own in any case, so they may be set apart, and the word is a known one.
END_MARKS = r"([a-z])([.,!?;:]+)([\x20\x09-\x0D]|\z)"
#: Words of ASCII and Latin-1 letters alone, which normalisation leaves as they are but for their case.
LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"


def letters_tokenizer(tokenizer):
    """(tokenizer, whether an id ends a word) for words of LETTERS with a blank between: a tokenizer's model without the
    patterns that such words don't need. None if it is not of the kind for which that is known to be the same."""
    import json

    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    settings = lambda part: json.loads(part.__getstate__()) if part else {}
    model, suffix = tokenizer.model, getattr(tokenizer.model, "end_of_word_suffix", None)
    forms = [n["type"] for n in settings(tokenizer.normalizer).get("normalizers", [])]
    steps = settings(tokenizer.pre_tokenizer).get("pretokenizers", [])
    same = isinstance(model, models.BPE) and suffix and not model.dropout and forms == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
    if not same or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or "|[\\p{L}]+|" not in steps[0]["pattern"].get("Regex", ""):
        return None
    own = Tokenizer(model)
    own.normalizer = normalizers.Lowercase()
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(own.get_vocab_size(), bool)
    ends[[i for word, i in own.get_vocab().items() if word.endswith(suffix)]] = True
    return own, ends


class WordEncoder:
    """Ids of whole texts by a `tokenizers` file that lower-cases, sets marks apart from letters, and drops white space, so
    that no token crosses it. Texts that may hold a special token's string are left in their own case."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = letters_tokenizer(self.tokenizer)
        self.store = ChunkStore(self._learn, (np.uint32,), CACHE_WORDS)

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the tokenizer gives for each chunk. Many go through it as one text."""
        plain = pc.match_substring_regex(pa.array(chunks, pa.large_string()), LETTERS).to_numpy(zero_copy_only=False) if self.letters else np.zeros(len(chunks), bool)
        lengths, ids = np.zeros(len(chunks), np.int64), []
        for kind, work in ((plain, self._by_ends), (~plain, self._by_places)):
            mine = np.flatnonzero(kind)
            for at in range(0, len(mine), 4096):
                own = mine[at : at + 4096]
                lengths[own], some = work([chunks[i] for i in own])
                ids.append(some)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ends = np.cumsum(lengths[order])
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = ends - lengths[order]
        first = np.cumsum(lengths) - lengths
        return lengths, [np.concatenate(ids)[np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)]]

    def _by_ends(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, ids) of words of LETTERS: each is one word to the model, whose last id ends it."""
        own, ends = self.letters
        ids = np.array(own.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(ends[ids])
        if len(last) != len(chunks):  # a model that lacks a letter
            return self._by_places(chunks)
        return np.diff(last, prepend=-1), ids

    def _by_places(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, ids) of any chunks: their tokens are told apart by their place."""
        e = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        places = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        return np.diff(np.searchsorted(places, ends[:-1]), prepend=0, append=len(places)), np.array(e.ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids on end). Texts are cut, and equal words found, by Arrow; only a word that
        differs from all others becomes a Python string."""
        own = pa.array(texts, pa.large_string())
        plain = pc.replace_substring_regex(pc.ascii_lower(own), END_MARKS, r"\1 \2\3")
        if pc.any(special := pc.match_substring(own, "<|")).as_py():
            plain = pc.if_else(special, own, plain)
        chunks = pc.ascii_split_whitespace(plain)  # with an empty one, which has no ids, where a text begins or ends blank
        words = chunks.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        rows = self.store.rows(words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(at, minlength=len(words.dictionary)))
        lengths, (ids,) = self.store.gather(rows[at])
        return sums(lengths, np.diff(chunks.offsets.to_numpy())), ids


#: White space apart from the ASCII kind below; with it, a text is encoded in one piece.
ODD_SPACES = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACED_CHUNKS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")


class SpanEncoder:
    """Ids and character spans of whole texts by a byte-level `tokenizers` file, whose tokens may begin with white space
    but never go on after it, so that a text can be cut before each run of white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.store = ChunkStore(self._learn, (np.uint32, np.int32, np.int32))

    def _learn(self, chunks: list[str]) -> list[tuple]:
        found = []
        for c in chunks:
            e = self.tokenizer.encode(c, add_special_tokens=False)
            found.append((e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, ids, first character, character after the last) of all texts on end."""
        chunks, counts = [], np.zeros(len(texts), np.int64)
        whole = []
        for i, t in enumerate(texts):
            if t and ODD_SPACES.search(t):
                whole.append((len(chunks), t))
                found = [t]
            else:
                found = SPACED_CHUNKS.findall(t)
            counts[i] = len(found)
            chunks += found
        lengths, (ids, first, after) = self.store.gather(self.store.rows(chunks))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        before_text = np.repeat(np.concatenate([[0], ends])[np.cumsum(counts) - counts], counts)
        shift = np.repeat(ends - sizes - before_text, lengths)
        return sums(lengths, counts), ids, first + shift, after + shift


@lru_cache(maxsize=8)
def shared(kind: type, *args):
    """One encoder of a kind in each Python worker."""
    return kind(*args)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """A batch's texts one after the other, so that not all of them are Python strings at once."""
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(column)))
