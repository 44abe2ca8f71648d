"""Encoding of whole texts with a public tokenizer, fast enough for every text of a corpus.

The tokenizers library needs microseconds per word, so each distinct stretch from one space to the next
goes through it once per worker, and texts are put together from the kept ids with numpy.

A text may be cut before a space that stands between two non-space characters: the split rules of both
files start a new piece at such a space, added tokens hold no space, and normal forms do not reach
across it. Some marks are cut off, too. A text with a space beside other white space is not cut at all.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from sievelight.llm.common import small_batches

# Kept stretches, ids and long stretches' bytes per worker; beyond any of them the cache starts again.
ENTRIES = 1_000_000
IDS = 8_000_000
LONG_BYTES = 8_000_000
SLOT_BITS = 21
# Stretches of at most so many bytes are kept as three machine words; the top byte holds the length.
SHORT = 23
# New stretches that go through the library in one call, and bytes of text put together at once.
JOINED = 500
SLICE_BYTES = 2_000_000

MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
# UTF-8 forms of white space beyond ASCII.
WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

Make = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Stretches:
    """Maps the stretches of texts to short arrays, each made once.

    ``make(strings)`` gives the joined arrays of new stretches and their sizes. With ``end``, every
    text's array ends with it. Keys are compared whole, so equal hashes do no harm.
    """

    def __init__(self, make: Make, end: int | None = None):
        self.make = make
        self.last = np.array([] if end is None else [end], np.int32)
        self.reset()

    def reset(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.keys = np.zeros((3, ENTRIES), np.uint64)
        self.starts, self.sizes = np.zeros(ENTRIES, np.int32), np.zeros(ENTRIES, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.flat[: len(self.last)] = self.last
        self.sizes[0], self.used, self.count = len(self.last), len(self.last), 1  # entry 0 ends a text
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def arrays(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined arrays of the texts ``data[cuts[i]:cuts[i + 1]]``, and where each starts in them."""
        if self.count > ENTRIES * 9 // 10 or self.used > IDS or self.long_bytes > LONG_BYTES:
            self.reset()
        padded = np.zeros(len(data) + 32, np.uint8)
        padded[: len(data)] = data
        begins, ends, per_text = _bounds(data, cuts)
        entries = self._entries(padded, begins, ends - begins)
        # Each text's stretches, then entry 0.
        numbers = np.zeros(len(entries) + len(per_text), np.int64)
        text = np.repeat(np.arange(len(per_text)), per_text)
        numbers[np.arange(len(entries)) + text] = entries
        sizes = self.sizes[numbers]
        to = np.cumsum(sizes, dtype=np.int64)
        take = np.repeat(self.starts[numbers] - (to - sizes), sizes)
        take += np.arange(len(take))
        return self.flat[take], np.concatenate(([0], to[np.cumsum(per_text + 1) - 1]))

    def _entries(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        found = np.full(len(begins), -1, np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        at, size = begins[short], sizes[short]
        view = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
        keys = [view[at + 8 * k] & MASK[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
        keys[2] |= size.astype(np.uint64) << np.uint64(56)
        mixed = keys[0] * MIX[0] + keys[1] * MIX[1] + keys[2] * MIX[2]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[3]
        todo = np.arange(len(short))
        while len(todo):
            got = self._lookup([k[todo] for k in keys], mixed[todo])
            found[short[todo]] = got
            todo = todo[got < 0]
            if len(todo):
                order = todo[np.argsort(mixed[todo])]
                new = order[np.append(True, mixed[order][1:] != mixed[order][:-1])]
                room = ENTRIES - self.count
                if room < len(new):
                    new = new[:room]
                if not room:
                    break
                self._insert([k[new] for k in keys], mixed[new], data, at[new], size[new])
        rest = np.flatnonzero(found < 0)
        if len(rest):
            found[rest] = self._long_entries(data, begins[rest], sizes[rest])
        return found

    def _lookup(self, keys: list[np.ndarray], mixed: np.ndarray) -> np.ndarray:
        found = np.full(len(mixed), -1, np.int64)
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(mixed))
        while len(left):
            entry = self.slots[slot[left]]
            same = entry >= 0
            for kept, key in zip(self.keys, keys):
                same &= kept[entry] == key[left]
            found[left[same]] = entry[same]
            left = left[~same & (entry >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)
        return found

    def _insert(self, keys, mixed, data, begins, sizes) -> None:
        first = self._learn(_strings(data, begins, sizes))
        entry = np.arange(first, first + len(begins), dtype=np.int32)
        for kept, key in zip(self.keys, keys):
            kept[entry] = key
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & ((1 << SLOT_BITS) - 1)

    def _long_entries(self, data, begins, sizes) -> list[int]:
        raw = [data[b : b + n].tobytes() for b, n in zip(begins.tolist(), sizes.tolist())]
        new = list({r: None for r in raw if r not in self.long})
        if new:
            first = self._learn([r.decode() for r in new], keep=False)
            self.long.update(zip(new, range(first, first + len(new))))
            self.long_bytes += sum(map(len, new))
        return [self.long[r] for r in raw]

    def _learn(self, strings: list[str], keep: bool = True) -> int:
        """Make and store the arrays of new stretches; the first one's entry number."""
        joined, sizes = self.make(strings)
        first, to = self.count, self.count + len(strings)
        if to > len(self.starts):  # long stretches beyond the short ones' room
            self.starts, self.sizes = (np.concatenate((a, np.zeros(to, np.int32))) for a in (self.starts, self.sizes))
            self.keys = np.concatenate((self.keys, np.zeros((3, to), np.uint64)), axis=1)
        while self.used + len(joined) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(joined)] = joined
        self.starts[first:to] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:to] = sizes
        self.used, self.count = self.used + len(joined), to
        return first


def _strings(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[b:e].decode() for b, e in zip(begins.tolist(), (begins + sizes).tolist())]


def _bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all stretches, and the number of stretches per text."""
    full = np.flatnonzero(np.diff(cuts))
    firsts, lasts = cuts[full], cuts[full + 1]
    blank, white = data == 32, WHITE[data]
    # A space beside white space, within one text.
    beside = (blank[1:] & white[:-1]) | (white[1:] & blank[:-1])
    odd_at = np.flatnonzero(beside)
    raw = data.tobytes()
    for form in WIDE if any(raw.find(lead) >= 0 for lead in {form[:1] for form in WIDE}) else ():
        at = raw.find(form)
        while at >= 0:
            odd_at = np.append(odd_at, at)
            at = raw.find(form, at + 1)
    odd = np.zeros(len(firsts) + 1, bool)
    odd[np.searchsorted(firsts, odd_at, "right") - 1] = True
    spaces = np.flatnonzero(blank)
    spaces = spaces[~odd[np.searchsorted(firsts, spaces, "right") - 1]]
    begins = np.sort(np.concatenate((firsts, spaces, _marks(data, white, firsts, lasts, odd))))
    begins = begins[np.append(True, begins[1:] != begins[:-1])] if len(begins) else begins
    owner = np.searchsorted(firsts, begins, "right") - 1
    ends = np.append(begins[1:], len(data))
    per_full = np.bincount(owner, minlength=len(firsts))
    final = np.cumsum(per_full) - 1
    ends[final] = lasts
    per_text = np.zeros(len(cuts) - 1, np.int64)
    per_text[full] = per_full
    return begins, ends, per_text


def _marks(data: np.ndarray, white: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """More places to cut at: around a line break between two non-space characters, and before a comma
    or full stop that follows an ASCII letter and ends a stretch. Both are pieces of their own.

    They spare entries for the same word with and without a mark.
    """
    before, after = np.concatenate(([True], white[:-1])), np.concatenate((white[1:], [True]))
    before[firsts] = True
    after[lasts - 1] = True
    lone = (data == 10) & ~before & ~after
    ends = after & (np.concatenate((data[1:], [32])) == 32) | np.concatenate((lone[1:], [True]))
    ends[lasts - 1] = True
    low = data | 32
    letter = np.concatenate(([False], (low[:-1] >= 97) & (low[:-1] <= 122)))
    mark = ((data == 44) | (data == 46)) & letter & ends & ~before
    breaks = np.flatnonzero(lone)
    cuts = np.concatenate((np.flatnonzero(mark), breaks, breaks + 1))
    return cuts[~odd[np.searchsorted(firsts, cuts, "right") - 1]]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def joined_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


def encode_strings(tokenizer, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids and their numbers per string.

    Many strings go through the library as one text, with an added token between them: the library
    takes added tokens out first and encodes what stands between them separately.
    """
    if not strings:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    added = tokenizer.get_added_tokens_decoder()
    mark = next((i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.normalized)), None)
    if mark is None or any(t.content in s for t in added.values() for s in strings):
        made = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return joined_lists([e.ids for e in made])
    ids, sizes = [], []
    for i in range(0, len(strings), JOINED):
        text = added[mark].content.join(strings[i : i + JOINED])
        got = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.concatenate(([-1], np.flatnonzero(got == mark), [len(got)]))
        ids.append(got[got != mark])
        sizes.append(np.diff(cuts) - 1)
    return np.concatenate(ids), np.concatenate(sizes)


def _byte_letters() -> dict[int, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 324))
    return {b: b if b in kept else next(others) for b in range(256)}


class WordModel:
    """Encodes plain words, with a comma or full stop or without, by the tokenizer's model alone.

    A run of letters is one piece of both split rules, and so is the mark after it; asking the model for
    each spares the library's bookkeeping of whole texts. All other strings take the usual way. What the
    tokenizer does around the model is not assumed but tried on a few words first.
    """

    TRIED = (" the", "the", " Haus", " Éléphant", " straße", " niño.", "Über,", " WORD", " слово")

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.letters = _byte_letters()
        self.lowers = self.tokenizer.normalizer is not None
        usual = [e.ids for e in self.tokenizer.encode_batch_fast([*self.TRIED, ",", "."], add_special_tokens=False)]
        self.marks = {",": usual[-2], ".": usual[-1]}
        self.plain = True
        try:
            self.plain = self._words(list(self.TRIED)) == usual[:-2]
        except Exception:  # a model of another kind
            self.plain = False

    def _words(self, strings: list[str]) -> list[list[int] | None]:
        """Ids of each string that is a plain word; None for the others."""
        tokenize, marks, space = self.tokenizer.model.tokenize, self.marks, self.letters[32]
        made: list[list[int] | None] = []
        for string in strings:
            mark = marks.get(string[-1:])
            base = string if mark is None else string[:-1]
            word = base[1:] if base[:1] == " " else base
            if not word.isalpha():
                made.append(None)
                continue
            plain = word.isascii()
            if self.lowers:
                if not plain and ("Σ" in word or not unicodedata.is_normalized("NFC", word)):
                    made.append(None)
                    continue
                base = word = word.lower()
                if not word.isalpha():
                    made.append(None)
                    continue
            if plain:
                piece = word if base is word or len(base) == len(word) else chr(space) + word
            else:
                piece = base.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in tokenize(piece)]
            made.append(ids if mark is None else ids + mark)
        return made

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain:
            return encode_strings(self.tokenizer, strings)
        made = self._words(strings)
        others = [i for i, ids in enumerate(made) if ids is None]
        ids, sizes = encode_strings(self.tokenizer, [strings[i] for i in others])
        at = np.concatenate(([0], np.cumsum(sizes))).tolist()
        rest = ids.tolist()
        for k, i in enumerate(others):
            made[i] = rest[at[k] : at[k + 1]]
        return joined_lists(made)


_ENCODERS: dict[tuple[str, int | None], Stretches] = {}


def encoder(path: str, end: int | None) -> Stretches:
    """The worker's encoder for a tokenizer file; it stays for the worker's later tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Stretches(WordModel(path), end)
    return _ENCODERS[path, end]


def release() -> None:
    """Give back what earlier tasks of other operators keep in this worker."""
    import pyarrow as pa

    if _ENCODERS:
        _ENCODERS.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def text_slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, cuts)`` of an Arrow string column, about ``SLICE_BYTES`` at a time.

    Null texts count as empty; a longer text stands alone.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def with_ids(docs, path: str, end: int):
    """Tokenise every text where it lies: ``doc_id, part, first, n_tokens, ids``.

    ``part`` is the task's partition and ``first`` the number of ids before the document in it. Write
    the frame before using ``part``, so that a task that runs again cannot mix two versions.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, first long, n_tokens long, ids array<int>"

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column("text")):
                ids, cuts = encoder(path, end).arrays(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.full(j - i, part, np.int32)),
                        pa.array(first + cuts[:-1]),
                        pa.array(np.diff(cuts)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "first", "n_tokens", "ids"],
                )
                first += int(cuts[-1])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
