"""Texts in units that a tokenizer encodes one by one exactly as within the text.

A text is cut before each single blank that stands behind anything but white space and before a Latin letter (ASCII or Latin-1),
a digit or an ASCII mark. Byte-level tokenizers that split by the usual pattern (` ?\\p{L}+| ?\\p{N}+|...`) start a token at
such a blank, and never join a letter with a mark of ENDS behind it, so a unit may also be cut before the
marks at its end. Every distinct unit is encoded by the tokenizer once per worker;
what a text needs is then a lookup. `cut_all` and `numbered` do this for whole Arrow arrays, where Python sees each distinct word of an array once. The store of units is bounded; when it is full units that end in marks go (they are
put together again from word and marks), then all but those just asked for, and long units are never kept."""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, filterfalse
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = "!-~À-ÖØ-öø-ÿ"
CUT = re.compile(rf"(?<=\S) (?=[{WORD}])")
# A blank where CUT does not cut, but for one that begins the text.
OTHER_BLANK = re.compile(rf" (?:(?![{WORD}])|(?<=\s ))")
# A line break beside other white space or at the end.
OTHER_BREAK = re.compile(r"\n(?:(?=\s|\Z)|(?<=\s\n))")
ENDS = ".,!?;:#&%$*|"
# What Python's \s matches, and letters as of is_letter, in classes of Arrow's patterns.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
# Texts in which not every blank is a cut; the second is for line breaks as well.
ODD_BLANKS = rf"^ |[{SPACES}] | [^{WORD}]| $"
ODD_BREAKS = rf"^[{SPACES}]|[{SPACES}][ \n]|\n[{SPACES}]|\n$| [^{WORD}]| $"
SLICE = 1 << 20
KEPT_UNITS = 400_000
KEPT_CHARS = 40


def is_letter(c: str) -> bool:
    """Of ASCII or Latin-1."""
    return c.isalpha() and c <= "ÿ"


def once(key: Any, make: Callable[[], Any]) -> Any:
    """make(), kept for the life of this Python worker: functions sent with a job are new for each task, so
    a tokenizer would otherwise be read again by every one."""
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


@contextmanager
def no_collection() -> Iterator[None]:
    """Without garbage collection for a while: it would walk the whole store of units again and again, and nothing
    here makes cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def slices(text: str, size: int = SLICE) -> Iterator[tuple[str, bool]]:
    """A long text in slices of about `size` characters that end where units end, and whether each is the last.
    The blank between two slices goes to neither."""
    start = 0
    while len(text) - start > size:
        gap = CUT.search(text, start + size)
        if not gap:
            break
        yield text[start : gap.start()], False
        start = gap.end()
    yield text[start:], True


def cut(text: str) -> list[str]:
    """CUT.split(text); where every blank is a cut, without the pattern."""
    return CUT.split(text) if text[:1] == " " or OTHER_BLANK.search(text) else text.split(" ")


def cut_lines(text: str) -> list[str]:
    """`cut`, and units begin with line breaks too if each of these stands between other characters."""
    if text[:1].isspace() or OTHER_BLANK.search(text) or OTHER_BREAK.search(text):
        return cut(text)
    return text.replace("\n", " \n").split(" ")


def cut_all(texts: pa.Array, lines: bool = False) -> pa.Array:
    """`cut`, or with `lines` `cut_lines`, of every text."""
    split = lambda some: pc.split_pattern(pc.replace_substring(some, "\n", " \n") if lines else some, " ")
    odd = pc.match_substring_regex(texts, ODD_BREAKS if lines else ODD_BLANKS).to_numpy(zero_copy_only=False)
    if not odd.any():
        return split(texts)
    # An array for each text: Python holds the units of one only.
    found = [pa.array([cut(text)], pa.list_(texts.type)) for text in texts.filter(pa.array(odd)).to_pylist()]
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    return pa.concat_arrays([split(texts.filter(pa.array(~odd))), *found]).take(pa.array(np.argsort(order)))


def numbered(values: pa.Array, units: Units, tails: Callable[[list[str]], list[bytes]]) -> tuple[pa.Array, pa.Array]:
    """Units as places in the second array, which has the encodings (bytes) of the distinct ones. Marks of ENDS behind a
    letter at the end of a unit are encoded by `tails`, so `units` sees words without them."""
    coded = values.dictionary_encode()
    whole = coded.dictionary
    words = pc.utf8_rtrim(whole, characters=ENDS)
    ended = pc.and_(pc.match_substring_regex(words, f"[{LETTERS}]$"), pc.less(pc.binary_length(words), pc.binary_length(whole)))
    words = pc.if_else(ended, words, whole).dictionary_encode()
    with no_collection():
        (known,) = units.encodings([words.dictionary.to_numpy(zero_copy_only=False).tolist()])
        known = pa.array(known, pa.large_binary()).take(words.indices)
        marks = pc.replace_substring_regex(whole.filter(ended), f"(?s)^.*[{LETTERS}]", "").dictionary_encode()
        behind = pa.array(tails(marks.dictionary.to_pylist()), pa.large_binary()).take(marks.indices)
    joined = pc.binary_join_element_wise(known.filter(ended), behind, pa.scalar(b"", pa.large_binary()))
    return coded.indices, pc.replace_with_mask(known, ended, joined)


class Units:
    """Encodings of units. `encode(list of units)` gives an encoding for each, as it stands behind a blank;
    `tails` gives those of marks behind a letter; `join` puts the two together."""

    def __init__(self, encode: Callable[[list[str]], list], tails: Callable[[list[str]], list], join: Callable[[Any, Any], Any], most: int = KEPT_UNITS, ends: bool = True):
        self.encode, self.tails, self.join, self.most, self.cut_ends = encode, tails, join, most, ends
        self.kept: dict[str, Any] = {}
        self.ends: dict[str, Any] = {}
        self.passing: list[str] = []
        self.tailed: list[str] = []

    def look_up(self, units: Iterable[str]) -> dict[str, Any]:
        """A dictionary that holds all `units`, and maybe more; valid until the next call. Long units go then."""
        units = self._room(units)
        self._learn(set(filterfalse(self.kept.__contains__, units)))
        return self.kept

    def encodings(self, lists: list[list[str]]) -> list[list]:
        """The encodings of each list of units. What is known already is looked up once only."""
        self._room(chain.from_iterable(lists))
        find = self.kept.get
        found = [list(map(find, units)) for units in lists]
        gaps = [[i for i, x in enumerate(some) if x is None] for some in found]
        self._learn({units[i] for units, open_at in zip(lists, gaps) for i in open_at})
        for units, some, open_at in zip(lists, found, gaps):
            for i in open_at:
                some[i] = find(units[i])
        return found

    def _room(self, units: Iterable[str]) -> Iterable[str]:
        """Forgets units if need be; gives `units` back."""
        kept = self.kept
        for unit in self.passing:
            kept.pop(unit, None)
        self.passing = []
        if len(kept) > self.most:
            for unit in self.tailed:
                kept.pop(unit, None)
            self.tailed = []
            if len(kept) > self.most * 3 // 4:
                units = set(units)
                self.kept = {unit: kept[unit] for unit in units if unit in kept}
        return units

    def _learn(self, units: set[str]) -> None:
        """Encodes units that are not kept."""
        kept, passing = self.kept, self.passing
        if not self.cut_ends:
            fresh = list(units)
            kept.update(zip(fresh, self.encode(fresh)))
            passing += [u for u in fresh if len(u) > KEPT_CHARS]
            return
        words, ended = set(), {}
        for unit in units:
            if unit[-1:] in ENDS:
                word = unit.rstrip(ENDS)
                if is_letter(word[-1:]):
                    ended[unit] = word
                    if word not in kept:
                        words.add(word)
                    continue
            words.add(unit)
        if words:
            fresh = sorted(words)
            kept.update(zip(fresh, self.encode(fresh)))
            passing += [w for w in fresh if len(w) > KEPT_CHARS]
        if ended:
            tails = {unit[len(word) :] for unit, word in ended.items()}.difference(self.ends)
            if tails:
                if len(self.ends) > 1024:
                    self.ends.clear()
                    tails = {unit[len(word) :] for unit, word in ended.items()}
                fresh = sorted(tails)
                self.ends.update(zip(fresh, self.tails(fresh)))
            for unit, word in ended.items():
                kept[unit] = self.join(kept[word], self.ends[unit[len(word) :]])
                (passing if len(unit) > KEPT_CHARS else self.tailed).append(unit)
