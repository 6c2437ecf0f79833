"""Cutting texts into pretokens, as byte-level BPE vocabularies do before merging."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import regex
from tokenizers.pre_tokenizers import ByteLevel

#: Fixed value: the published pattern that cuts a text into pretokens, with white space as Unicode has it.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
_find = regex.compile(PATTERN).findall
#: Letters beyond the basic plane are still being assigned, and libraries differ on the newest.
_astral = regex.compile("[\U00010000-\U0010ffff]").search
_byte_level = ByteLevel(add_prefix_space=False, use_regex=True)
#: Characters of texts that are worked on together, bytes of what a worker remembers (an entry is charged ENTRY and its length), and the longest string that it remembers.
BATCH_CHARS, REMEMBERED_BYTES, ENTRY, LONGEST = 4 << 20, 64 << 20, 160, 64


def astral(text: str) -> bool:
    return not text.isascii() and _astral(text) is not None


def pretokens(text: str) -> list[str]:
    """The pretokens of a text that holds no special string; together they are the text."""
    if astral(text):
        return [text[a:b] for _, (a, b) in _byte_level.pre_tokenize_str(text)]
    return _find(text)


class Remembering:
    """Numbers of whole texts, summed from those of their pretokens and special strings.

    ``of_pretokens`` gives the numbers of a list of distinct pretokens; what it says is
    remembered, up to a number of bytes. ``special`` maps the special strings to theirs.
    """

    def __init__(self, of_pretokens: Callable[[list[str]], list[int]], special: dict[str, int]):
        self.of_pretokens = of_pretokens
        self.special = {(s,): n for s, n in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict = dict(self.special)
        self.bytes = 0

    def pieces(self, text: str) -> list:
        """Pretokens, and special strings as tuples of one."""
        if self.parts is None or self.parts.search(text) is None:
            return pretokens(text)
        out: list = []
        for i, part in enumerate(self.parts.split(text)):
            out += [(part,)] if i % 2 else pretokens(part)
        return out

    def texts(self, texts: Iterable[str]) -> Iterator[int]:
        """The number of each text, a few MB of text at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._batch(some)
                some, size = [], 0
        yield from self._batch(some)

    def _batch(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(text) for text in texts]
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self.of_pretokens(new), strict=True))
        number = self.known.__getitem__
        out = [sum(map(number, pieces)) for pieces in cut]
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]
            else:
                self.bytes += ENTRY + len(s)
        if self.bytes > REMEMBERED_BYTES:
            self.forget()
        return out
