"""Splitting patterns with the letter classes of the tokenizer library that they stand for.

Every library has Unicode tables of its own age, so the same \\p{L} differs from one to the next in the characters that
were added later. The classes are therefore asked from the library at hand, once per process: all code points are sent
through a pattern of that class alone, and what comes back is its members. A pattern is then compiled with these
members written out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

#: The classes that a pattern may name.
NAMED = (r"\p{L}", r"\p{N}", r"\s")
#: Characters that a library is asked for at once: what it returns takes some hundred bytes of memory for each.
ASKED = 1 << 12
#: Longer texts are cut into pieces step by step.
LONG_TEXT = 1 << 20
STEP_PIECES = 1 << 16


def all_characters() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def in_parts(text: str) -> Iterator[str]:
    return (text[i : i + ASKED] for i in range(0, len(text), ASKED))


def in_ranges(members: str, end: int) -> str:
    """Members of a class below a code point as the inside of a bracket."""
    out: list[list[int]] = []
    for c in sorted(c for c in set(map(ord, members)) if c < end):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


@lru_cache(maxsize=1)
def tiktoken_classes() -> dict[str, str]:
    """The named classes as tiktoken sees them: text outside its pattern has no ids, so the members come back."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    found = {}
    for name in NAMED:
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        found[name] = "".join(coder.decode_bytes(coder.encode_ordinary(part)).decode() for part in in_parts(all_characters()))
    return found


@lru_cache(maxsize=1)
def tokenizers_classes() -> dict[str, str]:
    """The named classes as the tokenizers library sees them."""
    from tokenizers import Regex, pre_tokenizers

    found = {}
    for name in NAMED:
        split = pre_tokenizers.Split(Regex(name), behavior="removed", invert=True)
        found[name] = "".join(piece for part in in_parts(all_characters()) for piece, _ in split.pre_tokenize_str(part))
    return found


def compiled(pattern: str, classes: dict[str, str], end: int = 0x110000) -> re.Pattern:
    """A splitting pattern with its classes written out, for texts of characters below end.

    A class of another name, or a negated one inside a bracket, raises ValueError.
    """
    inside = {name: in_ranges(members, end) for name, members in classes.items()}
    out, in_bracket, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in (*NAMED, r"\S") if pattern.startswith(n, at)), None)
        if name == r"\S":
            if in_bracket:
                raise ValueError(r"\S inside a bracket is not supported")
            out.append(f"[^{inside[chr(92) + 's']}]")
        elif name:
            out.append(inside[name] if in_bracket else f"[{inside[name]}]")
        elif pattern[at] == "\\":
            if pattern[at + 1].isalnum():
                raise ValueError(f"the class at {pattern[at:]!r} is not supported")
            name = pattern[at : at + 2]
            out.append(name)
        else:
            in_bracket = pattern[at] == "[" or in_bracket and pattern[at] != "]"
            out.append(pattern[at])
        at += len(name or " ")
    return re.compile("".join(out))


class Splitter:
    """Cuts texts by a pattern; one that names fewer characters is faster and serves most texts."""

    ENDS = (0x250, 0x10000, 0x110000)

    def __init__(self, pattern: str, classes: dict[str, str]):
        self.patterns = [compiled(pattern, classes, end) for end in self.ENDS]
        self.beyond = [re.compile(f"[^\\x00-{chr(end - 1)}]") for end in self.ENDS[:-1]]

    def pattern(self, text: str) -> re.Pattern:
        for pattern, beyond in zip(self.patterns, self.beyond):
            if text.isascii() or not beyond.search(text):
                return pattern
        return self.patterns[-1]

    def findall(self, text: str) -> list[str]:
        return self.pattern(text).findall(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, those of a long one in several lists."""
        if len(text) < LONG_TEXT:
            yield self.findall(text)
            return
        found = (m.group() for m in self.pattern(text).finditer(text))
        while part := list(islice(found, STEP_PIECES)):
            yield part
