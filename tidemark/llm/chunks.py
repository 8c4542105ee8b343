"""Word-wise tokenization with a bounded memory of what has been encoded.

A byte-level pattern with an optional leading space never matches across a space that follows a
visible character. So a text without runs of white space around its spaces is the chain of its
chunks, each with its leading space, and a chunk's result can be kept. Other texts are encoded
whole. The memory has two generations of bounded size and lives as long as the Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


def chunks_of(text: str) -> list[str] | None:
    """The text cut before each space; None where white space meets across a cut."""
    if "\0" in text:
        return None
    return text.replace(" ", "\0 ").split("\0")


def unsafe(chunk: str) -> bool:
    """Whether white space at the chunk's end could join white space in the next chunk."""
    return chunk[-1:].isspace()  # an empty first chunk is safe


class ChunkMemory:
    """Results by chunk. ``encode`` takes distinct chunks and gives their results in order."""

    def __init__(self, encode: Callable[[list[str]], Iterable], size: int = 300_000):
        self.encode, self.size, self.young, self.old = encode, size, {}, {}

    def lookup(self, distinct: set[str]) -> Callable:
        """Makes sure that the chunks are known; gives the function from chunk to result."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = distinct - young.keys()
        for c in missing & old.keys():
            young[c] = old[c]
        new = list(missing - old.keys())
        young.update(zip(new, self.encode(new), strict=True))
        return young.__getitem__

    def results(self, texts: list[str]) -> list[list]:
        """Each text's chunk results; a text that can't be cut is encoded as one chunk and isn't kept."""
        cut = [chunks_of(t) for t in texts]
        whole = [i for i, c in enumerate(cut) if c is None or any(map(unsafe, c))]
        for i in whole:
            cut[i] = ()
        get = self.lookup(set().union(*cut))
        found = [list(map(get, c)) for c in cut]
        for i, r in zip(whole, self.encode([texts[i] for i in whole]) if whole else (), strict=True):
            found[i] = [r]
        return found
