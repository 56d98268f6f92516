"""A compressed trie of whole texts, as bytes, that keeps the smallest id at every terminal."""

from __future__ import annotations

from collections.abc import Iterator


def shared_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes ``a`` and ``b`` have in common, by halving with whole-slice comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """An edge's bytes, the nodes below by their first byte, and the smallest id of the text that ends here."""

    __slots__ = ("edge", "below", "lowest", "ends")

    def __init__(self, edge: bytes):
        self.edge, self.below, self.lowest, self.ends = edge, {}, None, False

    def end(self, key: int | None) -> None:
        if key is not None and (self.lowest is None or key < self.lowest):
            self.lowest = key
        self.ends = True


class TextTrie:
    """Texts inserted one by one; equal texts share a terminal, texts with a common start share its path."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, text: bytes, key: int | None) -> None:
        """A null ``key`` is larger than all others."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                self.held += len(child.edge)
                child.end(key)
                return
            if not text.startswith(child.edge, at):
                upper = Node(child.edge[: shared_prefix(child.edge, text[at : at + len(child.edge)])])
                child.edge = child.edge[len(upper.edge) :]
                upper.below[child.edge[0]] = child
                node.below[text[at]] = child = upper
            at += len(child.edge)
            node = child
        node.end(key)

    def terminals(self) -> Iterator[tuple[bytes, int | None]]:
        """Every distinct text with its smallest id (null if all are), in the order of a walk of the trie."""
        stack: list[tuple[Node, bytes]] = [(self.root, b"")]
        while stack:
            node, text = stack.pop()
            text += node.edge
            if node.ends:
                yield text, node.lowest
            stack.extend((child, text) for child in node.below.values())
