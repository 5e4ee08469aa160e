"""Adaptive radix tree over byte strings, with path compression and node layouts that grow with their children."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Sorted:
    """Up to `limit` children beside their bytes in order: layouts of 4 and 16."""

    __slots__ = ("limit", "keys", "kids")

    def __init__(self, limit: int = 4):
        self.limit, self.keys, self.kids = limit, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, kid: Node) -> Sorted | Indexed:
        if len(self.keys) == self.limit:
            larger = Sorted(16) if self.limit == 4 else Indexed()
            for b, k in self.items():
                larger.put(b, k)
            return larger.put(byte, kid)
        at = bisect_left(self.keys, byte)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.kids)


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid: Node) -> Indexed | Full:
        if len(self.kids) == 48:
            larger = Full()
            for b, k in self.items():
                larger.put(b, k)
            return larger.put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)


class Full:
    """A place for each of 256 bytes."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> Full:
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """`path` is what all keys below share after the byte that led here; `end` is the value of the key that ends here."""

    __slots__ = ("path", "end", "below")

    def __init__(self, path: bytes = b"", end: object = None, below: Sorted | Indexed | Full | None = None):
        self.path, self.end, self.below = path, end, below

    def items(self) -> Iterator[tuple[int, Node]]:
        return self.below.items() if self.below else iter(())


class Tree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, end: object) -> None:
        """Add a key that isn't in the tree yet."""
        if self.root is None:
            self.root = Node(key, end)
            return
        node, at = self.root, 0
        while True:
            same = common(node.path, key[at : at + len(node.path)])
            if same < len(node.path):  # the compressed path splits here
                lower = Node(node.path[same + 1 :], node.end, node.below)
                node.below = Sorted().put(node.path[same], lower)
                node.path, node.end = node.path[:same], None
            at += same
            if at == len(key):
                node.end = end
                return
            kid = node.below.get(key[at]) if node.below else None
            if kid is None:
                node.below = (node.below or Sorted()).put(key[at], Node(key[at + 1 :], end))
                return
            node, at = kid, at + 1
