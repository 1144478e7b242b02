"""Deep-shallow sorting of byte strings, with the longest common prefixes of neighbours.

Multikey quicksort splits the strings by eight bytes at a time down to a shallow depth; what is
still together there shares a long prefix, and a blind trie orders it: a string goes down by its
branching bytes alone, is compared once with a string below, and is hung in where they part."""

from __future__ import annotations

#: Bytes that the quicksort looks at.
SHALLOW = 64
STEP = 8


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n if not x else n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie whose nodes keep the depth at which their strings part and the byte of each branch; -1 is a string's end."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # [depth, {byte: node}] or (number, ...), the numbers of equal strings

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = (i,)
            return
        node = self.root
        while isinstance(node, list):  # blindly down
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common(s, other)
        parent, by, node = None, 0, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, by = node, s[node[0]]
            node = node[1][by]
        if depth == len(s) == len(other):  # equal strings end at one leaf
            while isinstance(node, list):
                parent, by = node, s[node[0]] if node[0] < len(s) else -1
                node = node[1][by]
            new: list | tuple = (*node, i)
        elif isinstance(node, list) and node[0] == depth:
            node[1][s[depth] if depth < len(s) else -1] = (i,)
            return
        else:
            new = [depth, {(s[depth] if depth < len(s) else -1): (i,), (other[depth] if depth < len(other) else -1): node}]
        if parent is None:
            self.root = new
        else:
            parent[1][by] = new

    def in_order(self) -> tuple[list[int], list[int]]:
        """Numbers in the order of their strings, and the common prefix of each with the one before (0 for the first)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple] = [(self.root, 0)] if self.root is not None else []
        while stack:
            node, above = stack.pop()
            if isinstance(node, list):
                parts = sorted(node[1].items())
                stack += [(child, node[0] if k else above) for k, (_, child) in reversed(list(enumerate(parts)))]
            else:
                order += node
                shared += [above, *[len(self.strings[node[0]])] * (len(node) - 1)]
        return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The numbers of the strings in order, and each one's common prefix with the one before."""
    order: list[int] = []
    shared: list[int] = []

    def emit(numbers: list[int], first: int, rest: list[int]) -> None:
        order.extend(numbers)
        shared.extend([first, *rest])

    # Groups still to be ordered: numbers, bytes known to be equal, common prefix with what comes before (None: to be computed).
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            before = common(strings[order[-1]], strings[group[0]]) if order else 0
            emit(group, before, [])
            continue
        if depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            numbers, inner = trie.in_order()
            before = common(strings[order[-1]], strings[numbers[0]]) if order else 0
            emit(numbers, before, inner[1:])
            continue
        key = lambda i: (strings[i][depth : depth + STEP], len(strings[i]) > depth + STEP)  # noqa: B023, E731
        pivot = sorted((key(group[0]), key(group[len(group) // 2]), key(group[-1])))[1]
        low, same, high = [], [], []
        for i in group:
            k = key(i)
            (low if k < pivot else high if k > pivot else same).append(i)
        if high:
            stack.append((high, depth))
        if not pivot[1]:  # these strings end within the step, and are equal
            stack.append((same, SHALLOW))
        else:
            stack.append((same, depth + STEP))
        if low:
            stack.append((low, depth))
    return order, shared
