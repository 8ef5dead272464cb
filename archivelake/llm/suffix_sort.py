"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, blind tries for what is still equal there."""

from __future__ import annotations

#: Bytes that multikey quicksort takes for one key.
KEY = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    apart = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (apart.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie that keeps only branching bytes and depths: a string goes down blindly by its bytes at the branching
    depths, and one comparison with the leaf it meets tells where it branches off. A string's end counts as a byte of -1."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        size, node, path = len(s), self.root, []
        while type(node) is tuple:
            path.append(node)
            depth, below = node
            child = below.get(s[depth] if depth < size else -1)
            node = next(iter(below.values())) if child is None else child
        other = self.strings[node[0]]
        lcp = common_prefix(s, other)
        if lcp == size == len(other):
            node.append(i)
            return
        while path and path[-1][0] > lcp:
            node = path.pop()
        mine = s[lcp] if lcp < size else -1
        if path and path[-1][0] == lcp:
            path[-1][1][mine] = [i]
            return
        old = other[lcp] if lcp < len(other) else -1
        branch = (lcp, {old: node, mine: [i]})
        if not path:
            self.root = branch
        else:
            depth, below = path[-1]
            below[s[depth] if depth < size else -1] = branch

    def ordered(self, first: int, order: list[int], lcps: list[int]) -> None:
        """Appends the strings in order, each with its common prefix with the one before it (first: of the first)."""
        stack = [(self.root, first)]
        while stack:
            node, lcp = stack.pop()
            if type(node) is tuple:
                depth, below = node
                keys = sorted(below)
                stack.extend((below[k], depth) for k in reversed(keys[1:]))
                stack.append((below[keys[0]], lcp))
            else:
                size = len(self.strings[node[0]])
                for k, i in enumerate(node):
                    order.append(i)
                    lcps.append(size if k else lcp)


def deep_shallow(strings: list[bytes], shallow: int) -> tuple[list[int], list[int]]:
    """The sorted order of strings, and each one's common prefix with the one before it in that order (0 for the first)."""
    order: list[int] = []
    lcps: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1 or depth >= shallow:
            first = common_prefix(strings[order[-1]], strings[group[0]]) if order else 0
            if len(group) == 1:
                order.append(group[0])
                lcps.append(first)
                continue
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            at = len(order)
            trie.ordered(first, order, lcps)
            if at:
                lcps[at] = common_prefix(strings[order[at - 1]], strings[order[at]])
            continue
        end = depth + KEY
        keys = [strings[i][depth:end] for i in group]
        pivot = keys[len(keys) // 2]
        less = [i for i, k in zip(group, keys) if k < pivot]
        more = [i for i, k in zip(group, keys) if k > pivot]
        same = [i for i, k in zip(group, keys) if k == pivot] if less or more else group
        if more:
            stack.append((more, depth))
        # strings that end within the key are equal here and stay one group
        stack.append((same, end if len(pivot) == KEY else shallow))
        if less:
            stack.append((less, depth))
    return order, lcps
