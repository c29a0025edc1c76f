"""Deep-shallow sorting of suffixes.

Multikey quicksort goes to a shallow depth: suffixes are split three ways by eight bytes at a time, and those that equal
the pivot go on with the next eight. All groups are split side by side. What is equal down to the shallow depth has a
long common prefix; each such group is ordered by a blind trie, which looks at branching bytes only on its way down and
compares a suffix with one leaf.
"""
from __future__ import annotations

import numpy as np

SHALLOW = 40
STEP = 8


class BlindTrie:
    """Strings of one length; inner nodes are [depth, {byte: child}], leaves (string, members)."""

    def __init__(self):
        self.root: list | tuple | None = None

    def insert(self, s: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (s, [member])
            return
        while node.__class__ is list:  # blindly: where no branch fits, any leaf below tells how far the prefix goes
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[0] == s:
            node[1].append(member)
            return
        x = int.from_bytes(s) ^ int.from_bytes(node[0])
        depth = len(s) - (x.bit_length() + 7) // 8  # of the first byte that differs
        other = node[0][depth]
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        leaf = (s, [member])
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        inner = [depth, {other: node, s[depth]: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][s[parent[0]]] = inner

    def leaves(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def _keys(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | data[at + k]
    return out


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): suffixes by their first `depth` bytes, and which of them, in that order, differ from the one before.

    sizes: of stretches of `starts` that are to be sorted each by itself, where suffixes are dealt out beforehand.
    """
    n = len(starts)
    order, new = np.arange(n), np.zeros(n, bool)
    size = np.array([n]) if sizes is None else sizes[sizes > 0]
    begin = np.cumsum(size) - size
    new[begin[:n]] = True
    shallow = min(shallow, depth)
    # a group is a stretch of `order`; each pass splits every open group around its middle suffix
    begin, size = begin[size > 1], size[size > 1]
    level, deep = np.zeros(len(begin), np.int64), []
    while len(begin):
        group = np.repeat(np.arange(len(begin)), size)
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        suffix = order[at]
        key = np.empty(len(at), np.uint64)
        for d in np.unique(level):
            mine = level[group] == d
            key[mine] = _keys(data, starts[suffix[mine]] + d, min(STEP, shallow - d))
        pivot = key[np.cumsum(size) - size + size // 2][group]
        side = (key > pivot).astype(np.int64) * 2 + (key == pivot)
        by = np.argsort(group * 3 + side, kind="stable")
        order[at] = suffix[by]
        part = (group * 3 + side)[by]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        new[at[first]] = True
        count, equal, down = np.diff(np.append(first, len(part))), part[first] % 3 == 1, level[part[first] // 3]
        down = down + np.where(equal, STEP, 0)
        many = count > 1
        done = many & (down >= shallow)
        if shallow < depth:
            deep += zip(at[first[done]].tolist(), count[done].tolist())
        go = many & ~done
        begin, size, level = at[first[go]], count[go], down[go]
    if deep:
        _sort_deep(data, starts, shallow, depth, order, new, *(np.array(x) for x in zip(*deep)))
    return order, new


def _sort_deep(data: np.ndarray, starts: np.ndarray, shallow: int, depth: int, order: np.ndarray, new: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Orders stretches of suffixes that are equal down to `shallow`. Those that equal the first of their group are told
    apart from the others for all groups at once; a trie gets them as one leaf, and the others one by one."""
    group = np.repeat(np.arange(len(begin)), size)
    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    mine, first = starts[order[at]], starts[order[begin]][group]
    same = np.ones(len(at), bool)
    for d in range(shallow, depth, STEP):
        left = np.flatnonzero(same)
        step = min(STEP, depth - d)
        same[left] = _keys(data, mine[left] + d, step) == _keys(data, first[left] + d, step)
    some = np.unique(group[~same])
    for g, b, m in zip(some.tolist(), begin[some].tolist(), size[some].tolist()):
        at = int(np.searchsorted(group, g))
        here, equal = order[b : b + m], same[at : at + m]
        trie = BlindTrie()
        trie.root = (data[starts[here[0]] + shallow : starts[here[0]] + depth].tobytes(), here[equal].tolist())
        for i in here[~equal].tolist():
            trie.insert(data[starts[i] + shallow : starts[i] + depth].tobytes(), i)
        for members in trie.leaves():
            order[b : b + len(members)] = members
            new[b] = True
            b += len(members)
