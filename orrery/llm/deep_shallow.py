"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, then blind tries.

Strings are rows of big-endian 64-bit words, zero-filled to one width.  The
shallow pass is a multikey quicksort whose character is a word: each segment of rows
is split three ways by a pivot's character at the segment's depth, and only the
middle part goes on to the next character.  All segments of a round are split at once.
Segments that still share the shallow depth are each ordered by a blind trie, which
compares whole strings only once per insertion.
"""

from __future__ import annotations

import numpy as np

from orrery.llm.textops import U64, mix, words64

SHALLOW = 4  # words


class BlindTrie:
    """A Patricia trie over integers of equal width, read as byte strings.

    Inner nodes are (depth, {byte: node}), leaves (None, string, members).
    """

    def __init__(self, width: int):
        self.width, self.root = width, None
        self.keys: list[int] = []

    def _byte(self, key: int, depth: int) -> int:
        return key >> (8 * (self.width - 1 - depth)) & 255

    def insert(self, member: int, key: int) -> None:
        if self.root is None:
            self.root = (None, key, [member])
            return
        # blind descent: only the branching bytes are looked at
        node, path = self.root, []
        while node[0] is not None:
            path.append(node)
            child = node[1].get(self._byte(key, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        apart = key ^ node[1]
        if not apart:
            node[2].append(member)
            return
        depth = self.width - (apart.bit_length() + 7) // 8
        parent = None
        for at in path:
            if at[0] >= depth:
                break
            parent = at
        leaf = (None, key, [member])
        below = self.root if parent is None else parent[1].get(self._byte(key, parent[0]))
        if below is None:
            parent[1][self._byte(key, parent[0])] = leaf
        elif below[0] == depth:
            below[1][self._byte(key, depth)] = leaf
        else:
            other = below
            while other[0] is not None:
                other = next(iter(other[1].values()))
            inner = (depth, {self._byte(other[1], depth): below, self._byte(key, depth): leaf})
            if parent is None:
                self.root = inner
            else:
                parent[1][self._byte(key, parent[0])] = inner

    def ordered(self) -> list[int]:
        """Members in the order of their strings; equal strings in the order of insertion."""
        out: list[int] = []
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def words_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Strings data[start : start + length], or backwards from start - 1, as big-endian words."""
    out = np.empty((len(starts), width), np.uint64)
    if backwards:  # eight bytes read with the last one first are the reversed string's next word
        room = 8 * width
        view, starts = words64(np.concatenate([np.zeros(room, np.uint8), data])), starts + room
    else:
        view = words64(data)
    for k in range(width):
        have = np.clip(lengths - 8 * k, 0, 8)
        word = view[starts - 8 * (k + 1)] if backwards else view[np.minimum(starts + 8 * k, len(data))].byteswap()
        gone = np.minimum(8 * (8 - have), 63).astype(np.uint64)
        out[:, k] = np.where(have > 0, word >> gone << gone, U64(0))
    return out


def multikey_quicksort(words: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows by (group, first ``depth`` words), ties by row, and the (begin, end) of its segments that share all these."""
    order = np.argsort(groups, kind="stable")
    label = groups[order]
    begin = np.flatnonzero(np.append(True, label[1:] != label[:-1])) if len(label) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(label)))
    level = np.zeros(len(begin), np.int64)
    deep: list[np.ndarray] = []
    live = size > 1
    begin, size, level = begin[live], size[live], level[live]
    turn = 0
    while len(begin):
        turn += 1
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(begin)), size)
        rows = order[np.arange(len(segment)) + (begin - first)[segment]]
        key = words[rows, level[segment]]
        # the pivot: the median of three characters from anywhere in the segment
        draw = [key[first + (mix((begin + 3 * turn + k).astype(np.uint64)) % size.astype(np.uint64)).astype(np.int64)] for k in range(3)]
        pivot = np.maximum(np.minimum(draw[0], draw[1]), np.minimum(np.maximum(draw[0], draw[1]), draw[2]))[segment]
        side = (key > pivot).astype(np.int64) - (key < pivot) + 1
        counts = np.bincount(3 * segment + side, minlength=3 * len(begin)).reshape(-1, 3)
        offset = np.cumsum(counts, axis=1) - counts
        place = np.empty(len(rows), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            before = np.cumsum(counts[:, k]) - counts[:, k]
            of = segment[mine]
            place[mine] = np.arange(len(mine)) - before[of] + (begin + offset[:, k])[of]
        order[place] = rows
        begin, size = (begin[:, None] + offset).ravel(), counts.ravel()
        level = (level[:, None] + np.array([0, 1, 0])).ravel()
        live = size > 1
        done = live & (level >= depth)
        if done.any():
            deep.append(np.stack([begin[done], begin[done] + size[done]], axis=1))
        live &= ~done
        begin, size, level = begin[live], size[live], level[live]
    return order, np.concatenate(deep).tolist() if deep else []


def sort_strings(words: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """An order of the rows by (group, string), ties by row."""
    shallow = min(shallow, words.shape[1])
    order, segments = multikey_quicksort(words, groups, shallow)
    if shallow == words.shape[1] or not segments:
        return order
    # segments of equal strings are in order
    apart = np.append(False, (words[order[1:], shallow:] != words[order[:-1], shallow:]).any(axis=1))
    changes = np.cumsum(apart)
    width = 8 * (words.shape[1] - shallow)
    for a, b in segments:
        if changes[b - 1] == changes[a]:
            continue
        rows = order[a:b]
        raw = words[rows, shallow:].astype(">u8").tobytes()
        trie = BlindTrie(width)
        for i, row in enumerate(rows.tolist()):
            trie.insert(row, int.from_bytes(raw[i * width : (i + 1) * width], "big"))
        order[a:b] = trie.ordered()
    return order


def neighbour_lcp(words: np.ndarray, order: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Common bytes of each ordered row with the one before; -1 where a group begins."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        x = words[order[1:]] ^ words[order[:-1]]
        differs = x != 0
        at = differs.argmax(axis=1)
        word = x[np.arange(len(x)), at]
        free = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            free += word < np.uint64(1 << (8 * (8 - k)))
        out[1:] = np.where(differs.any(axis=1), 8 * at + free, 8 * words.shape[1])
        out[1:][groups[order[1:]] != groups[order[:-1]]] = -1
    return out
