"""A suffix tree that one process holds whole: what the table of the operator is compared with."""

import numpy as np

from tidemark.llm.suffixtree import _END, BITS, CLASSES, DEPTH, PULL, padding

#: Symbols of a block that the automaton walks.
BLOCK = 512


class Tree:
    """A whole tree in one process with an automaton over its contexts."""

    def __init__(self, classes: np.ndarray, byte_share: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        """``levels``: for each depth from 0 the contexts in order and the counts of their next classes.

        With a context its shorter suffixes are there. ``byte_share``: log10 share of each byte in its class.
        """
        self.classes, self.byte_share = classes, byte_share
        root = (levels[0][1].sum(axis=0) + 1.0).astype(np.float64)
        upper, above = np.zeros(1, np.int64), root[None, :]
        gains, depths, names, tables = [], [], [], []
        for depth in range(1, DEPTH + 1):
            name, table = levels[depth]
            parent = np.searchsorted(upper, name & ((1 << BITS * (depth - 1)) - 1))
            gain = np.empty(len(name))
            for at in range(0, len(name), 4096):
                part = table[at : at + 4096].astype(np.float64)
                shorter = above[parent[at : at + 4096]] + 0.5
                p = shorter / shorter.sum(axis=1, keepdims=True)
                total = part.sum(axis=1, keepdims=True)
                divergence = (part * np.log2(np.where(part > 0, part / total / p, 1))).sum(axis=1)
                gain[at : at + 4096] = divergence - 0.5 * np.log2(total[:, 0] + 1) * (part > 0).sum(axis=1)
            good = np.flatnonzero(gain > 0)
            gains.append(gain[good])
            depths.append(np.full(len(good), depth))
            names.append(name[good])
            tables.append(table[good])
            upper, above = name, table
        gain, depth, name = (np.concatenate(x) for x in (gains, depths, names))
        row_of = np.concatenate([np.arange(len(t)) for t in tables])
        best = np.lexsort((name, depth))
        self._automaton(depth[best], name[best])
        probability = np.zeros((len(best) + 1, CLASSES), np.float32)
        probability[0] = root / root.sum()
        for i, (d, r) in enumerate(zip(depth[best].tolist(), row_of[best].tolist(), strict=True)):
            row = tables[d - 1][r] + PULL * probability[self.shorter[i]]
            probability[i + 1] = row / row.sum()
        self.log = np.log10(probability)

    def _automaton(self, depths: np.ndarray, names: np.ndarray) -> None:
        """Nodes are the beginnings of contexts; each knows where a symbol leads and its longest state."""
        children: list[dict[int, int]] = [{}]
        own = {0: 0}
        ends = []
        for i, (depth, name) in enumerate(zip(depths.tolist(), names.tolist(), strict=True)):
            node = 0
            for back in range(depth - 1, -1, -1):
                symbol = (name >> BITS * back) & (CLASSES - 1)
                step = children[node].get(symbol)
                if step is None:
                    step = children[node][symbol] = len(children)
                    children.append({})
                node = step
            own[node] = i + 1
            ends.append(node)
        self.next = np.zeros((len(children), CLASSES), np.int32)
        self.state = np.zeros(len(children), np.int32)
        fail = [0] * len(children)
        queue = [0]
        above = {}
        for node in queue:
            if node:
                self.next[node] = self.next[fail[node]]
                longest = int(self.state[fail[node]])
                above[node] = longest
                self.state[node] = own.get(node, longest)
            for symbol, child in children[node].items():
                fail[child] = int(self.next[node, symbol]) if node else 0
                self.next[node, symbol] = child
                queue.append(child)
        #: State to which each state is smoothed: the longest that is a proper suffix.
        self.shorter = [above[node] for node in ends]

    def scores(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        if len(heads) < 2:
            return np.zeros(0)
        padded = np.full(-(-len(data) // BLOCK) * BLOCK, _END, np.uint8)
        padded[: len(data)] = data
        blocks = self.classes[padded].reshape(-1, BLOCK)
        node = np.zeros(len(blocks), np.int32)
        warm = np.zeros((len(blocks), DEPTH), np.uint8)
        warm[1:] = blocks[:-1, -DEPTH:]
        for i in range(DEPTH):
            node = self.next[node, warm[:, i]]
        columns = np.ascontiguousarray(blocks.T)
        value = np.empty(columns.shape, np.float32)
        for i in range(BLOCK):
            value[i] = self.log[self.state[node], columns[i]]
            node = self.next[node, columns[i]]
        value = value.T.ravel()[: len(data)] + self.byte_share[data]
        value[padding(heads)] = 0
        return np.add.reduceat(value, heads[:-1])
