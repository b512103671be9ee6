"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes with A-Z lower-cased, after ``DEPTH`` zero bytes and before one zero byte that ends it. Each
byte is eight binary decisions; a decision's context is the bits before it in the byte and the preceding 0 to
``DEPTH`` bytes. In the tree of these contexts every node weighs its own Krichevsky-Trofimov estimate against
its children, so a prediction mixes the estimates of all depths by their posterior weights; the path ends at the
last node that training saw. The code length of a text is minus its log2 probability.

Nothing of the model is capped and no machine holds it whole. (context, byte) counts of all documents are summed
in each task, dealt out by parts of their hashes in blocks, and summed part by part, so they grow with the corpus and no
row is made of each before they are whole. Contexts that share their last ``ROOT`` bytes
form a subtree; a task weighs whole subtrees and gives, for every (context, byte) that any text asks for, the
probability below the root. What leaves a subtree upwards are sums per node of depth ``ROOT`` - 1: at most 255 for
each of 65536 pairs of bytes, in texts far fewer. From these the driver weighs the top of the tree, which is broadcast
to finish the probabilities.
The log probabilities of the ``FREQUENT_CODES`` most frequent codes are then broadcast, and all others are joined to
the documents by code, so every byte of every text meets its exact probability. No task sorts or gathers keys to
find the most frequent: a histogram of their counts gives the bound.

The base is a unigram model of words. Its counts aren't bounded: the ``FREQUENT`` most frequent words are broadcast,
all others are joined by hash, so every token of every document meets its exact count.

Defined results: a null text counts as empty and is one end token. Without training documents N and V are 0,
the base is 0 and the model gives each bit one half. Rows repeated under one id are scored each and learned from
each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import LOWER, SPACE, slices, utf8, words
from .work import crc_mod, table, written

DEPTH = 6
ROOT = 3
CHUNK = 200_000
FREQUENT = 1 << 18
FREQUENT_CODES = 1 << 20
SLOTS = 1 << 21
SLICE = 1 << 20
HELD = 1_000_000
#: Parts of the hashes of words, and of those of codes, as a power of two.
PARTS = 11
END = np.uint64(0x5EED)
WORD = ~SPACE


def symbols(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (preceding ``depth`` bytes, byte), text after text with its end, and where each text begins."""
    n = len(offsets) - 1
    begin = offsets[:-1] + np.arange(n) * (depth + 1)  # of each text's first symbol among the codes
    inside = np.ones(len(data) + n * (depth + 1), bool)
    inside[(begin[:, None] + np.arange(depth)).ravel()] = False
    inside[offsets[1:] + np.arange(n) * (depth + 1) + depth] = False
    padded = np.zeros(7 - depth + len(inside), np.uint8)
    padded[7 - depth :][inside] = LOWER[data]
    # the eight bytes that end with the symbol, as one number, less those before its context
    wide = np.ndarray(max(0, len(inside) - depth), ">u8", padded, 0, (1,))
    code = (wide & np.uint64((1 << 8 * (depth + 1)) - 1)).astype(np.int64)
    keep = np.ones(len(code), bool)
    for j in range(depth):  # codes that end in the next text's padding
        at = begin[1:] - 1 - j
        keep[at] = False
    return code[keep], offsets[:-1] + np.arange(n)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for j in range(8):
        shift *= x + j
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


#: Log gamma of k + 1/2 and of k + 1, for the counts that most nodes have.
_HALVES, _WHOLES = (_log_gamma(np.arange(1 << 12) + x) for x in (0.5, 1.0))


def _looked_up(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(table))
    out[large] = _log_gamma(n[large] + shift)
    return out


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability; a part of the nodes at a time."""
    out = np.empty(len(n0))
    for a in range(0, len(n0), 1 << 17):
        x, y = n0[a : a + (1 << 17)], n1[a : a + (1 << 17)]
        out[a : a + (1 << 17)] = _looked_up(x, _HALVES, 0.5) + _looked_up(y, _HALVES, 0.5) - 2 * 0.5723649429247001 - _looked_up(x + y, _WHOLES, 1.0)
    return out


def _nodes(code: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Sorted node keys of one depth and what each saw, zeros and ones; and [bit, code] the node of each bit of each code. Codes are sorted, so a node's lie together."""
    keys, zeros, ones, size = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], 0
    at = np.zeros((8, len(code)), np.int64)
    for b in range(8 if len(code) else 0):
        part = code >> (8 - b)
        new = np.concatenate([[True], part[1:] != part[:-1]])
        first = np.flatnonzero(new)
        at[b] = np.cumsum(new) + (size - 1)
        size += len(first)
        bit = (code >> (7 - b)) & 1
        every, n1 = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
        start = code[first]
        keys.append(((start >> 8) << 8) | (1 << b) | ((start & 255) >> (8 - b)))
        zeros.append((every - n1).astype(float))
        ones.append(n1.astype(float))
    key = np.concatenate(keys)
    order = np.argsort(key)
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return (key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]), place[at] if size else at


class Tree:
    """Depths ``root`` to ``depth`` of the tree: sorted node keys (context bytes, bit prefix), and for each node its ``path`` from the root.

    A path is what the depths passed give a 1, the weight that is left for deeper ones, and the last estimate of a 1. The tree is made
    from its deepest nodes; ``children`` are the summed log weights of the nodes below those, if any. A node that training did not see
    weighs nothing and has the path of the node above it.
    ``up`` holds what the nodes above the root need: their keys, zeros, ones and the log weights of their children.
    """

    def __init__(self, nodes: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int, root: int = 0, children: np.ndarray | None = None):
        self.root, self.depth = root, depth
        self.keys: dict[int, np.ndarray] = {}
        self.path: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        own_part: dict[int, tuple[np.ndarray, ...]] = {}
        keys, n0, n1 = nodes
        for d in range(depth, root - 1, -1):
            weighted = own = _kt(n0, n1)
            stop = np.ones(len(keys))
            if children is not None:
                weighted = np.logaddexp(own, children) + np.log(0.5)
                stop = np.exp(np.log(0.5) + own - weighted)
            above, number = np.unique(keys & ((1 << 8 * d) - 1), return_inverse=True)
            self.keys[d], own_part[d] = keys, (number, n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1), stop)
            # the float type is for sums of nothing, which are ints
            n0, n1, children = (np.bincount(number, weights=v, minlength=len(above)).astype(float) for v in (n0, n1, weighted))
            keys = above
        seen = n0 + n1 > 0
        self.up = (keys[seen], n0[seen], n1[seen], children[seen])
        for d in range(root, depth + 1):
            number, seen, one, stop = own_part.pop(d)
            passed, left, last = (x[number] for x in self.path[d - 1]) if d > root else (np.zeros(len(number)), np.ones(len(number)), np.full(len(number), np.nan))
            here = np.where(seen, left * stop, 0)
            self.path[d] = passed + here * one, np.where(seen, left * (1 - stop), left), np.where(seen, one, last)

    @property
    def one(self) -> dict[int, np.ndarray]:
        """The last estimate of a 1 at each node."""
        return {d: last for d, (_, _, last) in self.path.items()}

    @classmethod
    def of(cls, code: np.ndarray, n: np.ndarray, depth: int, root: int = 0) -> Tree:
        """From sorted codes of (``depth`` context bytes, byte) and how often training saw each; 0 for those that are only asked for."""
        return cls(_nodes(code[n > 0], n[n > 0])[0], depth, root)

    @classmethod
    def asked(cls, code: np.ndarray, n: np.ndarray, depth: int, root: int = 0) -> tuple[Tree, np.ndarray]:
        """As ``of``, with ``bits`` of the same codes: these know their nodes, so none is searched for."""
        nodes, at = _nodes(code, n)
        tree = cls(nodes, depth, root)
        passed, left, last = tree.path[depth]
        p = passed + left * last
        out = np.empty((len(code), 8))
        for b in range(8):
            one = p[at[b]]
            out[:, b] = np.where((code >> (7 - b)) & 1, one, 1 - one)
        return tree, out

    def bits(self, code: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the eight bits of each code's byte; NaN where the root has no node. ``below``: those of the depths below this tree's."""
        context, byte = code >> 8, code & 255
        out = np.empty((len(code), 8))
        for b in range(8):
            prefix, bit = (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1 == 1
            passed, left, last = np.zeros(len(code)), np.ones(len(code)), np.full(len(code), np.nan)
            todo = np.arange(len(code))
            for d in range(self.depth, self.root - 1, -1):  # the deepest node has all of its path
                keys = self.keys[d]
                if not len(keys):
                    continue
                key = ((context[todo] & ((1 << 8 * d) - 1)) << 8) | prefix[todo]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                hit, at = todo[there], at[there]
                passed[hit], left[hit], last[hit] = (x[at] for x in self.path[d])
                todo = todo[~there]
            last = np.where(bit, last, 1 - last)
            if below is not None:
                last = np.where(np.isnan(below[:, b]), last, below[:, b])
            out[:, b] = np.where(bit, passed, 1 - left - passed) + left * last
        return out

    def log10(self, code: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of the byte after its context; one half for each bit that nothing was learned of."""
        p = self.bits(code, below)
        return np.log10(np.where(np.isnan(p), 0.5, p)).sum(1)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and each count summed by them."""
    k, *values = (np.concatenate(x) for x in zip(*parts))
    if not len(k):
        return (k, *values)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return (k[first], *(np.add.reduceat(x[order], first) for x in values))


def _blocks(what: int, k: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Counts as a row for each part: its number, the bytes that a count takes, and of its keys, ``m`` and ``m - n`` first all lowest bytes, then the next."""
    part = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARTS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part = part[order]
    width = max(1, (int(m.max(initial=0)).bit_length() + 7) // 8)
    planes = [np.ascontiguousarray(x[order], "<i8").view(np.uint8).reshape(-1, 8)[:, :w].T for x, w in ((k, 8), (m, width), (m - n, width))]
    planes = np.concatenate(planes)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    rows = [planes[:, a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(part)))]
    number = part[first].astype(np.int32) + (what << PARTS)
    return pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(first), width, np.int32)), pa.array(rows, pa.binary())], names=["part", "width", "block"])


def _unpacked(blocks: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """Keys, n and m of blocks, given with their widths."""
    out, at = np.zeros((3, sum(len(b) // (8 + 2 * w) for w, b in blocks), 8), np.uint8), 0
    for w, b in blocks:
        x = np.frombuffer(b, np.uint8).reshape(8 + 2 * w, -1)
        end = at + x.shape[1]
        out[0, at:end], out[1, at:end, :w], out[2, at:end, :w] = x[:8].T, x[8 : 8 + w].T, x[8 + w :].T
        at = end
    k, m, less = out.view("<i8")[..., 0]
    return k, m - less, m


def gathered(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs``: text, learns. Written counts: what (0 word, 1 context with byte), key, n (in texts that are learned from), m (in all)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                data, offsets = utf8(b.column(0))
                learns = np.asarray(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
                h, _, _, rows = words(data, offsets, WORD)
                h, rows = np.append(h, np.full(len(learns), END)), np.append(rows, np.arange(len(learns)))
                u, n = np.unique(h[learns[rows]], return_counts=True)
                held[0].append((u.view(np.int64), n, n))
                code, begin = symbols(data, offsets, depth)
                seen = learns[np.repeat(np.arange(len(learns)), np.diff(np.append(begin, len(code))))]
                for part, times in ((code[seen], 1), (code[~seen], 0)):
                    u, n = np.unique(part, return_counts=True)
                    held[1].append((u, n * times, n))
                del code, seen, rows, h
                for what in (0, 1):
                    if sum(len(x[0]) for x in held[what]) > HELD:
                        held[what] = [_merged(held[what])]
                        if len(held[what][0][0]) > HELD // 2:
                            yield _blocks(what, *held[what].pop())
        for what in (0, 1):
            if held[what]:
                yield _blocks(what, *_merged(held[what]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted by part; whole parts are summed, about ``CHUNK`` counts at a time."""
        held: list[tuple[np.ndarray, ...]] = []
        blocks: list[tuple[int, bytes]] = []
        size, last = 0, -1

        def done() -> Iterator[pa.RecordBatch]:
            k, n, m = _merged([*held, _unpacked(blocks)])
            for a in range(0, len(k), 100_000):
                part = [x[a : a + 100_000] for x in (k, n, m)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), last >> PARTS, np.int32)), *map(pa.array, part)], names=["what", "key", "n", "m"])
            held.clear()
            blocks.clear()

        for batch in batches:
            for part, width, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != last and (size >= CHUNK or part >> PARTS != last >> PARTS):
                    if held or blocks:
                        yield from done()
                    size = 0
                elif size >= HELD:  # one part has many blocks: they are summed as they come
                    held[:] = [_merged([*held, _unpacked(blocks)])]
                    blocks.clear()
                    size = CHUNK
                blocks.append((width, block.as_buffer()))
                size += len(blocks[-1][1]) // (8 + 2 * width)
                last = part
        if held or blocks:
            yield from done()

    rows = docs.select("text", "learns").mapInArrow(count, "part int, width int, block binary")
    return written(rows.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "what int, key long, n long, m long"), "lm-counts")


def _top(df: DataFrame, most: int, count: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the most frequent rows, ``most`` of them at most, on the driver: those above a bound taken from a histogram of counts (an eighth of an octave a bin)."""
    level = F.floor(F.log2(F.col(count).cast("double")) * 8).cast("int")
    left, least = most, -1
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.level):
        if r.k > left:
            least = r.level
            break
        left -= r.k
    t = df.where(level > least).select("key", value).toArrow()
    k, v = (np.asarray(t.column(c).combine_chunks()) for c in ("key", value))
    return k, v


def fitted(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Written log probabilities of all gathered codes: key, m, value."""
    root = min(ROOT, depth)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by subtree; whole subtrees are weighed, about ``CHUNK`` codes at a time."""
        names = ["up", "key", "m", "n0", "n1", "weight", "bits"]
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float32())]

        def done(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            code, n, m = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(code)
            code, n, m = code[order], n[order], m[order]
            tree, every = Tree.asked(code, n, depth, root)
            up, size = tree.up, len(tree.up[0])
            del tree
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(size, bool)), pa.array(up[0]), pa.nulls(size, pa.int64()), *map(pa.array, up[1:]), pa.nulls(size, kinds[6])], names=names)
            for a in range(0, len(code), 50_000):
                part = code[a : a + 50_000]
                flat = pa.array(every[a : a + 50_000].astype(np.float32).ravel())
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(part) + 1, 8, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), bool)), pa.array(part), pa.array(m[a : a + 50_000]), *(pa.nulls(len(part), k) for k in kinds[3:6]), bits], names=names)

        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            code, n, m, tree = (b.column(c).to_numpy() for c in range(4))
            if sum(len(x[0]) for x in held) >= CHUNK:
                new = np.flatnonzero(tree != last)
                cut = new[0] if len(new) else len(tree)
                held.append((code[:cut], n[:cut], m[:cut]))
                if cut < len(tree):
                    yield from done(held)
                    held = [(code[cut:], n[cut:], m[cut:])]
            else:
                held.append((code, n, m))
            last = tree[-1]
        if held:
            yield from done(held)

    codes = counts.where("what = 1").select("key", "n", "m", F.shiftright("key", 8).bitwiseAND((1 << 8 * root) - 1).alias("tree"))
    weighed = codes.repartition("tree").sortWithinPartitions("tree").mapInArrow(weigh, "up boolean, key long, m long, n0 double, n1 double, weight double, bits array<float>")
    weighed = written(weighed, "lm-subtrees")
    top = weighed.where("up").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weight")]).orderBy("key").toArrow()
    keys, n0, n1, weight = (np.asarray(top.column(c).combine_chunks()) for c in ("key", "n0", "n1", "weight"))
    shared = counts.sparkSession.sparkContext.broadcast(Tree((keys, n0, n1), root - 1, 0, weight))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                below = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8).astype(float)
                value = shared.value.log10(b.column(0).to_numpy(), below)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(value)], names=["key", "m", "value"])

    return written(weighed.where("NOT up").select("key", "m", "bits").mapInArrow(finish, "key long, m long, value double"), "lm-values")


class Known:
    """Values by code, in order of a hash; an edge for each slot of hashes says where its codes lie."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        slot = self._slot(keys)
        order = np.argsort(slot)
        self.keys, self.values = keys[order], values[order]
        self.edge = np.searchsorted(slot[order], np.arange(SLOTS + 1)).astype(np.int32)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the keys, and which are really there."""
        slot = self._slot(code)
        at, end = self.edge[slot], self.edge[slot + 1]
        there = np.zeros(len(code), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            ok = self.keys[at[todo]] == code[todo]
            there[todo[ok]] = True
            todo = todo[~ok]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return at, there


def _lists(keys: np.ndarray, rows: np.ndarray, n: int, width: int | None = None) -> tuple[pa.Array, pa.Array]:
    """Per row its distinct keys and how often it has each. Rows ascend. Keys of ``width`` bits are sorted together with their rows, as one number."""
    if width is None:
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
    else:
        step = 1 << (63 - width)
        edges = np.unique(np.searchsorted(rows, np.arange(0, n + step, step)))
        both = ((rows % step) << width) | keys
        for a, b in zip(edges[:-1], edges[1:]):
            both[a:b].sort()
        keys, rows = both & ((1 << width) - 1), rows // step * step + (both >> width)
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
    edge = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=n))]).astype(np.int32))
    times = np.diff(np.append(new, len(keys)))
    return pa.ListArray.from_arrays(edge, pa.array(keys[new].astype(np.int64))), pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int64)))


def scores(
    docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, frequent_codes: int = FREQUENT_CODES
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), bits_per_byte.

    ``depth`` is 1 to 6. ``frequent`` and ``frequent_codes`` only say which counts are broadcast and which are joined.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    counts = gathered(docs.select(F.col(text_col).alias("text"), learns.alias("learns")), depth)
    tokens = counts.where("what = 0").select("key", "n")
    n_all, n_kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    values = fitted(counts, depth)
    keys, often = _top(tokens, frequent, "n", "n")
    keys = keys.view(np.uint64) if len(keys) else np.zeros(0, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((Known(keys, often), Known(*_top(values, frequent_codes, "m", "value"))))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known_codes = shared.value
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                data, offsets = utf8(b.column(1))
                n = len(offsets) - 1
                code, begin = symbols(data, offsets, depth)
                at, hit = known_codes.find(code)
                value = np.zeros(len(code))
                value[hit] = known_codes.values[at[hit]]
                total = np.add.reduceat(value, begin)
                miss = np.flatnonzero(~hit)
                codes, code_times = _lists(code[miss], np.searchsorted(begin, miss, "right") - 1, n, 8 * (depth + 1))
                del code, at, hit, value, miss  # before the arrays of the words
                h, _, _, rows = words(data, offsets, WORD)
                h, rows = np.append(h, np.full(n, END)), np.append(rows, np.arange(n))
                at, hit = known_words.find(h)
                part = np.bincount(rows[hit], weights=np.log10(known_words.values[at[hit]] + 1.0), minlength=n).astype(float)
                known = np.bincount(rows[hit], minlength=n)
                rare, times = _lists(h[~hit], rows[~hit], n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(part), pa.array(total), pa.array(np.diff(offsets).astype(np.int64)), rare, times, codes, code_times],
                    names=["doc_id", "n_tokens", "known", "part", "score", "n_bytes", "rare", "times", "codes", "code_times"],
                )

    schema = f"doc_id {kind}, n_tokens long, known long, part double, score double, n_bytes long, rare array<long>, times array<long>, codes array<long>, code_times array<long>"
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, schema)
    scored = written(scored.withColumn("uid", F.monotonically_increasing_id()), "lm-scored")

    def asked(what: int, keys: str, times: str) -> DataFrame:
        pair = F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times")))
        return scored.where(F.size(keys) > 0).select("uid", pair.alias("x")).select("uid", F.lit(what).alias("what"), "x.*")

    each = asked(0, "rare", "times").unionAll(asked(1, "codes", "code_times"))
    values = values.select(F.lit(1).alias("what"), "key", "value")
    joined = each.join(tokens.select(F.lit(0).alias("what"), "key", F.log10(F.col("n") + 1.0).alias("value")).unionAll(values), ["what", "key"])
    of = lambda what, x: F.sum(F.when(F.col("what") == what, x))
    weighed = F.col("times") * F.col("value")
    found = joined.groupBy("uid").agg(of(0, F.col("times")).alias("more"), of(0, weighed).alias("rest"), of(1, weighed).alias("coded"))
    log_all = float(np.log10(n_all + 1.0 * (n_kinds + 1)))
    score_ = F.col("score") + F.coalesce("coded", F.lit(0.0))
    return scored.join(found, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        score_.alias("score"),
        (-score_ * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return df.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
