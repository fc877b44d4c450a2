"""Selection, scaling and gradient boosted trees in numpy: what one fit does within one task.

A fit takes a matrix (rows, columns) and labels 0 or 1. It keeps the columns with the best
univariate AUC, scales them, and boosts trees on histograms of at most BINS bins a column by second
order gains of the logistic loss. Trees grow in one of three shapes: by `level`, by the best `leaf`
first, or `even`, with one split for all nodes of a level. With held-out rows the boosting ends when
their AUC has not risen for `patience` trees, and the model is cut at its best.

Params: shape, trees, rate, depth, leaves, child_weight (least sum of second derivatives), child_rows,
least_gain, l1, l2, rows (share of rows a tree sees), temperature (of Bayesian row weights, in place of
that share), tree_columns, level_columns, node_columns (shares of columns), random_cuts (one random cut
a column and node), noise (of a split's gain), positive_weight. What is missing has no effect.

A null or NaN value counts as the least of its column. One class gives a constant prediction.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np
import xxhash

BINS, TINY = 64, 1e-12


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Rank form with mean ranks on ties; 1/2 for one class."""
    order = np.argsort(score)
    s, one = np.asarray(score)[order], (np.asarray(y) == 1)[order]
    n1 = float(one.sum())
    n0 = len(s) - n1
    if not (n1 and n0):
        return 0.5
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])
    ends = np.r_[first[1:], len(s)]
    ranks = (ends + first + 1) / 2  # the mean of first + 1 .. ends; sums of halves are exact
    return float(((ranks * np.add.reduceat(one.astype(np.int64), first)).sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def folds_of(ids: np.ndarray, y: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """The fold of each row: its rank by hash within its label, modulo folds. The same as learning.with_folds gives."""
    own = np.int32(seed).tobytes()
    hashes = np.array([xxhash.xxh64_intdigest(own, xxhash.xxh64_intdigest(np.int64(i).tobytes(), 42)) for i in ids], np.uint64).view(np.int64)
    out = np.zeros(len(ids), np.int64)
    for label in np.unique(y):
        at = np.flatnonzero(y == label)
        out[at[np.lexsort((ids[at], hashes[at]))]] = np.arange(len(at)) % folds
    return out


@dataclass
class Steps:
    """The columns that are kept, and their centre and spread."""

    kept: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.kept] - self.centre) / self.spread


def fit_steps(x: np.ndarray, y: np.ndarray, names: list[str], top: int | None, least_auc: float, plain: tuple[str, ...], always: tuple[str, ...] = ()) -> Steps:
    """Those always kept, then the best columns by |AUC - 1/2| over finite values, ties by name; population z-scores, but for names with a plain word. All columns if top is None."""
    kept = list(range(len(names)))
    if top is not None:
        scored = []
        for i, name in enumerate(names):
            ok = np.isfinite(x[:, i])
            if name not in always:
                scored.append((-round(abs(auc(y[ok], x[ok, i]) - 0.5), 12), name, i))
        kept = [names.index(a) for a in always] + [i for s, _, i in sorted(scored)[:top] if -s >= least_auc - 0.5]
        kept = kept or [i for _, _, i in sorted(scored)[:1]]
    own = np.where(np.isfinite(x[:, kept]), x[:, kept], np.nan)
    scaled = np.array([not any(w in names[i].lower() for w in plain) for i in kept])
    if not len(own):
        return Steps(np.array(kept, int), np.zeros(len(kept)), np.ones(len(kept)))
    own[:, np.isnan(own).all(0)] = 0.0
    centre, spread = np.nanmean(own, 0), np.nanstd(own, 0)
    return Steps(np.array(kept, int), np.where(scaled, centre, 0.0), np.where(scaled & (spread > 0), spread, 1.0))


def edges_of(column: np.ndarray) -> np.ndarray:
    """Cuts between bins: between all values if they are few, else at even shares of the rows."""
    values = np.unique(column[np.isfinite(column)])
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column[np.isfinite(column)], np.arange(1, BINS) / BINS))


def _clean(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), -np.inf, x)


@dataclass
class Trees:
    """Heaps of nodes, (trees, nodes): the split's column (-1 at leaves), its threshold and the node's value; a row above the threshold goes right."""

    start: float
    column: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        x, rows = _clean(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for column, threshold, value in zip(self.column, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while ((split := column[at]) >= 0).any():
                at = np.where(split >= 0, 2 * at + 1 + (x[rows, split] > threshold[at]), at)
            total += value[at]
        return total


@dataclass
class Model:
    names: list[str]
    params: dict
    steps: Steps
    trees: Trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of the columns names."""
        return 1 / (1 + np.exp(-self.trees.margin(self.steps.transform(x))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        head = json.dumps({"names": self.names, "params": self.params, "start": self.trees.start}, sort_keys=True)
        np.savez_compressed(out, head=np.array(head), kept=self.steps.kept, centre=self.steps.centre, spread=self.steps.spread, column=self.trees.column, threshold=self.trees.threshold, value=self.trees.value)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        found = np.load(io.BytesIO(data), allow_pickle=False)
        head = json.loads(str(found["head"]))
        return Model(head["names"], head["params"], Steps(found["kept"], found["centre"], found["spread"]), Trees(head["start"], found["column"], found["threshold"], found["value"]))


class _Grower:
    """Grows trees on binned columns. Rows beyond `train` only follow the splits."""

    def __init__(self, bins: np.ndarray, n_bins: int, train: int, params: dict, rng: np.random.Generator):
        self.bins, self.n_bins, self.train, self.p, self.rng = bins, n_bins, train, params, rng
        self.depth = int(params["depth"])

    def _histograms(self, slots: np.ndarray, n_slots: int, columns: np.ndarray) -> np.ndarray:
        """Sums of gradient, second derivative and rows by (slot, column, bin); slot -1 is left out.

        Column by column, so that what one step touches stays in the processor's cache. Rows are not
        counted where no rule asks for them: a least weight above 0 leaves no empty side.
        """
        first, g, h = slots[self.rows] * self.n_bins, self.own_g, self.own_h
        some = None
        if len(first) and first.min() < 0:
            some = np.flatnonzero(first >= 0)
            first, g, h = first[some], g[some], h[some]
        counted = self.p.get("child_rows", 1) > 1 or not self.p.get("child_weight", 0.0) > 0 or self.p.get("random_cuts")
        out = np.ones((3, n_slots, len(columns), self.n_bins))
        for i, c in enumerate(np.searchsorted(self.columns, columns)):
            cell = first + (self.own_bins[c] if some is None else self.own_bins[c].take(some))
            for k, w in enumerate((g, h, None)[: 3 if counted else 2]):
                out[k, :, i] = np.bincount(cell, w, n_slots * self.n_bins).reshape(n_slots, self.n_bins)
        return out

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        shrunk = np.maximum(np.abs(g) - self.p.get("l1", 0.0), 0.0)
        return shrunk * shrunk / (h + self.p.get("l2", 0.0) + TINY)

    def _value(self, g: float, h: float) -> float:
        return -self.p["rate"] * float(np.sign(g) * max(abs(g) - self.p.get("l1", 0.0), 0.0) / (h + self.p.get("l2", 0.0) + TINY))

    def _gains(self, hist: np.ndarray) -> np.ndarray:
        """Gain of the cut behind each bin, by (slot, column, bin); minus infinity where it is not allowed."""
        left = hist.cumsum(3)
        whole = left[..., -1:]
        right = whole - left
        gain = 0.5 * (self._score(left[0], left[1]) + self._score(right[0], right[1]) - self._score(whole[0], whole[1])) - self.p.get("least_gain", 0.0)
        weight, rows = self.p.get("child_weight", 0.0), max(1, self.p.get("child_rows", 1))
        ok = np.minimum(left[1], right[1]) >= weight
        if rows > 1 or not weight > 0:
            ok &= np.minimum(left[2], right[2]) >= rows
        if self.p.get("random_cuts"):
            first, last = (hist[2] > 0).argmax(2), self.n_bins - 1 - (hist[2, ..., ::-1] > 0).argmax(2)
            cut = first + (self.rng.random(first.shape) * np.maximum(last - first, 1)).astype(int)
            ok &= np.arange(self.n_bins) == cut[..., None]
        if (noise := self.p.get("noise", 0.0)) > 0:
            gain = gain + noise * float(np.std(self.g[: self.train])) * self.rng.normal(size=gain.shape)
        return np.where(ok, gain, -np.inf)

    def _some(self, columns: np.ndarray, share: float) -> np.ndarray:
        n = max(1, round(share * len(columns)))
        return columns if n == len(columns) else np.sort(self.rng.choice(columns, n, replace=False))

    def _best(self, hist: np.ndarray) -> list[tuple[float, int, int]]:
        """Gain, place of the column and cut for each slot."""
        gains = self._gains(hist)
        if (share := self.p.get("node_columns", 1.0)) < 1:
            for k in range(len(gains)):
                out = np.setdiff1d(np.arange(gains.shape[1]), self._some(np.arange(gains.shape[1]), share))
                gains[k, out] = -np.inf
        flat = gains.reshape(len(gains), -1)
        at = flat.argmax(1)
        return [(float(flat[k, i]), int(i) // self.n_bins, int(i) % self.n_bins) for k, i in enumerate(at)]

    def _split(self, node: int, column: int, cut: int) -> None:
        self.column[node], self.cut[node] = column, cut
        rows = np.flatnonzero(self.at == node)
        self.at[rows] = 2 * node + 1 + (self.bins[column, rows] > cut)

    def grow(self, g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """column, cut and value of each node, and where each row ends."""
        self.g, self.h, self.weight = g * weight, h * weight, weight
        nodes = 2 ** (self.depth + 1) - 1
        self.column, self.cut = np.full(nodes, -1, np.int16), np.zeros(nodes, np.int16)
        self.at = np.zeros(self.bins.shape[1], np.int64)
        columns = self.columns = self._some(np.arange(len(self.bins)), self.p.get("tree_columns", 1.0))
        # What the tree sees, together in memory.
        self.rows = np.flatnonzero(weight > 0)
        self.own_g, self.own_h, self.own_bins = self.g[self.rows], self.h[self.rows], [self.bins[c].take(self.rows) for c in columns]
        (self._by_leaf if self.p["shape"] == "leaf" else self._by_level)(columns)
        ends = self.at[: self.train]
        sums = [np.bincount(ends, w[: self.train], nodes) for w in (self.g, self.h)]
        value = np.array([self._value(a, b) if b > 0 else 0.0 for a, b in zip(*sums, strict=True)])
        return self.column, self.cut, value, self.at

    def _by_level(self, columns: np.ndarray) -> None:
        for level in range(self.depth):
            first = 2**level - 1
            live = np.unique(self.at[: self.train][self.at[: self.train] >= first])
            if not len(live):
                return
            slot_of = np.full(2 ** (self.depth + 1) - 1, -1)
            slot_of[live] = np.arange(len(live))
            own = self._some(columns, self.p.get("level_columns", 1.0))
            hist = self._histograms(slot_of[self.at], len(live), own)
            if self.p["shape"] == "even":
                gains = self._gains(hist)
                together = np.where(np.isfinite(gains).any(0), np.where(np.isfinite(gains), gains, 0.0).sum(0), -np.inf)
                i = int(together.argmax())
                if not together.flat[i] > 0:
                    return
                for node in live:
                    self._split(int(node), int(own[i // self.n_bins]), i % self.n_bins)
            else:
                for node, (gain, place, cut) in zip(live, self._best(hist), strict=True):
                    if gain > 0:
                        self._split(int(node), int(own[place]), cut)

    def _by_leaf(self, columns: np.ndarray) -> None:
        waiting: list[tuple[float, int, int, int]] = []
        known: dict[int, np.ndarray] = {}

        def sums(node: int) -> np.ndarray:
            return self._histograms(np.where(self.at == node, 0, -1), 1, columns)

        def look(nodes: list[int], parent: int | None = None) -> None:
            nodes = [n for n in nodes if n < 2**self.depth - 1]
            if not nodes:
                return
            if parent is None:
                known[nodes[0]] = sums(nodes[0])
            else:  # of two halves only the smaller is added up; the other is what is left of their parent
                small, large = sorted(nodes, key=lambda n: int((self.at[self.rows] == n).sum()))
                whole = known.pop(parent)
                known[small] = sums(small)
                known[large] = whole - known[small]
                np.maximum(known[large][1], 0.0, out=known[large][1])
            for node, (gain, place, cut) in zip(nodes, self._best(np.concatenate([known[n] for n in nodes], 1)), strict=True):
                if gain > 0:
                    waiting.append((gain, node, int(columns[place]), cut))

        look([0])
        leaves = 1
        while waiting and leaves < self.p.get("leaves", 1 << 30):
            best = max(waiting)
            waiting.remove(best)
            _, node, column, cut = best
            self._split(node, column, cut)
            leaves += 1
            look([2 * node + 1, 2 * node + 2], node)


def binned(x: np.ndarray, held: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The cuts of each column of x, and the bins (column, row) of x and, behind them, of held."""
    x = _clean(x)
    both = x if held is None else np.concatenate([x, _clean(held)])
    edges = [edges_of(c) for c in x.T]
    return edges, np.array([np.searchsorted(e, c, "left") for e, c in zip(edges, both.T, strict=True)], np.uint8).reshape(len(edges), len(both))


def boost(x: np.ndarray, y: np.ndarray, params: dict, seed: int, held: tuple[np.ndarray, np.ndarray] | None = None, patience: int | None = None, bins: tuple[list[np.ndarray], np.ndarray] | None = None) -> tuple[Trees, list[float]]:
    """Trees from rows x with labels y, and the AUC on the held rows after each tree. bins: what binned gives for these rows, if known."""
    rng = np.random.default_rng(seed)
    edges, bins = bins or binned(x, held and held[0])
    train = len(x)
    grower = _Grower(bins, max((len(e) for e in edges), default=0) + 1, train, params, rng)
    share = min(max(float(np.mean(y)) if train else 0.5, 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin, found, aucs, best = np.full(bins.shape[1], start), [], [], 0
    weight = np.where(y == 1, params.get("positive_weight", 1.0), 1.0)
    for i in range(int(params["trees"]) if train and 0 < y.sum() < train else 0):
        p = 1 / (1 + np.exp(-margin[:train]))
        own = weight.copy()
        if "temperature" in params:
            own = own * (-np.log(1 - rng.random(train))) ** params["temperature"]
        elif params.get("rows", 1.0) < 1:
            own = own * (rng.random(train) < params["rows"])
        column, cut, value, at = grower.grow(p - y, np.maximum(p * (1 - p), TINY), own)
        threshold = np.array([edges[c][k] if c >= 0 else 0.0 for c, k in zip(column, cut, strict=True)])
        found.append((column, threshold, value))
        margin += value[at]
        if held is not None:
            aucs.append(auc(held[1], margin[train:]))
            if aucs[-1] > aucs[best]:
                best = i
            elif patience and i - best >= patience:
                break
    if held is not None:
        found = found[: best + 1]
    nodes = 2 ** (int(params["depth"]) + 1) - 1
    stack = lambda k, kind: np.array([f[k] for f in found], kind).reshape(len(found), nodes)
    return Trees(start, stack(0, np.int16), stack(1, np.float64), stack(2, np.float64)), aucs


@dataclass
class Ready:
    """Rows of a fit with their columns selected, scaled and binned: the same for all parameters and seeds."""

    steps: Steps
    x: np.ndarray
    y: np.ndarray
    held: tuple[np.ndarray, np.ndarray] | None
    bins: tuple[list[np.ndarray], np.ndarray]


def ready(x: np.ndarray, y: np.ndarray, names: list[str], steps: dict, held: tuple[np.ndarray, np.ndarray] | None = None) -> Ready:
    """Select, scale and bin by what x and y alone say."""
    own = fit_steps(x, y, names, **steps)
    scaled, held = own.transform(x), held and (own.transform(held[0]), held[1])
    return Ready(own, scaled, y, held, binned(scaled, held and held[0]))


def fit_ready(rows: Ready, names: list[str], params: dict, seed: int, patience: int | None = None) -> Model:
    trees, _ = boost(rows.x, rows.y, params, seed, rows.held, patience, rows.bins)
    return Model(names, params, rows.steps, trees)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], params: dict, seed: int, steps: dict, held: tuple[np.ndarray, np.ndarray] | None = None, patience: int | None = None) -> Model:
    """Select, scale and boost; everything is learned from x and y alone, and held rows only say when to stop."""
    return fit_ready(ready(x, y, names, steps, held), names, params, seed, patience)


def n_trees(model: Model) -> int:
    return len(model.trees.column)


def sampled(base: dict, ranges: dict, rng: np.random.Generator) -> dict:
    """base with a draw from each range (low, high, logged); whole numbers where base has one."""
    out = dict(base)
    for k, (low, high, logged) in ranges.items():
        v = low * (high / low) ** rng.random() if logged else low + (high - low) * rng.random()
        out[k] = min(int(high), int(low + (high - low + 1) * rng.random())) if isinstance(base[k], int) else float(v)
    return out


def tuned(ids: np.ndarray, x: np.ndarray, y: np.ndarray, names: list[str], base: dict, ranges: dict, seed: int, trials: int, folds: int, stop: int, patience: int, steps: dict) -> tuple[dict, list[float]]:
    """The best of the defaults and seeded draws by AUC over the rows of the first `stop` inner folds; and all AUCs."""
    rng = np.random.default_rng(seed)
    tries = [base, *(sampled(base, ranges, rng) for _ in range(trials))]
    if not trials:
        return base, []
    at = folds_of(ids, y, folds, seed)
    seen, said = [], [[] for _ in tries]
    for k in range(stop):
        out = at == k
        rows = ready(x[~out], y[~out], names, steps, (x[out], y[out]))  # once for all tries
        seen.append(y[out])
        for params, own in zip(tries, said, strict=True):
            own.append(fit_ready(rows, names, params, seed, patience).predict(x[out]))
    results = [auc(np.concatenate(seen), np.concatenate(own)) for own in said]
    return tries[int(np.argmax(results))], results
