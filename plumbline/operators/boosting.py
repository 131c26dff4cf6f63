"""Gradient boosting by distributed histograms, and logistic models, many models in one pass.

Rows are one written table; each says which models it trains, checks and tests. A pass hands every task the trees so far.
Tasks sum gradients by model, node, feature and bin, Spark adds those up and finds each node's best cut by a window over
bins, and one row a node reaches the driver, which grows the trees. Gradients are whole numbers of fixed size, so that sums,
and with them the trees, don't depend on how rows are dealt. All models of all splits advance in the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import release, written

#: A gradient of one is this many; sums of 2^40 rows fit a long.
UNIT = 1 << 20
#: Most cuts of a feature, equal parts that an interval is cut into when a feature's values are counted, and rounds of that.
BINS, PARTS, REFINED = 64, 256, 12


@dataclass(frozen=True)
class Boosted:
    """A member of trees. growth "level" splits every node of a level down to depth; "leaf" splits the leaf that gains
    most until there are leaves. Rows and features are drawn for each tree by hashes of seed. With patience, a model stops
    when the log loss of its check rows hasn't fallen for that many trees, and keeps the trees of the least."""

    features: tuple[str, ...]
    growth: str = "level"
    rounds: int = 20
    rate: float = 0.1
    depth: int = 3
    leaves: int = 8
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    least_rows: int = 20
    row_share: float = 1.0
    feature_share: float = 1.0
    patience: int = 0
    seed: int = 0


@dataclass(frozen=True)
class Logistic:
    """A logistic member: features standardised over the training rows, full-batch descent, l2 not divided by the rows."""

    features: tuple[str, ...]
    l2: float = 1.0
    rate: float = 0.5
    rounds: int = 30


@dataclass
class Tree:
    """Nodes in the order they were made: a node goes left where its feature's bin is at most cut; feature -1 is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for value in (left, right):
            for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.depth, self.depth[node] + 1)):
                column.append(x)
        return a, a + 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins (rows x features)."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        for _ in range(max(self.depth)):
            f = feature[at]
            below = bins[np.arange(len(bins)), np.maximum(f, 0)] <= cut[at]
            at = np.where(f < 0, at, np.where(below, left[at], right[at]))
        return at


@dataclass
class Fitted:
    """A fitted model: cuts of all features of the table, start and trees over bins, or weights (bias first) over
    standardised features."""

    member: Boosted | Logistic
    cuts: list[np.ndarray]
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray, columns: list[int], bins: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of rows (values of all features, and their bins if they are known; columns: those of the member)."""
        if self.weights is not None:
            return self.weights[0] + ((np.nan_to_num(x[:, columns]) - self.mean) / self.scale) @ self.weights[1:]
        bins = binned(x, self.cuts) if bins is None else bins
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += np.array(tree.value)[tree.nodes_of(bins)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def feature_cuts(df: DataFrame, features: list[str], by: str | None = None, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """For every group of by (0 without by) and feature ascending cuts, bins - 1 at most, that part the group's values into
    about equal numbers of rows.

    Values are counted in PARTS equal intervals; those that hold more rows than a quarter of a bin are cut again, REFINED
    times at most. Counts are exact, so the cuts don't depend on how rows are dealt; what reaches the driver is bounded."""
    rows = df.select((F.col(by) if by else F.lit(0)).cast("int").alias("g"), *features)
    ends = rows.groupBy("g").agg(*(f(x).alias(f"{k}{i}") for i, x in enumerate(features) for k, f in (("a", F.min), ("b", F.max), ("n", F.count)))).collect()
    known: dict[tuple[int, int], dict] = {}  # of every group and feature: edges of its intervals, and the rows of each
    for r in ends:
        for i in range(len(features)):
            a, b = r[f"a{i}"], r[f"b{i}"]
            wide = a is not None and b > a
            known[r["g"], i] = {"edges": np.unique(np.linspace(a, b, PARTS + 1)) if wide else np.zeros(0), "n": r[f"n{i}"]}
    for turn in range(REFINED):
        edges = {k: v["edges"] for k, v in known.items() if len(v["edges"]) > 1}

        def run(batches: Iterator[pa.RecordBatch], edges=edges) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [[], [], [], []]
                g = b.column(0).to_numpy()
                for group in np.unique(g):
                    mine = b.filter(pa.array(g == group))
                    for j in range(len(features)):
                        if (e := edges.get((int(group), j))) is None:
                            continue
                        x = mine.column(1 + j).drop_null().to_numpy(zero_copy_only=False)
                        at, n = np.unique(np.searchsorted(e, x, "left"), return_counts=True)
                        for c, v in zip(out, (np.full(len(at), group), np.full(len(at), j), at, n), strict=True):
                            c.append(v)
                columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(pa.int64()) for c in out]
                yield pa.RecordBatch.from_arrays(columns, ["g", "j", "at", "n"])

        for k in known.values():
            k["counts"] = np.zeros(len(k["edges"]) + 1, np.int64)  # counts[i]: values above edge i - 1, up to edge i
        for r in rows.mapInArrow(run, "g long, j long, at long, n long").groupBy("g", "j", "at").agg(F.sum("n").alias("n")).collect():
            known[r["g"], r["j"]]["counts"][r["at"]] = r["n"]
        again = False
        for k in known.values():
            e, counts = k["edges"], k["counts"]
            if len(e) < 2 or turn + 1 == REFINED:
                continue
            more = [np.linspace(e[i - 1], e[i], PARTS // 8 + 1) for i in range(1, len(e)) if counts[i] > k["n"] / (4 * bins) and np.nextafter(e[i - 1], e[i]) < e[i]]
            if more:
                # intervals without rows needn't be kept apart
                keep = np.concatenate(([True], (counts[1:-2] > 0) | (counts[2:-1] > 0), [True]))
                k["finer"], again = np.unique(np.concatenate([e[keep], *more])), True
        if not again:
            break
        for k in known.values():
            k["edges"] = k.pop("finer", k["edges"])
    return {g: [_chosen(known[g, i], bins) for i in range(len(features))] for g in sorted({g for g, _ in known})}


def _chosen(known: dict, bins: int) -> np.ndarray:
    e, counts = known["edges"], known["counts"]
    if len(e) < 2:
        return np.zeros(0)
    upto, step, cuts, last = 0, known["n"] / bins, [], 0
    for i, c in enumerate(counts[:-1]):
        upto += int(c)
        if upto - last >= step and upto < known["n"] and c:
            cuts.append(float(e[i]))
            last = upto
    return np.array(cuts[: bins - 1])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of values (rows x features): 0 for a missing one, else 1 and the number of cuts below it."""
    out = np.zeros(x.shape, np.int16)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(c, np.where(np.isnan(x[:, j]), 0.0, x[:, j]), "left"))
    return out


def prepared(rows: DataFrame, features: list[str], roles: DataFrame, weight: str | None = None) -> DataFrame:
    """A written table of id, key, y, w, x, train, check, test: rows (id, y, features and weight) with the splits of roles
    (split, id, role: train, check or test) that they have each role in. key is a hash of the id."""
    lists = roles.groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("split").cast("int")))).alias(r) for r in ("train", "check", "test")))
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features)).alias("x")
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")
    return written(rows.select("id", F.xxhash64("id").alias("key"), F.col("y").cast("double").alias("y"), w, x).join(lists, "id"), "rows")


def _draw(key: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to 1 by key and seed."""
    h = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


@dataclass
class _Growth:
    """A model that is being fitted, and what the next pass is to sum for it."""

    split: int
    name: str
    fitted: Fitted
    columns: list[int]
    tree: Tree | None = None
    pending: list[int] = field(default_factory=list)
    open_: dict = field(default_factory=dict)  # leaf growth: node to its best cut
    used: list[int] = field(default_factory=list)  # features of this tree
    turn: int = 0
    done: bool = False

    def begin(self) -> None:
        m = self.fitted.member
        self.tree, self.pending, self.open_ = Tree(), [0], {}
        self.used = list(self.columns)
        if m.feature_share < 1:
            n = max(1, math.ceil(m.feature_share * len(self.columns)))
            self.used = sorted(np.random.default_rng((m.seed, self.turn)).permutation(self.columns)[:n].tolist())

    def grow(self, cuts: dict[int, dict]) -> None:
        """Takes the best cut of every pending node (None without one)."""
        m, t = self.fitted.member, self.tree
        if self.pending == [0] and 0 in cuts:
            t.value[0] = leaf_value(cuts[0]["g"], cuts[0]["h"], m)
        if m.growth == "level":
            after = []
            for node in self.pending:
                c = cuts.get(node)
                if c and c["feature"] is not None and t.depth[node] < m.depth:
                    after += self._apply(node, c)
            self.pending = [n for n in after if t.depth[n] < m.depth]
        else:
            self.open_.update({n: cuts[n] for n in self.pending if n in cuts and cuts[n]["feature"] is not None})
            self.pending = []
            leaves = (len(t.feature) + 1) // 2
            if self.open_ and leaves < m.leaves:
                best = max(self.open_, key=lambda n: (self.open_[n]["gain"], -n))
                self.pending = self._apply(best, self.open_.pop(best))
                if leaves + 1 >= m.leaves:
                    self.pending = []
        if not self.pending:
            self.fitted.trees.append(t)
            self.turn += 1
            self.tree = None
            if self.turn >= m.rounds and not m.patience:
                self.done = True
            elif self.turn < m.rounds:
                self.begin()

    def _apply(self, node: int, c: dict) -> list[int]:
        m = self.fitted.member
        left, right = leaf_value(c["gl"], c["hl"], m), leaf_value(c["g"] - c["gl"], c["h"] - c["hl"], m)
        return list(self.tree.split(node, c["feature"], c["cut"], left, right))

    def judge(self, loss: float) -> None:
        """Takes the check rows' loss with the trees so far."""
        m, f = self.fitted.member, self.fitted
        if len(f.losses) < len(f.trees) + 1:
            f.losses.append(loss)
        best = int(np.argmin(f.losses))
        if len(f.losses) - 1 - best >= m.patience or self.turn >= m.rounds:
            self.done = True
            f.trees = f.trees[:best]


def leaf_value(g: float, h: float, m: Boosted) -> float:
    """The Newton step of a leaf with these sums (in units), shrunk by l1 and l2, times the rate."""
    g, h = g / UNIT, h / UNIT
    return -m.rate * math.copysign(max(abs(g) - m.l1, 0.0), g) / (h + m.l2) if h + m.l2 > 0 else 0.0


_SUMS = "model int, node int, feature int, bin int, g long, h long, n long, d double"


def _pass(rows: DataFrame, models: list[_Growth], width: int) -> DataFrame:
    """model, node, feature, bin, g, h, n, d: sums of every model's pending nodes. Node -1 has the loss (d) and weight (h) of
    the check rows; node -2 a logistic model's gradients (d) by feature (-1: the bias)."""
    wide = BINS + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key, y, w = (b.column(i).to_numpy() for i in range(3))
            x = _matrix(b.column(3), np.float64, width)
            sides, known = {}, {}
            for name, column in (("train", b.column(4)), ("check", b.column(5))):
                length = np.asarray(column.value_lengths())
                sides[name] = np.repeat(np.arange(n), length), column.flatten().to_numpy(zero_copy_only=False)

            def side(name: str, m: _Growth, sides=sides, known=known, x=x) -> tuple[np.ndarray, np.ndarray]:
                """Rows that a model's split has in a role, and their bins."""
                if (name, m.split) not in known:
                    row, split = sides[name]
                    mine = row[split == m.split]
                    known[name, m.split] = mine, binned(x[mine], m.fitted.cuts)
                return known[name, m.split]

            out: list[tuple] = []
            for k, m in enumerate(models):
                mine, bins = side("train", m)
                member = m.fitted.member
                if isinstance(member, Logistic):
                    if len(mine):
                        err = w[mine] * (sigmoid(m.fitted.score(x[mine], m.columns)) - y[mine])
                        z = (np.nan_to_num(x[mine][:, m.columns]) - m.fitted.mean) / m.fitted.scale
                        d = np.concatenate(([err.sum()], err @ z))
                        out.append((k, -2, np.arange(-1, len(m.columns)), 0, 0, 0, len(mine), d))
                    continue
                if member.patience:
                    seen, those = side("check", m)
                    if len(seen):
                        p = np.clip(sigmoid(m.fitted.score(x[seen], m.columns, those)), 1e-15, 1 - 1e-15)
                        loss = -(w[seen] * (y[seen] * np.log(p) + (1 - y[seen]) * np.log1p(-p))).sum()
                        out.append((k, -1, np.array([0]), 0, 0, round(float(w[seen].sum()) * UNIT), len(seen), np.array([loss])))
                if m.tree is None or not len(mine):
                    continue
                if member.row_share < 1:
                    drawn = _draw(key[mine], member.seed * 1_000_003 + m.turn) < member.row_share
                    mine, bins = mine[drawn], bins[drawn]
                node = m.tree.nodes_of(bins)
                slot = np.full(len(m.tree.feature), -1)
                slot[m.pending] = np.arange(len(m.pending))
                at = slot[node]
                mine, bins, at = mine[at >= 0], bins[at >= 0], at[at >= 0]
                if not len(mine):
                    continue
                p = sigmoid(m.fitted.score(x[mine], m.columns, bins))
                g, h = np.rint(w[mine] * (p - y[mine]) * UNIT), np.rint(w[mine] * p * (1 - p) * UNIT)
                used = np.array(m.used)
                cell = (at[:, None] * len(used) + np.arange(len(used))) * wide + bins[:, used]
                size = len(m.pending) * len(used) * wide
                count = np.bincount(cell.ravel(), minlength=size)
                full = np.flatnonzero(count)
                each = [np.bincount(cell.ravel(), np.repeat(v, len(used)), size)[full].astype(np.int64) for v in (g, h)]
                out.append((k, np.array(m.pending)[full // (len(used) * wide)], used[full // wide % len(used)], full % wide, *each, count[full], 0.0))
            parts = []
            for r in out:
                size = max(np.size(v) for v in r)
                parts.append([np.broadcast_to(v, size) for v in r])
            if parts:
                kinds = [np.int32] * 4 + [np.int64] * 3 + [np.float64]
                columns = [pa.array(np.concatenate([p[i] for p in parts]).astype(t)) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["model", "node", "feature", "bin", "g", "h", "n", "d"])

    part = rows.select("key", "y", "w", "x", "train", "check").mapInArrow(run, _SUMS)
    return part.groupBy("model", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n", "d")))


def _best_cuts(sums: DataFrame, models: list[_Growth]) -> DataFrame:
    """A row for each model and node: g, h, n, and feature, cut, gain, gl, hl of the cut that gains most (ties to the first
    feature, then the lowest cut), missing if none is allowed; for other nodes the sums of d as an array."""
    members = [g.fitted.member for g in models]
    limit = lambda name, kind: F.get(F.array(*(F.lit(kind(getattr(m, name, 0))) for m in members)), F.col("model"))
    held = {"l1": limit("l1", float), "l2": limit("l2", float), "least_gain": limit("least_gain", float), "least_rows": limit("least_rows", int)}
    w = Window.partitionBy("model", "node", "feature")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    trees = sums.withColumns(held).withColumns({f"{c}l": F.sum(c).over(upto) for c in "ghn"} | {f"{c}t": F.sum(c).over(w) for c in "ghn"})

    def worth(g: Column, h: Column) -> Column:
        g = F.greatest(F.abs(g / float(UNIT)) - F.col("l1"), F.lit(0.0))
        return F.try_divide(g * g, h / float(UNIT) + F.col("l2"))

    gr, hr, nr = (F.col(f"{c}t") - F.col(f"{c}l") for c in "ghn")
    gain = worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("gt"), F.col("ht"))
    rows = (F.col("nl") >= F.col("least_rows")) & (nr >= F.col("least_rows")) & (nr > 0)
    allowed = (F.col("node") >= 0) & rows & (gain > F.col("least_gain")) & (gain > 1e-12)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl")
    other = F.collect_list(F.when(F.col("node") < 0, F.struct("feature", "d")))
    best = trees.groupBy("model", "node").agg(*(F.first(f"{c}t").alias(c) for c in "ghn"), F.max(F.when(allowed, cut)).alias("c"), F.array_sort(other).alias("d"))
    return best.select("model", "node", "g", "h", "n", (-F.col("c.f")).alias("feature"), (-F.col("c.b")).alias("cut"), "c.gain", "c.gl", "c.hl", F.transform("d", lambda v: v["d"]).alias("d"))


def fit(rows: DataFrame, features: list[str], members: dict[str, Boosted | Logistic]) -> dict[tuple[int, str], Fitted]:
    """The fitted model of every split and member. rows: prepared(), features: those of its x.

    A pass is one job for all models. Features are cut into bins by a split's training rows. Missing values go left in trees
    and count as 0 in logistic models. A split without training rows has a model that gives one half."""
    at = {f: j for j, f in enumerate(features)}
    used = rows.select(F.explode("train").alias("split"), "y", "w", "x")
    x = [F.nanvl(F.get("x", F.lit(j)), F.lit(0.0)) for j in range(len(features))]
    stats = used.groupBy("split").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"),
        *(f(c).alias(f"{k}{j}") for j, c in enumerate(x) for k, f in (("m", F.avg), ("s", F.stddev_pop))),
    ).collect()  # fmt: skip  a row a split
    tests = rows.select(F.explode(F.array_union(F.coalesce("test", F.array().cast("array<int>")), "train")).alias("split")).distinct().collect()  # a row a split
    known, models = {r["split"]: r for r in stats}, []
    named = [f"f{j}" for j in range(len(features))]
    values = [F.when(~F.isnan(F.get("x", F.lit(j))), F.get("x", F.lit(j))).alias(f) for j, f in enumerate(named)]
    trees = any(isinstance(m, Boosted) for m in members.values())
    cuts = feature_cuts(used.select("split", *values), named, "split") if trees else {}
    for split in sorted({r["split"] for r in tests}):
        for name, member in members.items():
            own = Fitted(member, cuts.get(split, [np.zeros(0)] * len(features)))
            columns = [at[f] for f in member.features]
            g = _Growth(split, name, own, columns)
            models.append(g)
            r = known.get(split)
            if isinstance(member, Logistic):
                own.weights = np.zeros(len(columns) + 1)
                own.mean = np.array([r[f"m{j}"] if r else 0.0 for j in columns])
                own.scale = np.array([(r[f"s{j}"] if r else 0.0) or 1.0 for j in columns])
                g.done = r is None or member.rounds < 1
            elif r is None or member.rounds < 1:
                g.done = True
            else:
                share = min(max(r["wy"] / r["w"], 1e-6), 1 - 1e-6) if r["w"] else 0.5
                own.start = math.log(share / (1 - share))
                g.begin()
    while active := [m for m in models if not m.done]:
        found: dict[int, dict[int, dict]] = {}
        for r in _best_cuts(_pass(rows, active, len(features)), active).collect():  # a row for each model and pending node
            found.setdefault(r["model"], {})[r["node"]] = r.asDict()
        for k, m in enumerate(active):
            own = found.get(k, {})
            if isinstance(m.fitted.member, Logistic):
                member, f = m.fitted.member, m.fitted
                gradient = np.array(own[-2]["d"])
                gradient[1:] += member.l2 * f.weights[1:]
                f.weights = f.weights - member.rate * gradient / own[-2]["n"]
                m.turn += 1
                m.done = m.turn >= member.rounds
                continue
            # the check rows were judged by the trees before this pass
            if m.fitted.member.patience and (m.tree is None or m.pending == [0]):
                check = own.get(-1)
                if check and check["h"]:
                    m.judge(check["d"][0] / (check["h"] / UNIT))
                elif m.tree is None:
                    m.done = True
            if not m.done and m.tree is not None:
                m.grow({n: c for n, c in own.items() if n >= 0})
    return {(m.split, m.name): m.fitted for m in models}


def scores(rows: DataFrame, features: list[str], fitted: dict[tuple[int, str], Fitted], roles: tuple[str, ...] = ("test",)) -> DataFrame:
    """split, id, role, y, and a probability column for every member, of every row in the splits that it has one of roles in."""
    names = list(dict.fromkeys(n for _, n in fitted))
    at = {f: j for j, f in enumerate(features)}
    width = len(features)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), np.float64, width)
            for i, role in enumerate(roles):
                lists = b.column(3 + i)
                row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
                split = lists.flatten().to_numpy(zero_copy_only=False)
                for s in np.unique(split):
                    mine = row[split == s]
                    p = [sigmoid(fitted[s, n].score(x[mine], [at[f] for f in fitted[s, n].member.features])) for n in names]
                    head = [pa.array(np.full(len(mine), s, np.int32)), b.column(0).take(pa.array(mine)), pa.array([role] * len(mine), pa.string()), b.column(1).take(pa.array(mine))]
                    yield pa.RecordBatch.from_arrays([*head, *(pa.array(v) for v in p)], ["split", "id", "role", "y", *names])

    return rows.select("id", "y", "x", *roles).mapInArrow(run, f"split int, id {kind}, role string, y double, " + ", ".join(f"`{n}` double" for n in names))


def members_by_split(rows: DataFrame, roles: DataFrame, members: dict[str, Boosted | Logistic], weight: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """split, id, role, y and a probability column for every member, of the rows that a split of roles (split, id, role)
    tests, by models fitted on the rows that it trains; also: other roles to score. rows: id, y, the members' features and
    weight. A written table."""
    features = list(dict.fromkeys(f for m in members.values() for f in m.features))
    ready = prepared(rows, features, roles, weight)
    out = written(scores(ready, features, fit(ready, features, members), ("test", *also)), "scores")
    release(ready)
    return out
