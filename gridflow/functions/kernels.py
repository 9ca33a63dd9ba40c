"""Small numeric kernels that run inside tasks on one batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TILE_CELLS = 2_000_000
#: Base rows, and query rows, whose distances are added up at a time, so that a block stays in the processor's cache.
BLOCK, BLOCK_HEIGHT = 2048, 32
#: Least base rows, and most neighbours, for which rough distances are made first, and least query rows for which tables are.
ROUGH_ROWS, ROUGH_MOST, FLOOR_ROWS = 2048, 64, 64
#: Pairs collected before they are measured exactly, and measured at a time.
PAIRS, FEW_PAIRS = 1 << 16, 1024


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """A list array as a float matrix; nulls become NaN."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def tag_numbers(q_tag: np.ndarray, b_tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tags of any type as numbers that are equal when the tags are; null equals nothing."""
    known: dict = {}
    b = np.array([-2 if t is None else known.setdefault(t, len(known)) for t in b_tag], dtype=np.int64)
    return np.array([-1 if t is None else known.get(t, -1) for t in q_tag], dtype=np.int64), b


def tiles(q: np.ndarray, b: np.ndarray, p: float, q_tag, b_tag):
    """Yield (slice of q, distances to all of b); equal tags give infinity.

    `p` is the Minkowski power; infinity takes the largest gap. "angle" is half the squared
    distance, which for unit vectors is one minus their cosine, and "canberra" the sum of the
    gaps over the sums of magnitudes. The tile height follows the width, so memory stays flat.
    """
    if q_tag is not None:
        q_tag, b_tag = tag_numbers(q_tag, b_tag)
    step = max(1, TILE_CELLS // max(1, len(b)))
    columns = np.ascontiguousarray(b.T)
    for start in range(0, len(q), step):
        part = slice(start, min(start + step, len(q)))
        d = np.zeros((part.stop - start, len(b)))
        for at in range(0, len(b), BLOCK):
            add_gaps(d[:, at : at + BLOCK], q[part], columns[:, at : at + BLOCK], p)
        if p == 2:
            np.sqrt(d, out=d)
        elif p == "angle":
            d *= 0.5
        elif p not in (1, np.inf, "canberra"):
            np.power(d, 1.0 / p, out=d)
        if q_tag is not None:
            d[q_tag[part, None] == b_tag[None, :]] = np.inf
        yield part, d


def add_gaps(d: np.ndarray, q: np.ndarray, columns: np.ndarray, p) -> None:
    """Add to `d` the gaps between rows of `q` and the base rows whose features are `columns`, feature by feature."""
    gap = np.empty(d.shape, d.dtype)
    whole, sizes = (np.empty(d.shape, d.dtype), np.abs(columns)) if p == "canberra" else (None, None)
    for f in range(q.shape[1]):
        np.subtract(q[:, f, None], columns[f][None, :], out=gap)
        if p in (2, "angle"):
            np.multiply(gap, gap, out=gap)
        else:
            np.abs(gap, out=gap)
            if p == np.inf:
                np.maximum(d, gap, out=d)
                continue
            if p == "canberra":
                np.add(np.abs(q[:, f, None]), sizes[f][None, :], out=whole)
                if not (sizes[f].all() and q[:, f].all()):
                    whole[whole == 0] = 1.0
                np.divide(gap, whole, out=gap)
            elif p != 1:
                np.power(gap, p, out=gap)
        np.add(d, gap, out=d)


def of_pairs(q: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray, p) -> np.ndarray:
    """The distances of `tiles` for the pairs (row, column) only, added up in the same order."""
    out = np.zeros(len(row))
    for at in range(0, len(row), FEW_PAIRS):
        x, y, d = q[row[at : at + FEW_PAIRS]], b[column[at : at + FEW_PAIRS]], out[at : at + FEW_PAIRS]
        gap = x - y
        if p in (2, "angle"):
            np.multiply(gap, gap, out=gap)
        elif p == "canberra":
            gap = share(gap, x, y)
        else:
            np.abs(gap, out=gap)
        for values in np.ascontiguousarray(gap.T):
            if p == np.inf:
                np.maximum(d, values, out=d)
            else:
                np.add(d, values, out=d)
        if p == 2:
            np.sqrt(d, out=d)
        elif p == "angle":
            d *= 0.5
    return out


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true places of a matrix, in order; eight places are looked at together."""
    flat = mask.ravel()
    whole = flat[: len(flat) // 8 * 8].reshape(-1, 8)
    words = np.flatnonzero(whole.view(np.uint64))
    word, place = np.nonzero(whole[words])
    rest = len(whole) * 8 + np.flatnonzero(flat[len(whole) * 8 :])
    return np.divmod(np.concatenate([words[word] * 8 + place, rest]), mask.shape[1])


class Rough:
    """Distances to the rows `b`, on a scale that keeps their order, and how far they can be off.

    Squared distances are one matrix product; city block, largest gap and Canberra are added up
    in blocks. Whoever reads a table measures again, by `of_pairs`, each pair that the error leaves open.
    """

    #: Base rows and query rows of a table, which stays in the processor's cache.
    wide, high = 2048, 256

    def __init__(self, b: np.ndarray, p, kind):
        self.p, self.kind, self.rows, self.width = p, kind, len(b), b.shape[1]
        self.eps = float(np.finfo(kind).eps)
        self.centre, self.scale = np.zeros(self.width), 1.0
        if p != "canberra":
            with np.errstate(over="ignore", invalid="ignore"):
                self.centre = b.mean(axis=0)
                size = float(np.abs(b - self.centre).max())
            # a power of two, so that scaling adds no error
            self.scale = float(2.0 ** -np.ceil(np.log2(size))) if 1e-100 < size < 1e100 else 1.0
        x = self.scaled(b)
        self.usable = bool(self.fits(x).all())
        if not self.usable:
            return
        self.norm = float(self.length(x).max())
        if p in (2, "angle"):
            ones = np.ones((len(x), 1))
            x = np.concatenate([-2.0 * x, (x * x).sum(axis=1, keepdims=True), ones], axis=1)
        self.columns = np.ascontiguousarray(x.T.astype(kind))

    @staticmethod
    def serves(b: np.ndarray, p) -> bool:
        return len(b) >= ROUGH_ROWS and b.shape[1] > 0 and p in (1, 2, np.inf, "angle", "canberra")

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return (x - self.centre) * self.scale if self.p != "canberra" else x

    def fits(self, x: np.ndarray) -> np.ndarray:
        """Whether the error bounds hold for scaled rows: finite, and neither far off the base nor too small for a share."""
        size = np.abs(x)
        if self.p == "canberra":
            return ((size == 0) | ((size > 1e-30) & (size < 1e30))).all(axis=1)
        return (size < 1e6).all(axis=1)

    def length(self, x: np.ndarray) -> np.ndarray:
        if self.p in (2, "angle"):
            return np.sqrt((x * x).sum(axis=1))
        return np.abs(x).sum(axis=1) if self.p == 1 else np.abs(x).max(axis=1)

    def off(self, x: np.ndarray) -> np.ndarray:
        """Bound of the error of a scaled row's distances: of conversion, sums and products."""
        if self.p == "canberra":
            return np.full(len(x), self.eps * self.width * (self.width + 8))
        both = self.length(x) + self.norm
        return self.eps * (self.width + 10) * (both * both if self.p in (2, "angle") else both) + 1e-30

    def asked(self, x: np.ndarray) -> np.ndarray:
        """What `block` takes of scaled rows."""
        if self.p in (2, "angle"):
            x = np.concatenate([x, np.ones((len(x), 1)), (x * x).sum(axis=1, keepdims=True)], axis=1)
        return x.astype(self.kind)

    def block(self, at: int):
        """A function from asked rows to their distances to the base rows from `at` on, `wide` of them at most."""
        columns = self.columns[:, at : at + self.wide]
        if self.p in (2, "angle"):
            return lambda x: x @ columns

        def table(x: np.ndarray) -> np.ndarray:
            d = np.zeros((len(x), columns.shape[1]), self.kind)
            for top in range(0, len(x), BLOCK_HEIGHT):
                add_gaps(d[top : top + BLOCK_HEIGHT], x[top : top + BLOCK_HEIGHT], columns, self.p)
            return d

        return table

    def edge(self, distance: np.ndarray, off: np.ndarray) -> np.ndarray:
        """No pair within `distance` has more than this in a table; pairs set to `barred` always have."""
        with np.errstate(over="ignore", invalid="ignore"):
            value = distance * self.scale if self.p != "canberra" else distance
            value = value * value if self.p == 2 else 2 * value * self.scale if self.p == "angle" else value
            value = value * (1 + 4 * self.eps) + 2.5 * off
        return np.minimum(value, float(np.finfo(self.kind).max)).astype(self.kind)

    barred = np.inf


class Floors:
    """Lower bounds of city block and Canberra distances to the rows `b`, added up from tables of whole numbers.

    The values of a feature are cut into bins at quantiles. A base row's gap to the nearest point of a
    bin, in units and rounded down, is a number of a byte, and no larger than its gap to any value in the bin. So a
    query row's bound is a sum of table rows, one for the bin of each of its values. Whoever reads
    one measures again, by `of_pairs`, each pair that it leaves open.
    """

    wide, high = 2048, 128
    #: Bins of a feature, features whose sum fits into a byte, largest gap in units; rows that place bins and unit.
    bins, group, most, sample = 64, 4, 63, 4096
    #: Values farther from the middle, in units, count as so far; more than the error of single precision up to there.
    far, margin = 1e4, 2e-3
    barred = np.iinfo(np.uint16).max

    def __init__(self, b: np.ndarray, p):
        self.p = p
        self.usable = bool(self.fits(b).all())
        if not self.usable:
            return
        some = b[:: -(-len(b) // self.sample)]
        self.centre, reach = np.median(some, axis=0), 1.0
        if p == 1:
            # rare larger gaps count as the largest; any unit gives bounds that hold
            reach = float(np.quantile(np.abs(some - np.roll(some, len(some) // 2 + 1, axis=0)), 0.95))
        self.unit = reach / self.most if reach > 0 else 1.0
        self.b = self.scaled(b).astype(np.float32)
        self.edges = np.quantile(self.scaled(some), np.arange(1, self.bins) / self.bins, axis=0).T.astype(np.float32)

    @staticmethod
    def serves(q: np.ndarray, b: np.ndarray, p) -> bool:
        return p in (1, "canberra") and len(q) >= FLOOR_ROWS and 0 < b.shape[1] <= 1000

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.unit, -self.far, self.far) if self.p == 1 else x

    def fits(self, x: np.ndarray) -> np.ndarray:
        size = np.abs(x)
        if self.p == 1:
            return (size < 1e100).all(axis=1)
        return ((size == 0) | ((size > 1e-30) & (size < 1e30))).all(axis=1)

    def off(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x))

    def asked(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value."""
        return np.stack([np.searchsorted(edges.astype(np.float64), values) for edges, values in zip(self.edges, x.T)], axis=1)

    def block(self, at: int):
        values = np.ascontiguousarray(self.b[at : at + self.wide].T)
        n, half = values.shape[1], -(-values.shape[1] // 2)
        values = np.pad(values, ((0, 0), (0, 2 * half - n)), "edge")
        tables = np.empty((len(values), self.bins, values.shape[1]), np.uint8)
        gap, other = (np.empty(tables.shape[1:], np.float32) for _ in range(2))
        infinite = np.float32([np.inf])
        for table, v, inner in zip(tables, values, self.edges):
            low, high = np.concatenate([-infinite, inner])[:, None], np.concatenate([inner, infinite])[:, None]
            if self.p == 1:
                np.maximum(np.subtract(low, v, out=gap), np.subtract(v, high, out=other), out=gap)
                gap -= np.float32(self.margin)
            else:
                near = np.minimum(np.maximum(low, v, out=other), high, out=other)
                np.abs(np.subtract(near, v, out=gap), out=gap)
                np.add(np.abs(near, out=other), np.abs(v), out=other)
                other[other == 0] = 1.0
                np.divide(gap, other, out=gap)
                np.multiply(np.subtract(gap, np.float32(1e-6), out=gap), np.float32(self.most), out=gap)
            np.clip(gap, 0, self.most, out=gap)
            # a row of each half alternate, so that bytes are added up two by two
            table[:, ::2], table[:, 1::2] = gap[:, :half], gap[:, half:]

        def table(bins: np.ndarray) -> np.ndarray:
            total = np.zeros((len(bins), 2 * half), np.uint16)
            part, one = np.empty(total.shape, np.uint8), np.empty(total.shape, np.uint8)
            both = part.view("<u2")
            for f in range(len(tables)):
                first = f % self.group == 0
                np.take(tables[f], bins[:, f], axis=0, out=part if first else one, mode="clip")
                if not first:
                    np.add(part, one, out=part)
                if f % self.group == self.group - 1 or f == len(tables) - 1:
                    total[:, :half] += both & 0xFF
                    total[:, half:] += both >> 8
            return total[:, :n]

        return table

    def edge(self, distance: np.ndarray, off: np.ndarray) -> np.ndarray:
        """No pair within `distance` has more than this in a table."""
        return np.minimum(distance * ((1 + 1e-9) / self.unit), self.barred - 1).astype(np.uint16)


class Barred:
    """Positions of base rows whose tag is that of a query row."""

    def __init__(self, q_tag, b_tag):
        self.tags, self.base = tag_numbers(q_tag, b_tag)

    def block(self, at: int, wide: int) -> Barred:
        """From now on for tables of the base rows from `at` on."""
        b = self.base[at : at + wide]
        self.order = np.argsort(b, kind="stable")
        self.first, self.last = (np.searchsorted(b[self.order], self.tags, side=s) for s in ("left", "right"))
        return self

    def bar(self, d: np.ndarray, part: slice, barred) -> np.ndarray:
        """Set the distances of barred pairs to `barred`; how many each row has."""
        count = self.last[part] - self.first[part]
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        d[row, self.order[self.first[part][row] + place]] = barred
        return count

    def counts(self) -> np.ndarray:
        """How many base rows of the block are barred for each query row."""
        return self.last - self.first


def share(gap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|gap| over |a| + |b|; zero where both are zero."""
    whole = np.abs(a) + np.abs(b)
    return np.abs(gap) / np.where(whole == 0, 1.0, whole)


def directions(x: np.ndarray, centred: bool) -> np.ndarray:
    """Rows as unit vectors, of the row less its mean where asked; a last place is 1 for rows without a direction."""
    if centred:
        x = x - x.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.concatenate([x / np.where(size == 0, 1.0, size), size == 0], axis=1)


def nearest(q, b, k, p, q_tag=None, b_tag=None, within=None):
    """Positions and distances of the k nearest rows of b, nearest first.

    b has to be sorted by id: equal distances are then ordered by id. Missing
    neighbours have an infinite distance. With `within`, a distance for each row of q, base rows
    farther away need not be found.
    """
    k_used = min(k, len(b))
    position = np.zeros((len(q), k), dtype=np.int64)
    distance = np.full((len(q), k), np.inf)
    if k_used == 0 or not len(q):
        return position, distance
    if Rough.serves(b, p) and k <= ROUGH_MOST:
        rough = Floors(b, p) if Floors.serves(q, b, p) else Rough(b, p, np.float32)
        if rough.usable:
            x = rough.scaled(q)
            fits = rough.fits(x)
            _nearest_rough(rough, np.flatnonzero(fits), x, q, b, k, q_tag, b_tag, within, position, distance)
            rest = np.flatnonzero(~fits)
            if len(rest):
                position[rest], distance[rest] = _nearest_plain(q[rest], b, k, p, None if q_tag is None else q_tag[rest], b_tag)
            return position, distance
    return _nearest_plain(q, b, k, p, q_tag, b_tag)


def _nearest_rough(rough, rows, x, q, b, k, q_tag, b_tag, within, position, distance) -> None:
    """Fill in the neighbours of the given rows: rough distances name those that can be among the nearest.

    The base is read block by block. A row's k-th distance so far bounds what is measured in the next; at first that is the
    largest of the k that look nearest.
    """
    q, off, asked = q[rows], rough.off(x[rows]), rough.asked(x[rows])
    bound = np.full(len(rows), np.inf) if within is None else within[rows].astype(np.float64)
    barred = None if q_tag is None else Barred(q_tag[rows], b_tag)
    best, where = np.full((len(rows), k), np.inf), np.zeros((len(rows), k), np.int64)
    for at in range(0, len(b), rough.wide):
        table, found, held = rough.block(at), [], 0
        if barred is not None:
            barred.block(at, rough.wide)
        for top in range(0, len(rows), rough.high):
            part = slice(top, min(top + rough.high, len(rows)))
            d = table(asked[part])
            if barred is not None:
                barred.bar(d, part, rough.barred)
            free = np.flatnonzero(np.isinf(bound[part]))
            if len(free) and d.shape[1] >= k:
                some = d[free]
                column = np.argpartition(some, k - 1, axis=1)[:, :k]
                allowed = (np.take_along_axis(some, column, axis=1) < rough.barred).all(axis=1)
                free, column = top + free[allowed], at + column[allowed]
                bound[free] = of_pairs(q, b, np.repeat(free, k), column.ravel(), rough.p).reshape(-1, k).max(axis=1, initial=0.0)
            row, column = marked(d <= rough.edge(bound[part], off[part])[:, None])
            found.append((top + row, at + column))
            held += len(row)
            if held > PAIRS or part.stop == len(rows):
                row, column = (np.concatenate(c) for c in zip(*found))
                exact = of_pairs(q, b, row, column, rough.p)
                _keep_best(best, where, bound, row, column, exact)
                found, held = [], 0
    position[rows], distance[rows] = where, best


def _keep_best(best, where, bound, row, column, exact) -> None:
    """Take pairs into the k best of their rows, by distance, then column, and lower the rows' bounds."""
    k = best.shape[1]
    good = exact <= bound[row]
    row, column, exact = row[good], column[good], exact[good]
    some = np.unique(row)
    held = np.isfinite(best[some])
    row = np.concatenate([np.repeat(some, held.sum(axis=1)), row])
    column, exact = np.concatenate([where[some][held], column]), np.concatenate([best[some][held], exact])
    order = np.lexsort((column, exact, row))
    row, column, exact = row[order], column[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    best[some] = np.inf
    best[row[kept], rank[kept]], where[row[kept], rank[kept]] = exact[kept], column[kept]
    bound[some] = np.minimum(bound[some], best[some, -1])


def _nearest_plain(q, b, k, p, q_tag, b_tag):
    k_used = min(k, len(b))
    position = np.zeros((len(q), k), dtype=np.int64)
    distance = np.full((len(q), k), np.inf)
    for part, d in tiles(q, b, p, q_tag, b_tag):
        if k_used == 1:
            order = d.argmin(axis=1)[:, None]
        elif k_used == d.shape[1]:
            order = d.argsort(axis=1, kind="stable")
        else:
            order = np.sort(d.argpartition(k_used - 1, axis=1)[:, :k_used], axis=1)
            edge = np.take_along_axis(d, order, axis=1).max(axis=1)
            for i in np.flatnonzero((d <= edge[:, None]).sum(axis=1) > k_used):
                order[i] = np.sort(d[i].argsort(kind="stable")[:k_used])
            best = np.take_along_axis(d, order, axis=1).argsort(axis=1, kind="stable")
            order = np.take_along_axis(order, best, axis=1)
        position[part, :k_used] = order
        distance[part, :k_used] = np.take_along_axis(d, order, axis=1)
    return position, distance


#: What `summary` finds about the allowed base rows of a query row.
NEAR, TOTAL, POSITIVE, COUNT, WITHIN = range(5)


def summary(q, b, p, q_tag=None, b_tag=None, radius: float = -1.0, wanted=(NEAR, TOTAL, POSITIVE, WITHIN)) -> np.ndarray:
    """[what, row]: nearest distance, sum of distances, number of positive ones, of all, and of those below `radius`.

    Infinity without any base row. Only what is `wanted`, and the number of all, is sure to be found.
    """
    found = np.zeros((5, len(q)))
    sums, near = TOTAL in wanted or POSITIVE in wanted, NEAR in wanted
    rough = Rough(b, p, np.float64 if sums else np.float32) if p in (2, "angle") and Rough.serves(b, p) else None
    if rough is None or not rough.usable or not len(q):
        if near and Rough.serves(b, p) and not sums and WITHIN not in wanted:
            found[NEAR] = nearest(q, b, 1, p, q_tag, b_tag)[1][:, 0]
            found[COUNT] = len(b) - (Barred(q_tag, b_tag).block(0, len(b)).counts() if q_tag is not None else 0)
            return found
        return _summary_plain(found, q, b, p, q_tag, b_tag, radius)
    x = rough.scaled(q)
    fits = rough.fits(x)
    rows, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
    if len(rest):
        found[:, rest] = _summary_plain(found[:, rest], q[rest], b, p, None if q_tag is None else q_tag[rest], b_tag, radius)
    x, q, off = x[rows], q[rows], rough.off(x[rows])
    q_tag = None if q_tag is None else q_tag[rows]
    if near:
        found[NEAR, rows] = nearest(q, b, 1, p, q_tag, b_tag)[1][:, 0]
    asked, slack = rough.asked(x), 2.5 * off
    barred = None if q_tag is None else Barred(q_tag, b_tag)
    found[COUNT, rows] = len(b)
    found[POSITIVE, rows] = len(b)
    edge = (radius * rough.scale) ** 2 if p == 2 else 2 * radius * rough.scale**2
    wide = slack + 4 * rough.eps * edge
    for at in range(0, len(b), rough.wide):
        table = rough.block(at)
        if barred is not None:
            barred.block(at, rough.wide)
        for top in range(0, len(rows), rough.high):
            part = slice(top, min(top + rough.high, len(rows)))
            here, d = rows[part], table(asked[part])
            if barred is not None:
                gone = barred.bar(d, part, rough.barred)
                found[COUNT, here] -= gone
                found[POSITIVE, here] -= gone

            def open_pairs(low, high):
                """Rows and columns of the pairs between two bounds, and their exact distances."""
                kept = d <= high[part, None].astype(d.dtype)
                if low is not None:
                    kept &= d >= low[part, None].astype(d.dtype)
                row, column = marked(kept)
                kept = np.isfinite(d[row, column])
                row, column = row[kept], column[kept]
                return row, column, of_pairs(q[part], b, row, at + column, p) if len(row) else np.zeros(0)

            if WITHIN in wanted and radius > 0:
                row, _, exact = open_pairs(edge - wide, edge + wide)
                sure = np.count_nonzero(d < (edge - wide)[part, None].astype(d.dtype), axis=1)
                found[WITHIN, here] += sure + np.bincount(row[exact < radius], minlength=len(d))
            if sums:
                # a small difference of large squares says little: such pairs are measured again
                row, column, exact = open_pairs(None, 400.0 * slack)
                found[POSITIVE, here] -= np.bincount(row[exact == 0], minlength=len(d))
                if TOTAL in wanted:
                    if barred is not None:
                        d[~np.isfinite(d)] = 0.0
                    np.maximum(d, 0.0, out=d)
                    d[row, column] = 0.0
                    if p == 2:
                        np.sqrt(d, out=d)
                    total = d.sum(axis=1) * (1 / rough.scale if p == 2 else 0.5 / rough.scale**2)
                    found[TOTAL, here] += total + np.bincount(row, weights=exact, minlength=len(d))
    return found


def _summary_plain(found, q, b, p, q_tag, b_tag, radius) -> np.ndarray:
    for part, d in tiles(q, b, p, q_tag, b_tag):
        allowed = np.isfinite(d)
        found[NEAR, part] = d.min(axis=1, initial=np.inf)
        found[TOTAL, part] = np.where(allowed, d, 0.0).sum(axis=1)
        found[POSITIVE, part] = (allowed & (d > 0)).sum(axis=1)
        found[COUNT, part] = allowed.sum(axis=1)
        found[WITHIN, part] = (d < radius).sum(axis=1)
    return found


def neighbour_mean(distance: np.ndarray, y: np.ndarray, weights: str) -> np.ndarray:
    """Mean of the neighbours' values; `distance` weights let an exact hit take it all."""
    w = np.isfinite(distance).astype(np.float64)
    if weights == "distance":
        hit = (distance == 0).any(axis=1)
        with np.errstate(divide="ignore"):
            inverse = 1.0 / distance
        w = np.where(hit[:, None], distance == 0, inverse).astype(np.float64)
    total = w.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (w * y).sum(axis=1) / total


def ragged(values: np.ndarray, kept: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array holding, per row, the entries where `kept` is true."""
    offsets = np.concatenate([[0], kept.sum(axis=1).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[kept], type=kind))


def slices(rows: int, columns: int) -> list[slice]:
    """Slices of the rows whose matrices with that many columns stay small; one for no rows."""
    step = max(1, TILE_CELLS // max(1, columns))
    return [slice(a, min(a + step, rows)) for a in range(0, max(rows, 1), step)]


def box_gap(q: np.ndarray, low: np.ndarray, high: np.ndarray, p: float | str, far: bool) -> np.ndarray:
    """Distance of each row to the nearest (or, with `far`, the farthest) point of each box.

    Canberra's share of an axis rises on both sides of a row's value, so it is least at the
    nearest edge and largest at one of the edges, as the plain gap is.
    """
    total = np.zeros((len(q), len(low)))
    for f in range(q.shape[1]):
        x, bottom, top = q[:, f, None], low[None, :, f], high[None, :, f]
        if p == "canberra":
            ends = share(bottom - x, x, bottom), share(x - top, x, top)
            gap = np.maximum(*ends) if far else np.where(x < bottom, ends[0], np.where(x > top, ends[1], 0.0))
        elif far:
            gap = np.maximum(np.abs(bottom - x), np.abs(x - top))
        else:
            gap = np.maximum(np.maximum(bottom - x, x - top), 0.0)
        power = {"angle": 2.0, "canberra": 1.0}.get(p, p) if isinstance(p, str) else p
        total = np.maximum(total, gap) if p == np.inf else total + gap**power
    if p == "angle":
        return 0.5 * total
    return total if p in (np.inf, "canberra") else total ** (1.0 / p)


BAG_BLOCK = 1024


def block_draws(block: int, rows: int, draws: int, bags: int, seed: int) -> np.ndarray:
    """[bag, row]: how often each bag draws each row of a block of BAG_BLOCK rows.

    All `draws` of a bag fall on `rows` rows; a range's draws are split between its halves by
    a binomial number that depends on seed and range only, down to the block. So every block
    finds its own counts, and the counts of a bag add up to `draws`.
    """
    low, high = 0, -(-rows // BAG_BLOCK)
    left = np.full(bags, draws, np.int64)

    def numbers() -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFF, low << 32 | high]))

    while high - low > 1:
        middle = (low + high) // 2
        end = min(rows, high * BAG_BLOCK)
        first = numbers().binomial(left, (middle - low) * BAG_BLOCK / (end - low * BAG_BLOCK))
        if block < middle:
            left, high = first, middle
        else:
            left, low = left - first, middle
    size = min(rows, (block + 1) * BAG_BLOCK) - block * BAG_BLOCK
    return numbers().multinomial(left, np.full(size, 1.0 / size))


def bag_counts(index: np.ndarray, rows: int, draws: int, bags: int, seed: int) -> np.ndarray:
    """[row, bag]: draws of the rows with the given numbers out of `rows`."""
    out = np.zeros((len(index), bags), np.int32)
    block = index // BAG_BLOCK
    for b in np.unique(block).tolist():
        at = np.flatnonzero(block == b)
        out[at] = block_draws(b, rows, draws, bags, seed)[:, index[at] - b * BAG_BLOCK].T
    return out
