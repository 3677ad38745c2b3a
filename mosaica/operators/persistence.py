"""Persistence diagrams of tiles (sublevel sets; pixels are the top cells) and distances between diagrams."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.functions import optics
from mosaica.operators.tiling import OWN, bilinear, by_size, by_stains, by_strips, ready, resize


#: Pixels that are worked on together: several small tiles, or one large one.
TOGETHER = 1 << 18
#: Places that one numpy step takes at a time where it makes several numbers of each.
PART = 1 << 17


def _merges(rank: np.ndarray, steps: list[int], outside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end): for each component that ends when places come in order of `rank`, the flat place where it began and the one that joined it to an older one.

    rank: (tiles, h + 2, w + 2), a strict order of the places inside each tile; its frame comes first if `outside` and
    never otherwise. `steps`: the neighbours on one side, as steps in the flat array; the others are their negatives.

    Each place belongs to the basin that its lowest neighbour leads to, so only the lowest pass between two basins can join
    them; passes are few, and they are taken in order.
    """
    tiles, h, w = rank.shape
    size, flat, never = rank.size, rank.ravel(), np.iinfo(rank.dtype).max
    index = np.int32 if size <= np.iinfo(np.int32).max else np.int64
    m = w + 1  # the longest step; what is taken of the frame on the way is put right or left out
    low, best = np.zeros(size - 2 * m, index), flat[m : size - m].copy()
    for d in [*steps, *(-d for d in steps)]:
        r = flat[m + d : size - m + d]
        np.copyto(low, d, where=r < best)
        np.minimum(best, r, out=best)
    to = np.arange(size, dtype=index)
    to[m : size - m] += low
    del low, best
    frame = np.ones((h, w), bool)
    frame[1:-1, 1:-1] = False
    at = (np.arange(tiles)[:, None] * (h * w) + np.flatnonzero(frame)).ravel()
    to[at] = at // (h * w) * (h * w) if outside else at
    parts = [slice(i, i + PART) for i in range(0, size, PART)]
    moved = True
    while moved:
        moved = False
        for x in parts:
            further = to[to[x]]
            moved = moved or bool((further != to[x]).any())
            to[x] = further
    basins = np.concatenate([x.start + np.flatnonzero(to[x] == np.arange(x.start, min(x.stop, size))) for x in parts])
    number = np.zeros(size, index)
    number[basins] = np.arange(len(basins))
    for x in parts:
        to[x] = number[to[x]]
    del number
    # of the passes between two basins the lowest, part by part, as basins are small, and then of all
    key, late = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = []
    for lo in range(m, size - m, PART):
        hi = min(lo + PART, size - m)
        found = []
        for d in steps:
            x, y = flat[lo:hi], flat[lo + d : hi + d]
            p, q = to[lo:hi], to[lo + d : hi + d]
            some = np.flatnonzero((p != q) & (x >= 0) & (x < never) & (y < never))
            p, q = p[some].astype(np.int64), q[some]
            found.append((np.minimum(p, q) * len(basins) + np.maximum(p, q), lo + some + np.where(x[some] > y[some], 0, d)))
        held.append(_lowest(*map(np.concatenate, zip(*found, strict=True)), flat))
    if held:
        key, late = held[0] if len(held) == 1 else _lowest(*map(np.concatenate, zip(*held, strict=True)), flat)
    del held, to
    order = np.argsort(flat[late], kind="stable")  # tiles share no basins, so their order among each other is of no account
    root, age = range(len(basins)), flat[basins].astype(np.int64)
    root, age = (list(root), age.tolist()) if len(basins) <= PART else (array("q", root), array("q", age.tobytes()))  # lists are faster, and larger
    start, end = array("q"), array("q")
    for at in range(0, len(order), PART):
        some = order[at : at + PART]
        one, two = np.divmod(key[some], max(1, len(basins)))
        for i, j, k in zip(one.tolist(), two.tolist(), late[some].tolist(), strict=True):
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                if age[i] < age[j]:
                    i, j = j, i
                root[i] = j
                start.append(i)
                end.append(k)
    return basins[np.array(start, np.int64)], np.array(end, np.int64)


def _lowest(key: np.ndarray, late: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the place of lowest rank among its own."""
    order = np.lexsort((flat[late], key))
    key, late = key[order], late[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key[first], late[first]


def diagrams_of(fields: np.ndarray) -> dict[str, np.ndarray]:
    """Finite pairs of fields (tiles, h, w) as columns tile, dim, birth, death, birth_y, birth_x, death_y, death_x; none has length zero."""
    tiles, h, w = fields.shape
    if tiles * h * w > TOGETHER and tiles > 1:
        n = max(1, TOGETHER // (h * w))
        parts = [(at, diagrams_of(fields[at : at + n])) for at in range(0, tiles, n)]
        return {k: np.concatenate([p[k] + at if k == "tile" else p[k] for at, p in parts]) for k in parts[0][1]}
    order = np.argsort(fields.reshape(tiles, -1), axis=1, kind="stable")
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(h * w, dtype=np.int32), order.shape), 1)
    place = place.reshape(fields.shape)
    del order
    wide, found = w + 2, []
    # holes: components of what lies above, with the outside at infinity there from the start
    for dim, steps in ((0, [1, wide - 1, wide, wide + 1]), (1, [1, wide])):
        framed = np.full((tiles, h + 2, wide), -1 if dim else np.iinfo(np.int32).max, np.int32)
        framed[:, 1:-1, 1:-1] = h * w - 1 - place if dim else place
        start, end = _merges(framed, steps, bool(dim))
        tile, at = np.divmod(start, (h + 2) * wide)
        (y0, x0), (y1, x1) = (np.divmod(p % ((h + 2) * wide), wide) for p in (start, end))
        y0, x0, y1, x1 = (v - 1 for v in (y0, x0, y1, x1))
        if dim:
            y0, x0, y1, x1 = y1, x1, y0, x0
        birth, death = fields[tile, y0, x0], fields[tile, y1, x1]
        some = birth != death
        found.append([tile[some].astype(np.int32), np.full(some.sum(), dim, np.int8), birth[some], death[some], *(v[some].astype(np.int32) for v in (y0, x0, y1, x1))])
        del framed, start, end, tile, at, y0, x0, y1, x1, birth, death
    names = ("tile", "dim", "birth", "death", "birth_y", "birth_x", "death_y", "death_x")
    return {n: np.concatenate([f.pop(0) for f in found]) for n in names}


def diagram(field: np.ndarray) -> list[tuple]:
    """Finite pairs (dim, birth, death, birth y, x, death y, x) of one field."""
    got = diagrams_of(np.asarray(field, float)[None])
    return list(zip(*(got[k].tolist() for k in got if k != "tile"), strict=True))


VALUES = [f"{n}{k}" for k in (0, 1) for n in ("birth", "death")]
PLACES = [f"{n}_{c}{k}" for k in (0, 1) for n in ("birth", "death") for c in "yx"]


#: What is compared of a diagram, as sorted lists of each dimension.
SORTED = [f"{n}{k}" for k in (0, 1) for n in ("birth", "death", "lifetime")]


def packed_type(places: bool = False, ordered: bool = False) -> tuple[str, pa.DataType]:
    """The type of a packed diagram, for Spark and for Arrow: lists of births and deaths of each dimension and, with `places`, of the pixels that give them; SORTED instead if `ordered`."""
    values, places = (SORTED, []) if ordered else (VALUES, PLACES if places else [])
    spark = ", ".join([*(f"{n}: array<double>" for n in values), *(f"{n}: array<int>" for n in places)])
    return f"struct<{spark}>", pa.struct([*((n, pa.list_(pa.float64())) for n in values), *((n, pa.list_(pa.int32())) for n in places)])


def tile_diagrams(
    tiles: DataFrame,
    specs: dict[str, list[str]],
    downsamples: list[int],
    name: str = "diagrams",
    domain: str = "domain",
    combine: str = "sum",
    vectors: dict | None = None,
    decimals: int | None = None,
    own: bool = False,
    size: int = 0,
    invert: bool = True,
    places: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """tiles (domain, h, w, rgb binary, and more) with an array of (spec, downsample, d): a diagram for each field of the tile's domain and each downsampling.

    Fields are inverted (strong stains come first) unless `invert` is false; `decimals` rounds them; `vectors` are each domain's stains, and with `own` a tile's columns stain1
    and stain2 are its stains of these names (null: none). `size` makes tiles squares of that side first. Then colours are pooled and the field is
    taken, which drops what is left at the right and bottom. With `places` the pixels (of the pooled field) that give each birth and death are
    kept; with `ordered` a diagram is the sorted lists that sweep.sorted_projections() makes. One pass from the bytes to the points, tile by tile: nothing is shuffled, and no pixel becomes a row. A tile of a domain without specs gets an empty array.
    """
    kind, arrow = packed_type(places, ordered)
    arrow = pa.list_(pa.struct([("spec", pa.string()), ("downsample", pa.int32()), ("d", arrow)]))

    def points(domains: pa.Array, h: pa.Array, w: pa.Array, rgb: pa.Array, first: list, second: list) -> pa.Array:
        out: list[list] = [[] for _ in range(len(rgb))]
        who = np.array(domains.to_pylist(), object)
        for rows, images in by_size(h, w, rgb):
            images = images if not size or images.shape[1:3] == (size, size) else resize(images, size, bilinear)
            parts = list(by_stains(rows, first, second)) if own else [(np.arange(len(rows)), {})]
            for k in downsamples:
                for part, stains in parts:
                    for d, names in specs.items():
                        at = part[who[rows[part]] == d]
                        for spec in dict.fromkeys(names) if len(at) else ():
                            held = (vectors or {}).get(d, {}) | stains
                            f = by_strips(images[at], k, lambda x: optics.field_array(spec, x, combine, held))  # noqa: B023
                            f = -f if invert else f
                            f = f if decimals is None else np.round(f, decimals)
                            for row, found in zip(rows[at], _by_tile(diagrams_of(f), len(at), places), strict=True):
                                out[row].append({"spec": spec, "downsample": k, "d": _ordered(found) if ordered else found})
        return pa.array(out, arrow)

    def alike(domains: pa.Array, h: pa.Array, w: pa.Array, rgb: pa.Array) -> pa.Array:
        return points(domains, h, w, rgb, [], [])

    def each(domains: pa.Array, h: pa.Array, w: pa.Array, rgb: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return points(domains, h, w, rgb, first.to_pylist(), second.to_pylist())

    ready(tiles.sparkSession)
    made = F.arrow_udf(each if own else alike, f"array<struct<spec: string, downsample: int, d: {kind}>>").asNondeterministic()
    return tiles.withColumn(name, made(*map(F.col, [domain, "h", "w", "rgb", *(OWN if own else [])])))


def _by_tile(found: dict[str, np.ndarray], tiles: int, places: bool = False) -> list[dict]:
    """The points of each tile as lists, by dimension."""
    out: list[dict] = [{} for _ in range(tiles)]
    for dim in (0, 1):
        some = found["dim"] == dim
        order = np.argsort(found["tile"][some], kind="stable")
        at = np.searchsorted(found["tile"][some][order], np.arange(tiles + 1))
        for n in ("birth", "death", *(("birth_y", "birth_x", "death_y", "death_x") if places else ())):
            values = found[n][some][order]
            for t in range(tiles):
                out[t][f"{n}{dim}"] = values[at[t] : at[t + 1]]
    return out


def _ordered(d: dict) -> dict:
    """SORTED of a packed diagram."""
    return {f"{n}{k}": np.sort(d[f"death{k}"] - d[f"birth{k}"] if n == "lifetime" else d[f"{n}{k}"]) for k in (0, 1) for n in ("birth", "death", "lifetime")}


def diagram_rows(tiles: DataFrame, keys: list[str], name: str = "diagrams", places: bool = False) -> DataFrame:
    """The points of tile_diagrams() as rows: keys, spec, downsample, dim, birth, death and, with `places`, birth_y, birth_x, death_y, death_x."""
    each = tiles.select(*keys, F.explode(name).alias("x")).select(*keys, "x.spec", "x.downsample", F.col("x.d").alias("d"))
    names = ["birth", "death", *(["birth_y", "birth_x", "death_y", "death_x"] if places else [])]
    point = lambda k: F.transform(F.arrays_zip(*[F.col(f"d.{n}{k}").alias(n) for n in names]), lambda p: F.struct(F.lit(k).alias("dim"), *[p[n].alias(n) for n in names]))
    rows = each.select(*keys, "spec", "downsample", F.explode(F.concat(point(0), point(1))).alias("p"))
    return rows.select(*keys, "spec", "downsample", "p.dim", *[f"p.{n}" for n in names])


def projected(kind: str | dict[int, str], dim: int) -> Column:
    """birth, death or lifetime of the points, or one of them for each dimension; auto is the lifetime of components and the birth of holes."""
    kind = kind.get(dim, "auto") if isinstance(kind, dict) else kind
    kind = {"auto": "lifetime" if dim == 0 else "birth"}.get(kind, kind)
    return {"birth": F.col("birth"), "death": F.col("death"), "lifetime": F.col("death") - F.col("birth")}[kind]


def projected_lists(d: Column, projection: str | dict[int, str], dim: int) -> Column:
    """The projected values of one dimension of a diagram as tile_diagrams() makes it; `projection` may name one for each dimension."""
    kind = projection.get(dim, "auto") if isinstance(projection, dict) else projection
    kind = {"auto": "lifetime" if dim == 0 else "birth"}.get(kind, kind)
    if kind not in ("birth", "death", "lifetime"):
        raise ValueError(f"no projection {kind!r}")
    return F.zip_with(d[f"death{dim}"], d[f"birth{dim}"], lambda x, y: x - y) if kind == "lifetime" else d[f"{kind}{dim}"]


def packed(points: DataFrame, keys: list[str], projection: str | dict[int, str] = "auto", dims: tuple[int, ...] = (0, 1)) -> DataFrame:
    """One row for each diagram: p0 and p1, the projected values of each dimension."""
    return points.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("dim") == d, projected(projection, d))).alias(f"p{d}") for d in dims])


def set_distance(a: Column, b: Column) -> Column:
    """The shorter list is padded with zeros, then both are sorted and absolute differences added; 0 for two empty lists."""
    pad = lambda x, y: F.array_sort(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.size(y) - F.size(x)))))
    return F.aggregate(F.zip_with(pad(a, b), pad(b, a), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(left: str, right: str, dims: tuple[int, ...] = (0, 1)) -> Column:
    """Distance of two packed diagrams (struct columns): the sum over dimensions."""
    return sum((set_distance(F.col(f"{left}.p{d}"), F.col(f"{right}.p{d}")) for d in dims), F.lit(0.0))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost (shortest augmenting paths); the longer side has some left over."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        best, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            slack = np.where(used[1:], np.inf, cost[i0 - 1] - u[i0] - v[1:])
            better = slack < best[1:]
            best[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.where(used[1:], np.inf, best[1:]).argmin()) + 1
            step = best[j1]
            u[owner[used]] += step
            v[used] -= step
            best[1:][~used[1:]] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])
