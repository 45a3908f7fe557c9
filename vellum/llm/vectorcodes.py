"""Vector code compression: each vector becomes a short code of nearest codebook entries, one for each part.

Components become integers, so distances, sums and means are exact and the result does not depend on how rows are
dealt. A vector is cut into consecutive parts, and each part position has a codebook. A round assigns every part to
the nearest entry of its codebook and replaces the entries by the means of their parts.

Assignment searches a vantage-point tree over the entries of a part position by branch and bound. Distances to the
vantage points are exact integers; their roots are rounded away from the side that would prune, a branch is entered
also where its bound equals the best distance (an entry of a lower index may tie), and what the bounds leave is
compared as integers. All parts of an Arrow batch go down a tree together.

A round is a map over rows that keeps one sum for each entry and task, then a sum by entry and place in Spark: what
is shuffled grows with tasks, not with rows, and no key is hot. The driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import free_name, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A node of a tree with no more entries than this compares them all.
LEAF = 6
#: Roots of integers below this are off by less than one part in 2**50.
ROOT_SLACK = 2.0**-48
#: The codebooks are broadcast; larger ones are refused.
MAX_BOOK_NUMBERS = 1 << 24


@dataclass(frozen=True)
class Codebooks:
    """entries[p]: the entries of part position p, one row each (int64); scale: what components are multiplied by."""

    entries: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    @property
    def sha256(self) -> str:
        """Digest of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part.tolist() for x in entry).encode()).hexdigest()


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts begin and end; if the width is no multiple of parts, the first ones are longer by one."""
    each, more = divmod(width, parts)
    return [p * each + min(p, more) for p in range(parts + 1)]


class Tree:
    """A vantage-point tree over the entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        #: (entry, inner child, largest distance inside, outer child, smallest distance outside) or an array of entries.
        self.nodes: list = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        if len(members) <= LEAF:
            self.nodes.append(members)
            return at
        self.nodes.append(None)
        vantage, rest = int(members[0]), members[1:]
        squares = _squares(self.entries[rest], self.entries[vantage])
        order = np.argsort(squares, kind="stable")
        half = len(rest) // 2
        inside, outside = order[:half], order[half:]
        self.nodes[at] = (
            vantage, self._grow(np.sort(rest[inside])), _root_up(squares[inside].max()),
            self._grow(np.sort(rest[outside])), _root_down(squares[outside].min()),
        )
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry, ties to the lower index, and the squared distance."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries), np.int64)
        if len(points) and self.nodes:
            # the nearer branches alone give a first bound; then all branches that the bound does not exclude
            self._visit(0, np.arange(len(points)), points, best, index, greedy=True)
            self._visit(0, np.arange(len(points)), points, best, index, greedy=False)
        return index, best

    def _compare(self, entry: int, rows: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        squares = _squares(points[rows], self.entries[entry])
        better = (squares < best[rows]) | ((squares == best[rows]) & (entry < index[rows]))
        won = rows[better]
        best[won], index[won] = squares[better], entry
        return squares

    def _visit(self, at: int, rows: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray, greedy: bool) -> None:
        """As deep as the tree, which halves at each level."""
        if not len(rows):
            return
        node = self.nodes[at]
        if isinstance(node, np.ndarray):
            for entry in node.tolist():
                self._compare(entry, rows, points, best, index)
            return
        vantage, inner, inside, outer, outside = node
        squares = self._compare(vantage, rows, points, best, index)
        if greedy:
            near = _root_up(squares) <= (inside + outside) / 2
            self._visit(inner, rows[near], points, best, index, True)
            self._visit(outer, rows[~near], points, best, index, True)
            return
        low, high = _root_down(squares), _root_up(squares)
        self._visit(inner, rows[low - inside <= _root_up(best[rows])], points, best, index, False)
        self._visit(outer, rows[outside - high <= _root_up(best[rows])], points, best, index, False)


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = points - entry
    return (apart * apart).sum(axis=1)


def _root_up(squares):
    return np.sqrt(np.asarray(squares, dtype=np.float64)) * (1 + ROOT_SLACK)


def _root_down(squares):
    return np.sqrt(np.asarray(squares, dtype=np.float64)) * (1 - ROOT_SLACK)


def kept(vectors: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, list | np.ndarray]:
    """Which rows are coded, and their integers: a matrix, or for any width a list of rows."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    if width is None:
        mask, rows = np.zeros(len(vectors), bool), []
        for n in np.unique(lengths[lengths >= 0]).tolist():
            good, matrix = kept(vectors, scale, n)
            mask |= good
            rows += zip(np.flatnonzero(good).tolist(), matrix)
        return mask, [r for _, r in sorted(rows, key=lambda x: x[0])]
    mask = lengths == width
    values = pc.fill_null(pc.cast(vectors.filter(pa.array(mask)).flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    values = values.reshape(int(mask.sum()), width)
    fine = np.isfinite(values).all(axis=1)
    matrix = np.floor(values[fine] * scale)
    if len(matrix) and width * 4 * max(float(matrix.max(initial=0)), -float(matrix.min(initial=0)), 1.0) ** 2 >= 2.0**62:
        raise ValueError(f"a component is too large: squared distances of {width} such integers do not fit 64 bits")
    mask[np.flatnonzero(mask)[~fine]] = False
    return mask, matrix.astype(np.int64)


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks that start as the parts of the first rows by key and are refined for some rounds over all rows.

    Component x counts as floor(scale * x). Rows whose vector is null or holds a null or non-finite number take no
    part, nor do those of another length than most (of equally common lengths the smallest). Null keys come last
    among the starting rows, equal keys by their integers; repeated rows count each. None if no row is left.
    Components whose squared distances would not fit 64 bits raise an error.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count and first rows of each width in a task."""
        count: dict[int, int] = {}
        held: dict[int, list] = {}
        for batch in batches:
            mask, found = kept(batch.column("v"), scale)
            ids = batch.column("id").filter(pa.array(mask)).to_pylist()
            by_width: dict[int, list] = {}
            for i, v in zip(ids, found):
                by_width.setdefault(len(v), []).append((i is None, i or 0, v))
            for n, more in by_width.items():
                count[n] = count.get(n, 0) + len(more)
                more = heapq.nsmallest(entries, more + held.get(n, []), key=lambda r: (r[0], r[1], r[2].tolist()))
                held[n] = more
        for n, found in held.items():
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([n] * len(found), pa.int32()), "n": pa.array([count[n]] + [0] * (len(found) - 1), pa.int64()),
                "id": pa.array([None if r[0] else r[1] for r in found], pa.int64()), "v": pa.array([r[2] for r in found], pa.list_(pa.int64())),
            })

    starts = written(rows.mapInArrow(first, "width int, n long, id long, v array<long>"))
    most = starts.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "width").first()
    if most is None:
        return None
    width = most["width"]
    if width * entries > MAX_BOOK_NUMBERS:
        raise ValueError(f"codebooks of {width * entries} numbers are not broadcast; at most {MAX_BOOK_NUMBERS}")
    found = starts.where(F.col("width") == width).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    cuts = bounds(width, parts)
    whole = np.array([r["v"] for r in found], np.int64).reshape(len(found), width)
    books = Codebooks([whole[:, a:b] for a, b in zip(cuts, cuts[1:])], scale)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Number and sum of a task's parts, for each entry that has some."""
            trees = [Tree(e) for e in shared.value.entries]
            count = [np.zeros(len(t.entries), np.int64) for t in trees]
            total = [np.zeros_like(t.entries) for t in trees]
            for batch in batches:
                _, matrix = kept(batch.column("v"), scale, width)
                for p, tree in enumerate(trees):
                    points = matrix[:, cuts[p] : cuts[p + 1]]
                    index, _ = tree.nearest(points)
                    count[p] += np.bincount(index, minlength=len(tree.entries))
                    np.add.at(total[p], index, points)
            for p in range(len(trees)):
                used = np.flatnonzero(count[p])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used.astype(np.int32)),
                    "n": pa.array(count[p][used]), "total": pa.array(list(total[p][used]), pa.list_(pa.int64())),
                })

        partial = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        places = partial.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x"))
        # as many rows as the codebooks have numbers
        means = places.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        renewed = [e.copy() for e in books.entries]
        for r in means:
            if r["place"] is not None:
                renewed[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
        books = Codebooks(renewed, scale)
    return books


def encode(df: DataFrame, books: Codebooks | None, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The rows that have a code, with it (array<int>: an entry's index for each part) and the squared distance.

    Rows that fit leaves out, and all rows without codebooks, go. Columns of the names code and error are replaced.
    """
    out = df.drop(*[c for c in df.columns if c.lower() in (code.lower(), error.lower())])
    if books is None:
        return out.where("false").withColumns({code: F.lit(None).cast("array<int>"), error: F.lit(None).cast("long")})
    shared = df.sparkSession.sparkContext.broadcast(books)
    scale, width, cuts = books.scale, books.width, np.cumsum([0] + [e.shape[1] for e in books.entries]).tolist()

    def run(vectors: pa.Array) -> pa.Array:
        mask, matrix = kept(vectors, scale, width)
        codes = np.zeros((len(matrix), len(shared.value.entries)), np.int32)
        far = np.zeros(len(matrix), np.int64)
        for p, entries in enumerate(shared.value.entries):
            codes[:, p], squares = Tree(entries).nearest(matrix[:, cuts[p] : cuts[p + 1]])
            far += squares
        at = np.full(len(vectors), -1)
        at[mask] = np.arange(len(matrix))
        take = pa.array(at, mask=~mask)
        both = [pa.array(list(codes), pa.list_(pa.int32())).take(take), pa.array(far).take(take)]
        return pa.StructArray.from_arrays(both, ["code", "error"], mask=pa.array(~mask))

    coded = free_name(out, "coded")
    # not deterministic: else the filter below would compute the codes once more
    coder = F.arrow_udf(run, "struct<code:array<int>,error:bigint>").asNondeterministic()
    found = out.withColumn(coded, coder(F.col(vector))).where(F.col(coded).isNotNull())
    return found.withColumns({code: F.col(f"{coded}.code"), error: F.col(f"{coded}.error")}).drop(coded)


def decode(df: DataFrame, books: Codebooks, code: str = "code", out: str = "decoded") -> DataFrame:
    """Adds the vector (array<double>) that a code stands for; a null code gives null."""
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(codes: pa.Array) -> pa.Array:
        entries, scale = shared.value.entries, shared.value.scale
        return pa.array([None if c is None else np.concatenate([e[i] for e, i in zip(entries, c)]) / scale for c in codes.to_pylist()], pa.list_(pa.float64()))

    return df.withColumn(out, F.arrow_udf(run, "array<double>")(F.col(code)))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """key, label, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256.

    Cases are those of fit and encode; a table without a vector that can be coded gives no rows. Sums of a label are
    made before the join that brings them back, and a label of very many rows is left to Spark's split of skewed joins.
    """
    books = fit(df, key, vector, **how)
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    coded = written(encode(rows, books, "vector").drop("vector"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    digest = F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256")
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", digest)


def _sql() -> str:
    """compress in SQL for vectors of one length that PARTS divides; a minimum of distance * ENTRIES + entry finds the nearest."""
    steps = [
        """whole AS (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * %(scale)d) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, len(v) // %(parts)d AS w FROM whole)",
        "parts AS (SELECT r, part, v[part * w + 1 : part * w + w] AS x FROM kept, (SELECT unnest(range(%(parts)d)) AS part))",
        "book_0 AS (SELECT part, r - 1 AS entry, x AS e FROM parts WHERE r <= %(entries)d)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""near_{i} AS (SELECT r, p.part, any_value(x) AS x,
            min(CAST(list_sum([(x[j] - e[j]) * (x[j] - e[j]) FOR j IN range(1, len(x) + 1)]) AS BIGINT) * %(entries)d + entry) AS m
        FROM parts p JOIN book_{i} b ON p.part = b.part GROUP BY r, p.part)""")
        if i < ROUNDS:
            steps.append(f"""means_{i} AS (SELECT part, entry, list(CAST((s - ((s %% n) + n) %% n) // n AS BIGINT) ORDER BY j) AS e FROM (
            SELECT part, m %% %(entries)d AS entry, j, sum(x[j]) AS s, count(*) AS n
            FROM near_{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY ALL) GROUP BY part, entry)""")
            steps.append(f"book_{i + 1} AS (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book_{i} b LEFT JOIN means_{i} m ON m.part = b.part AND m.entry = b.entry)")
    steps += [
        f"""coded AS (SELECT r, string_agg(printf('%%02x', m %% %(entries)d), '' ORDER BY part) AS code, CAST(sum(m // %(entries)d) AS BIGINT) AS error FROM near_{ROUNDS} GROUP BY r)""",
        "sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN kept USING (r) GROUP BY label)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book_{ROUNDS})",
    ]
    body = "WITH " + ",\n".join(steps) + """
    SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN kept USING (r) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label, digest"""  # fmt: skip
    return body % {"parts": PARTS, "entries": ENTRIES, "scale": SCALE}


SQL = _sql()
