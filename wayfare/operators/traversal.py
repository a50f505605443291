"""Breadth-first search from many sources.

A graph of at most KERNEL_ARCS arcs goes to the executors as sorted arrays, and each task runs its sources 64 to a word: a node
holds a bit for each source, a level is one gather and one grouped or over the arcs into the nodes next to the frontier. Up to FILE_ARCS arcs
and FILE_NODES nodes the arcs are written to the shared folder, sorted by target, and tasks read them there: neither the driver nor a broadcast
holds them. Larger graphs are cut into parts, whole components each; their arcs are sorted once by all tasks, and a task reads the
parts of its sources only. Graphs with a part that is too large for that stay distributed in the same form: SWEEP sources at a time, a row for each reached node holds their bits in words, and a level is a join of the frontier with the
arcs and an or by target. Each level is folded into what is asked for, and only the last state is kept, so that no way writes pairs of nodes
unless they are the answer. All give the same rows; unreached nodes have none.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.arcs import numbered, vertices_of
from wayfare.sources.shared import batches_of, discard, folder_of, new_dir, parts_of, place_of, remove, settled

#: 16 bytes each, so at most 80 MB are broadcast.
KERNEL_ARCS = 5_000_000
#: Arcs (4 bytes each, 8 in directed graphs) and nodes of a graph that each task reads from the shared folder.
FILE_ARCS = 16_000_000
FILE_NODES = 500_000
#: Nodes of a graph that one task labels, 50 bytes each, while it reads the arcs in batches.
LABEL_NODES = 16_000_000
#: A part's arcs come sorted, at 4 bytes instead of 16, so that it may be so many times as large as a whole graph in a task. Components are put
#: together up to PART_NODES nodes, and PIECE_ARCS arcs are sorted by a task.
PART_FACTOR = 4
PART_NODES = 4096
PIECE_ARCS = 2_000_000
#: From so many rounds of tasks on, a task that searches parts runs four blocks of sources.
MANY_ROUNDS = 16
#: Words of a task's sources, and of its state in all: graphs of many nodes are searched from fewer sources at a time.
WORDS = 32
STATE_WORDS = 4_000_000
#: Pairs of nodes made at a time.
CHUNK = 1 << 20
#: Nodes that gather the bits of their arcs together, arc by arc; nodes with more than HUB arcs do so on their own.
ROWS = 4096
HUB = 256
#: An arc followed for one source, or so many nodes marked for it, costs as much as that many words of an arc gathered for all.
PAIR_COST, PAIR_NODES = 3, 20
#: Words of a sweep over a distributed graph, and its sources.
SWEEP_WORDS = 8
SWEEP = 64 * SWEEP_WORDS
#: Out-arcs of a node that are joined in one task; those of a greater one are dealt to several.
HUB_ARCS = 1_000_000


class Graph:
    """Arcs (src, dst), distinct, and vertices (id), which may include nodes without arcs. The arrays are made once. symmetric: each arc is there both ways."""

    def __init__(self, arcs: DataFrame, vertices: DataFrame | None = None, kernel_arcs: int = KERNEL_ARCS, symmetric: bool = False):
        self.spark = arcs.sparkSession
        self.arcs = arcs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
        self._symmetric, self._held, self._more = symmetric, False, None if vertices is None else vertices.select(F.col("id").cast("bigint"))
        self.vertices = self._ends(self.arcs)
        self.kernel_arcs, self._arrays, self._files, self._nodes, self._spread, self._places, self._parts = kernel_arcs, None, None, None, None, None, None

    def _ends(self, arcs: DataFrame) -> DataFrame:
        found = arcs.select(F.col("src").alias("id")).distinct() if self._symmetric else vertices_of(arcs)
        return found if self._more is None else found.union(self._more).distinct()

    def hold(self) -> None:
        """Write arcs and vertices once, so that what they are derived from isn't read again by each step."""
        if not self._held:
            self._held = True
            arcs = settled(self.arcs, "arcs")
            self.arcs, self.vertices = arcs, settled(self._ends(arcs), "vertices")

    def node_count(self) -> int:
        self.hold()
        if self._nodes is None:
            self._nodes = self.vertices.count()
        return self._nodes

    def arrays(self):
        """A broadcast of the graph's arrays (see sorted_arrays), or None if the graph is too large."""
        self.hold()
        if self._arrays is None:
            if self.arcs.count() > self.kernel_arcs or self.node_count() > self.kernel_arcs:
                self._arrays = False
            else:
                arcs = self.arcs.toArrow()
                src, dst = (arcs.column(k).to_numpy() for k in range(2))
                ids = np.sort(self.vertices.toArrow().column(0).to_numpy())
                self._arrays = self.spark.sparkContext.broadcast(sorted_arrays(ids, np.searchsorted(ids, src), np.searchsorted(ids, dst)))
        return self._arrays or None

    def files(self) -> ArcFiles | None:
        """The same arrays in the shared folder, or None if a task can't hold the graph. The folder stays, as results are made from it later."""
        self.hold()
        if self._files is None:
            if self.arcs.count() > FILE_ARCS or self.node_count() > FILE_NODES:
                self._files = False
            else:
                self._files = ArcFiles(self.vertices.settled_path, self.arcs.settled_path)
        return self._files or None

    def reader(self):
        """Something whose value is the graph's arrays in each task, or None if the graph is too large for a task."""
        return self.arrays() or self.files()

    def places(self) -> DataFrame | None:
        """id, component (its least node), part, place (from 0, by part and id) and arcs (into the node) of all nodes, or None if a task can't hold them."""
        self.hold()
        if self._places is None:
            self._places = False
            if self.node_count() <= LABEL_NODES:
                nodes, arcs, least, symmetric = self.vertices.settled_path, self.arcs.settled_path, PART_NODES, self._symmetric

                def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for _ in batches:
                        columns = placed(nodes, arcs, least, symmetric)
                        for at in range(0, len(columns[0]), CHUNK):
                            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + CHUNK]) for c in columns], names=["id", "component", "part", "place", "arcs"])

                self._places = settled(self.spark.range(0, 1, 1, 1).mapInArrow(run, "id long, component long, part long, place long, arcs long"), "places")
        return self._places or None

    def degree_table(self) -> DataFrame | None:
        """node and degree where they have been counted already."""
        if not self._symmetric or not self._places:
            return None
        return self._places.select(F.col("id").alias("node"), F.col("arcs").alias("degree"))

    def parts(self) -> PartFiles | None:
        """The graph's parts in the shared folder, or None if some part is too large for a task. The folder stays, as results are made from it later."""
        if self._parts is None:
            self._parts, places = False, self.places()
            if places is not None:
                sizes = places.groupBy("part").agg(F.count("*").alias("n"), F.sum("arcs").alias("k")).agg(F.max("n"), F.max("k"), F.sum("k")).first()
                # arcs out of nodes are sorted by the task itself where they aren't those into them
                if (sizes[0] or 0) <= PART_FACTOR * FILE_NODES and (sizes[1] or 0) <= (PART_FACTOR if self._symmetric else 1) * FILE_ARCS:
                    self._parts = written_parts(self, sizes[2] or 0)
        return self._parts or None

    def searchable(self):
        """What searches read in each task, or None if the graph is too large for that."""
        return self.reader() or self.parts()

    def spread(self) -> tuple[DataFrame, DataFrame]:
        """Arcs (node, __salt, __to, __degree of __to) and nodes with more than HUB_ARCS out-arcs (node, __salts), over whose salts their arcs are dealt."""
        self.hold()
        if self._spread is None:
            degree = settled(self.arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("__degree")), "degrees")
            hubs = settled(degree.filter(F.col("__degree") > HUB_ARCS).select("node", F.ceil(F.col("__degree") / HUB_ARCS).cast("int").alias("__salts")), "hubs")
            arcs = self.arcs.select(F.col("src").alias("node"), F.col("dst").alias("__to"))
            # at most one hub for HUB_ARCS arcs
            arcs = arcs.join(F.broadcast(hubs), "node", "left").withColumn("__salt", F.pmod(F.xxhash64("__to"), F.coalesce("__salts", F.lit(1))).cast("int"))
            arcs = arcs.drop("__salts").join(degree.withColumnRenamed("node", "__to"), "__to", "left").withColumn("__degree", F.coalesce("__degree", F.lit(0)))
            self._spread = settled(arcs.select("node", "__salt", "__to", "__degree"), "arcs"), hubs
        return self._spread


def sorted_arrays(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple:
    """(ids, first arc into each node, sources by target, first arc out of each node, targets by source, out-degrees); src and dst are places in ids.

    Arcs out of nodes are None where they are those into them, as in symmetric graphs.
    """
    if not (np.all(dst[1:] >= dst[:-1]) and np.all((src[1:] > src[:-1]) | (dst[1:] > dst[:-1]))):
        arcs = dst.astype(np.int64) * len(ids) + src  # sorted as one number each
        arcs.sort()
        dst, src = np.divmod(arcs, max(1, len(ids)))
        del arcs
    src, dst = src.astype(np.int32), dst.astype(np.int32)
    into, degree = np.bincount(dst, minlength=len(ids)), np.bincount(src, minlength=len(ids))
    first = np.append(0, np.cumsum(into))
    back = src.astype(np.int64) * len(ids) + dst
    back.sort()
    out = (back % max(1, len(ids))).astype(np.int32)
    if np.array_equal(into, degree) and np.array_equal(out, src):
        return ids, first, src, None, None, degree
    return ids, first, src, np.append(0, np.cumsum(degree)), out, degree


#: The arrays of the files that this process read last.
_LAST_READ: dict[str, tuple] = {}


class ArcFiles:
    """Nodes (id) and arcs (src, dst) in two folders of Parquet files that all executors share, in any order."""

    def __init__(self, nodes: str, arcs: str):
        self.nodes, self.arcs = nodes, arcs

    @property
    def value(self) -> tuple:
        if self.arcs not in _LAST_READ:
            _LAST_READ.clear()
            ids = np.sort(np.concatenate([np.empty(0, np.int64), *[t.column("id").to_numpy() for t in parts_of(self.nodes)]]))
            # an arc is one number, so that a task holds 8 bytes each while it sorts them
            arcs = [np.searchsorted(ids, t.column("dst").to_numpy()) * len(ids) + np.searchsorted(ids, t.column("src").to_numpy()) for t in parts_of(self.arcs)]
            arcs = np.concatenate([np.empty(0, np.int64), *arcs])
            arcs.sort()
            dst, src = np.divmod(arcs, max(1, len(ids)))
            del arcs
            _LAST_READ[self.arcs] = sorted_arrays(ids, src.astype(np.int32), dst.astype(np.int32))
        return _LAST_READ[self.arcs]


def placed(nodes: str, arcs: str, least: int, symmetric: bool = False) -> tuple:
    """The columns of Graph.places, in the order of places; components are put together up to least nodes. Arcs are read a batch at a time: an end's root is tied to the lesser one of the other end's."""
    ids = np.sort(np.concatenate([np.empty(0, np.int64), *[t.column("id").to_numpy() for t in parts_of(nodes)]]))
    root, into, find = np.arange(len(ids), dtype=np.int32), np.zeros(len(ids), np.int64), place_of(ids)
    for batch in batches_of(arcs, CHUNK):
        a, b = find(batch.column("src").to_numpy()), find(batch.column("dst").to_numpy())
        into += np.bincount(b, minlength=len(ids))
        if symmetric:
            a, b = a[a < b], b[a < b]
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(above := root[root], root):
                root = above
    size = np.bincount(root, minlength=len(ids))
    part = ((np.cumsum(size) - size) // least)[root]
    order = np.argsort(part, kind="stable")
    return ids[order], ids[root[order]], part[order], np.arange(len(ids)), into[order]


def _place_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first arc into each node, first place of each part and of none) in the order of places, from a settled table of them."""
    if path not in _LAST_PLACES:
        _LAST_PLACES.clear()
        whole = pa.concat_tables(list(parts_of(path))).combine_chunks()
        order = np.argsort(whole.column("place").to_numpy(), kind="stable")
        ids, part, arcs = (whole.column(c).to_numpy()[order] for c in ("id", "part", "arcs"))
        _LAST_PLACES[path] = ids, np.append(0, np.cumsum(arcs)), np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(ids)]), len(ids))
    return _LAST_PLACES[path]


_LAST_PLACES: dict[str, tuple] = {}


def written_parts(graph: Graph, count: int) -> PartFiles:
    """Arcs as places of their sources, sorted by target, in pieces of about PIECE_ARCS, a file each: sorted runs first, then each piece from all runs."""
    table, arcs, to, most = graph.places().settled_path, graph.arcs.settled_path, new_dir(graph.spark, "parts"), 2 * PIECE_ARCS
    pieces, tasks = max(1, -(-count // PIECE_ARCS)), 2 * graph.spark.sparkContext.defaultParallelism

    def write(held: np.ndarray) -> str:
        name = uuid.uuid4().hex  # a task that is run again writes another file
        system, at = folder_of(to)
        system.create_dir(at)
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(held)
        return name

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, _ = _place_table(table)
        order = np.argsort(ids, kind="stable")
        find = place_of(ids[order])
        bounds = np.searchsorted(first, -(-np.arange(1, pieces) * count // pieces)) << 32  # of the pieces' targets
        for task in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            for batch in batches_of(arcs, most, task, tasks):
                held = order[find(batch.column("dst").to_numpy())] << 32
                held |= order[find(batch.column("src").to_numpy())]
                held.sort()
                yield pa.RecordBatch.from_arrays([pa.array([write(held)]), pa.array([[0, *np.searchsorted(held, bounds).tolist(), len(held)]])], names=["name", "ends"])

    found = graph.spark.range(0, tasks, 1, tasks).mapInArrow(runs, "name string, ends array<long>").collect()  # a row for each run
    sorted_runs = [(r["name"], r["ends"]) for r in found]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = folder_of(to)
        for k in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            held = [np.empty(0, np.int64)]
            for name, ends in sorted_runs:
                with system.open_input_file(f"{at}/{name}") as file:
                    held.append(np.frombuffer(file.read_at(8 * (ends[k + 1] - ends[k]), 8 * ends[k]), np.int64))
            held = np.concatenate(held)
            held.sort()
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([write((held & 0xFFFFFFFF).astype(np.int32))]), pa.array([len(held)])], names=["piece", "name", "arcs"])

    made = sorted(map(tuple, graph.spark.range(0, pieces, 1, pieces).mapInArrow(merged, "piece long, name string, arcs long").collect()))  # a row for each piece
    for name, _ in sorted_runs:
        remove(graph.spark, f"{to}/{name}")
    return PartFiles(table, to, [x[1] for x in made], np.append(0, np.cumsum([x[2] for x in made])), graph._symmetric)


class PartFiles:
    """Parts of a graph: a table of places and pieces of sorted arcs, with the numbers of the arcs before each. A part is a stretch of places."""

    def __init__(self, table: str, to: str, names: list[str], before: np.ndarray, symmetric: bool):
        self.table, self.to, self.names, self.before, self.symmetric = table, to, names, before, symmetric

    def starts(self) -> np.ndarray:
        return _place_table(self.table)[2]

    def ids(self, place: np.ndarray) -> np.ndarray:
        return _place_table(self.table)[0][place]

    def value_of(self, low: int, high: int) -> tuple:
        """The arrays of the part from place low to high; see sorted_arrays."""
        key = f"{self.to}/{low}"
        if key not in _LAST_READ:
            _LAST_READ.clear()
            ids, first, _ = _place_table(self.table)
            ids, first = ids[low:high], first[low : high + 1]
            system, at = folder_of(self.to)
            src, done, end = np.empty(int(first[-1] - first[0]), np.int32), int(first[0]), int(first[-1])
            while done < end:
                k = int(np.searchsorted(self.before, done, "right")) - 1
                upto = min(end, int(self.before[k + 1]))
                with system.open_input_file(f"{at}/{self.names[k]}") as file:
                    src[done - first[0] : upto - first[0]] = np.frombuffer(file.read_at(4 * (upto - done), 4 * (done - int(self.before[k]))), np.int32)
                done = upto
            src -= np.int32(low)
            first = first - first[0]
            if self.symmetric:
                _LAST_READ[key] = ids, first, src, None, None, np.diff(first)
            else:
                _LAST_READ[key] = sorted_arrays(ids, src, np.repeat(np.arange(high - low, dtype=np.int32), np.diff(first)))
        return _LAST_READ[key]


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def levels(arrays: tuple, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, places of the nodes that some source reaches there, their bits): a row of words for each node, a bit for each source."""
    ids, first, src, first_out, out, _ = arrays
    if out is None:
        first_out, out = first, src
    words = -(-len(sources) // 64)
    seen, every = np.zeros((len(ids), words), np.uint64), np.zeros(words, np.uint64)
    at, place = np.searchsorted(ids, sources), np.arange(len(sources))
    bit = np.uint64(1) << (place % 64).astype(np.uint64)
    np.bitwise_or.at(seen, (at, place // 64), bit)
    np.bitwise_or.at(every, place // 64, bit)
    entered = np.flatnonzero(np.diff(first))
    board, front, dist = np.zeros_like(seen), np.unique(at), 0
    fresh = seen[front]
    near = _near(first_out, out, at, words)
    while len(front):
        yield dist, front, fresh
        wide, fronts, parts = False, [np.empty(0, np.int64)], [np.empty((0, words), np.uint64)]
        if (bits := next(near, None)) is not None:
            to = np.flatnonzero(np.bitwise_or.reduce(bits, axis=0))
        else:
            size = first_out[front + 1] - first_out[front]
            wide = 4 * int(size.sum()) > len(out)
            if wide:
                to = entered
            else:
                mark = np.zeros(len(ids), bool)
                mark[out[stretches(first_out[front], size)]] = True
                to = np.flatnonzero(mark)
            if len(front) == len(ids):
                now = fresh
            else:
                now = board
                now[front] = fresh
            arcs, start, end = src, first[to], first[to + 1]
            if 2 * len(front) < len(ids):  # few enough that arcs from elsewhere are better left out first
                if not wide:
                    arcs = src[stretches(start, end - start)]
                    end = np.cumsum(end - start)
                    start = np.append(0, end[:-1])
                mark = np.zeros(len(ids), bool)
                mark[front] = True
                sent = mark.take(arcs)
                before = np.append(0, np.cumsum(sent))
                arcs, start, end = arcs[sent], before[start], before[end]
        # the state of some nodes is read and written while it is near
        for k in range(0, len(to), ROWS):
            own = to[k : k + ROWS]
            if bits is not None:
                held = seen.take(own, axis=0)
                part = np.ascontiguousarray(bits[:, own].T) & ~held
                some = np.flatnonzero(part.any(1))
            else:
                from_, size = start[k : k + ROWS], end[k : k + ROWS] - start[k : k + ROWS]
                order = np.argsort(-size, kind="stable")
                held = seen.take(own[order], axis=0)
                lack = every & ~held
                if wide and not (rest := lack.any(1)).all():  # nodes with every bit rest
                    order, held, lack = order[rest], held[rest], lack[rest]
                own, part = own[order], _gathered(now, arcs, from_[order], size[order], lack)
                some = np.flatnonzero(part.any(1))
                some = some[np.argsort(own[some])]
            if bits is None or len(some) < len(own):
                own, part, held = own[some], part[some], held[some]
            held |= part
            seen[own] = held
            fronts.append(own)
            parts.append(part)
        if bits is None and now is board:
            now[front] = 0
        front, fresh = np.concatenate(fronts), np.concatenate(parts)
        dist += 1


def _near(first_out: np.ndarray, out: np.ndarray, at: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The bits that reach nodes over one arc, then over two, source by source: a column for each node. Only as long as that is less work than a gather of all arcs."""
    from_, size = first_out[at], first_out[at + 1] - first_out[at]
    nodes, ends, own = at, np.arange(1, len(at) + 1), size
    for _ in range(2):
        if PAIR_COST * (int(own.sum()) + len(at) * (len(first_out) - 1) // PAIR_NODES) > words * len(out):
            return
        bytes_, mark = np.zeros((words, len(first_out) - 1, 8), np.uint8), np.zeros(len(first_out) - 1, np.uint8)
        starts = first_out[nodes]
        for first in range(0, len(ends), 8):
            row = np.zeros_like(mark)
            for k in range(first, min(first + 8, len(ends))):
                mine = slice(int(ends[k - 1]) if k else 0, int(ends[k]))
                mark[:] = 0
                mark[out.take(stretches(starts[mine], own[mine]))] = 1 << k % 8
                row |= mark
            bytes_[first // 64, :, first // 8 % 8] = row
        bits = bytes_.view(np.uint64)[:, :, 0]
        yield bits
        nodes, ends = out[stretches(from_, size)], np.cumsum(size)
        own = first_out[nodes + 1] - first_out[nodes]


def _gathered(now: np.ndarray, src: np.ndarray, start: np.ndarray, size: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each node those of the bits that it needs which its arcs bring from now, src from start on: the nth arcs of all nodes together, those of hubs at once. Sizes fall."""
    out = np.zeros_like(need)
    hubs = int(np.searchsorted(-size, -HUB, "left"))
    for k in range(hubs):
        for at in range(int(start[k]), int(start[k] + size[k]), ROWS):
            out[k] |= np.bitwise_or.reduce(now.take(src[at : min(at + ROWS, int(start[k] + size[k]))], axis=0), axis=0)
    out[:hubs] &= need[:hubs]
    rows, start, size, lack = np.arange(hubs, len(size)), start[hubs:], size[hubs:], need[hubs:]
    got, n = out[hubs:], 0
    while len(rows):
        # up to 4, 6, 9, 13, ... arcs, then nodes with all arcs or all bits leave, if they are enough to be worth it
        upto = min(max(4, n + n // 2), int(size[0]))
        for k in range(n, upto):
            m = int(np.searchsorted(-size, -k, "left"))  # nodes with more than k arcs
            part = got[:m]
            np.bitwise_or(part, now.take(src.take(start[:m] + k), axis=0), out=part)
        n, left = upto, size > upto
        held = int(np.count_nonzero(left))  # the first ones, as sizes fall
        left[:held] = (lack[:held] & ~got[:held]).any(1)
        staying = int(np.count_nonzero(left))
        if not staying:
            got &= lack
            if len(rows) < len(out) - hubs:
                out[rows] = got
            break
        if 8 * staying < 7 * len(rows):
            gone = ~left
            out[rows[gone]] = got[gone] & lack[gone]
            rows, start, size, lack, got = rows[left], start[left], size[left], lack[left], got[left]
    return out


def unpacked(bits: np.ndarray, count: int) -> np.ndarray:
    """A row for each node, a 0 or 1 for each source."""
    return np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :count]


def _words(nodes: int) -> int:
    return max(1, min(WORDS, STATE_WORDS // max(1, nodes)))


def _kernel(graph: Graph, sources: DataFrame, run: Callable, schema: str, most_parts: int | None = None) -> DataFrame:
    """run(arrays, blocks of (sources, their weights)) gives the columns of schema. Near ids go together, as they are often near in the graph."""
    reader = graph.reader()
    if reader is None:
        return _kernel_of_parts(graph, sources, run, schema, most_parts)
    words = _words(graph.node_count())
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    weighted = "weight" in sources.columns

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        for batch in batches:
            for own in np.array_split(np.arange(batch.num_rows), max(1, round(batch.num_rows / (64 * words)))) if batch.num_rows else []:
                part = batch.slice(int(own[0]), len(own))
                yield part.column(0).to_numpy(), part.column(1).to_numpy() if weighted else None

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks(batches)
        if (head := next(own, None)) is not None:  # a task without sources needn't read the graph
            for columns in run(reader.value, itertools.chain([head], own)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    # whole rounds of tasks of one size, so that none runs alone at the end
    slots = graph.spark.sparkContext.defaultParallelism
    parts = slots * max(1, -(-sources.count() // (64 * words * slots)))
    spread = sources.select(F.col("id").cast("bigint"), *([F.col("weight").cast("double")] if weighted else []))
    return spread.repartitionByRange(parts if most_parts is None else min(parts, most_parts), "id").mapInArrow(over, schema)


def _kernel_of_parts(graph: Graph, sources: DataFrame, run: Callable, schema: str, most_parts: int | None) -> DataFrame:
    """The same part by part: a task has sources of near places, of a part or several."""
    files, names = graph.parts(), [x.strip().split(" ")[0] for x in schema.split(",")]
    weighted = "weight" in sources.columns

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):  # a task without sources needn't read the graph
            return
        held = pa.Table.from_batches(held)
        place = held.column("place").to_numpy()
        order = np.argsort(place, kind="stable")
        place, weight = place[order], held.column("weight").to_numpy()[order] if weighted else None
        starts = files.starts()
        own = np.searchsorted(starts, place, "right") - 1
        for rows in np.split(np.arange(len(place)), np.flatnonzero(np.diff(own)) + 1):
            low, high = int(starts[own[rows[0]]]), int(starts[own[rows[0]] + 1])
            blocks = np.array_split(rows, max(1, round(len(rows) / (64 * _words(high - low)))))
            for columns in run(files.value_of(low, high), ((files.ids(place[b]), weight[b] if weighted else None) for b in blocks)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    slots = graph.spark.sparkContext.defaultParallelism
    rounds = max(1, -(-sources.count() // (64 * WORDS * slots)))
    parts = slots * (rounds if rounds < MANY_ROUNDS else -(-rounds // 4))
    spread = sources.select(F.col("id").cast("bigint"), *([F.col("weight").cast("double")] if weighted else []))
    spread = spread.join(graph.places().select("id", "place"), "id").select("place", *(["weight"] if weighted else []))
    return spread.repartitionByRange(parts if most_parts is None else min(parts, most_parts), "place").mapInArrow(over, schema)


def ones(bits: np.ndarray, count: int) -> np.ndarray:
    """For each source how many rows have its bit. Three rows of one weight become their sum and their carry, bit by bit, until few are left."""
    total = np.zeros(count, np.int64)
    for at in range(0, len(bits), 1 << 13):
        rows, weight = bits[at : at + (1 << 13)], 0
        while len(rows):
            carried = [rows[:0]]
            while len(rows) >= 24:
                third = len(rows) // 3
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                odd = a ^ b
                carried.append(a & b | odd & c)
                rows = np.concatenate([odd ^ c, rows[3 * third :]])
            total += unpacked(np.ascontiguousarray(rows), count).sum(0, dtype=np.int64) << weight
            rows, weight = np.concatenate(carried), weight + 1
    return total


def tallies(bits: np.ndarray, count: int, degree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each source how many nodes have its bit, and the sum of their degrees, taken bit by bit of these."""
    arcs = np.zeros(count, np.int64)
    if degree is not None and len(bits):
        d = degree.astype(np.int64)
        for j in range(int(d.max()).bit_length()):
            arcs += ones(bits[d >> j & 1 == 1], count) << j
    return ones(bits, count), arcs


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def weighed(bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each node the sum of the weights of the sources whose bits it has, looked up byte by byte."""
    bytes_ = bits.view(np.uint8)
    padded = np.zeros(8 * bytes_.shape[1])
    padded[: len(weight)] = weight
    out = np.zeros(len(bits))
    for k in range(-(-len(weight) // 8)):
        out += (_BITS_OF @ padded[8 * k : 8 * k + 8])[bytes_[:, k]]
    return out


def swept(graph: Graph, sources: DataFrame) -> Iterator[tuple[np.ndarray, int, DataFrame]]:
    """(ids of a sweep's sources, distance, nodes reached there) for a distributed graph. Rows: node, degree, f0, f1, ... (the sources' bits).

    A level's rows are read before the next one is asked for; then they are deleted.
    """
    arcs, hubs = graph.spread()
    words = range(SWEEP_WORDS)
    placed = numbered(sources.select(F.col("id").cast("bigint").alias("id")).distinct(), ["id"], "__n")
    placed = settled(placed.withColumn("__sweep", F.floor(F.col("__n") / SWEEP)), "sources")
    degree = graph.arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    for sweep in range(-(-placed.count() // SWEEP)):
        own = placed.filter(F.col("__sweep") == sweep).select("id", F.pmod("__n", F.lit(SWEEP)).cast("int").alias("__k"))
        ids = np.array([r[0] for r in own.orderBy("__k").collect()], np.int64)  # SWEEP at most
        bit = [F.when(F.floor(F.col("__k") / 64) == w, F.expr("shiftleft(1L, __k % 64)")).otherwise(F.lit(0).cast("long")) for w in words]
        start = own.select(F.col("id").alias("node"), *[bit[w].alias(f"f{w}") for w in words]).join(degree, "node", "left")
        state = settled(start.select("node", F.coalesce("degree", F.lit(0)).alias("degree"), *[f"f{w}" for w in words], *[F.col(f"f{w}").alias(f"s{w}") for w in words]), "state")
        dist = 0
        while True:
            front = state.filter(" or ".join(f"f{w} <> 0" for w in words))
            if front.isEmpty():
                break
            yield ids, dist, front.select("node", "degree", *[f"f{w}" for w in words])
            sent = front.select("node", *[f"f{w}" for w in words]).join(F.broadcast(hubs), "node", "left")
            sent = sent.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
            to = sent.join(arcs, ["node", "__salt"]).groupBy(F.col("__to").alias("node"))
            reached = to.agg(F.first("__degree").alias("__d"), *[F.expr(f"bit_or(f{w})").alias(f"r{w}") for w in words])
            both = state.select("node", "degree", *[f"s{w}" for w in words]).join(reached, "node", "full")
            seen = {w: F.coalesce(f"s{w}", F.lit(0).cast("long")) for w in words}
            new = {w: F.coalesce(f"r{w}", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(seen[w])) for w in words}
            after = both.select("node", F.coalesce("degree", "__d").alias("degree"), *[new[w].alias(f"f{w}") for w in words], *[seen[w].bitwiseOR(new[w]).alias(f"s{w}") for w in words])
            after, dist = settled(after, "state"), dist + 1
            discard(state)
            state = after
        discard(state)
    discard(placed)


def words_of(batch: pa.RecordBatch) -> np.ndarray:
    """The bits of a swept batch, a row of words for each node."""
    return np.ascontiguousarray(np.stack([c.to_numpy() for c in batch.columns[2:]], 1)).view(np.uint64)


def folded(graph: Graph, sources: DataFrame, fold: Callable, schema: str, total: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """total over the rows that fold(ids, dist, batch) makes of each swept batch; each level's rows are written as they are found."""
    names, out = [x.strip().split(" ")[0] for x in schema.split(",")], []
    for ids, dist, front in swept(graph, sources):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, dist: int = dist) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in fold(ids, dist, batch)], names=names)

        out.append(settled(total(front.mapInArrow(run, schema)), "folded"))
        if len(out) >= 64:  # few enough to be read together
            out = [_united(out, total)]
    return _united(out, total) if out else total(graph.spark.createDataFrame([], schema))


def _united(parts: list[DataFrame], total: Callable[[DataFrame], DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    out = settled(total(whole), "folded")
    for part in parts:
        discard(part)
    return out


def pairs(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """source, node, dist for every reached node, each source at 0 of itself. As many rows as pairs: for small graphs and few sources."""
    graph.hold()
    sources = graph.vertices if sources is None else sources
    if graph.searchable() is None:
        return frontier_pairs(graph, sources)
    return _kernel_pairs(graph, sources)


def _kernel_pairs(graph: Graph, sources: DataFrame) -> DataFrame:
    def run(arrays, blocks):
        ids = arrays[0]
        for block, _ in blocks:
            rows = max(1, CHUNK // len(block))
            for dist, front, bits in levels(arrays, block):
                for at in range(0, len(front), rows):
                    found = np.flatnonzero(unpacked(bits[at : at + rows], len(block)))
                    node, source = np.divmod(found, len(block))
                    yield block[source], ids[front[at : at + rows]][node], np.full(len(node), dist, np.int32)

    return _kernel(graph, sources.select("id"), run, "source long, node long, dist int")


def frontier_pairs(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """The same for a distributed graph, made by tasks as it is read where they can hold the graph."""
    graph.hold()
    sources = graph.vertices if sources is None else sources
    if graph.files() is not None or graph.searchable() is not None:
        return _kernel_pairs(graph, sources)

    def fold(ids, dist, batch):
        node, source = np.nonzero(unpacked(words_of(batch), len(ids)))
        return ids[source], batch.column(0).to_numpy()[node], np.full(len(node), dist, np.int32)

    return folded(graph, sources, fold, "source long, node long, dist int", lambda rows: rows)


def _levels_of(graph: Graph, sources: DataFrame) -> DataFrame:
    """The histogram of a distributed graph: partial counts of each batch, summed."""

    def fold(ids, dist, batch):
        count, arcs = tallies(words_of(batch), len(ids), batch.column(1).to_numpy())
        some = np.flatnonzero(count)
        return ids[some], np.full(len(some), dist, np.int32), count[some], arcs[some]

    total = lambda rows: rows.groupBy("source", "dist").agg(F.sum("cnt").alias("cnt"), F.sum("arcs").alias("arcs"))
    return folded(graph, sources, fold, "source long, dist int, cnt long, arcs long", total)


def histogram(graph: Graph, sources: DataFrame | None = None, arcs: bool = True) -> DataFrame:
    """source, dist, cnt and arcs (out-arcs of the nodes there; left out unless wanted): all that the measures need."""
    graph.hold()
    sources = graph.vertices if sources is None else sources
    if graph.searchable() is None:
        found = _levels_of(graph, sources)
        return found if arcs else found.drop("arcs")

    def run(arrays, blocks):
        for block, _ in blocks:
            for dist, front, bits in levels(arrays, block):
                count, out = tallies(bits, len(block), arrays[5][front] if arcs else None)
                some = np.flatnonzero(count)
                yield (block[some], np.full(len(some), dist, np.int32), count[some], *([out[some]] if arcs else []))

    return _kernel(graph, sources.select("id"), run, "source long, dist int, cnt long" + (", arcs long" if arcs else ""))


def sums_and_farness(graph: Graph, sources: DataFrame) -> DataFrame:
    """One search from each of sources (id, weight) for both of: rows with far false, node and value, the weighted sum of its distances from
    the sources (no row where none reaches it); rows with far true, a source and its farness."""
    schema = "far boolean, node long, value double"
    total = lambda rows: rows.groupBy("far", "node").agg(F.sum("value").alias("value"))
    if graph.searchable() is None:
        # a sweep's weights go along with its sources, SWEEP at most
        weights = dict(sources.select("id", "weight").toArrow().to_pandas().itertuples(index=False)) if sources.count() <= SWEEP else None
        if weights is None:
            return _far_and_sums_by_join(graph, sources)

        def fold(ids, dist, batch):
            bits, nodes = words_of(batch), batch.column(0).to_numpy()
            sums = dist * weighed(bits, np.array([weights[i] for i in ids.tolist()]))
            return np.repeat([False, True], [len(nodes), len(ids)]), np.concatenate([nodes, ids]), np.concatenate([sums, dist * tallies(bits, len(ids))[0].astype(np.float64)])

        return folded(graph, sources, fold, schema, total)

    def run(arrays, blocks):
        ids = arrays[0]
        sums, hit = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for block, weight in blocks:
            far = np.zeros(len(block))
            for dist, front, bits in levels(arrays, block):
                hit[front] = True
                sums[front] += dist * weighed(bits, weight)
                far += dist * tallies(bits, len(block))[0]
            yield np.ones(len(block), bool), block, far
        yield np.zeros(int(hit.sum()), bool), ids[hit], sums[hit]

    # a task's sums are a row for each node that its sources reach
    most = 4 * graph.spark.sparkContext.defaultParallelism
    return total(_kernel(graph, sources.select("id", "weight"), run, schema, most))


def _far_and_sums_by_join(graph: Graph, sources: DataFrame) -> DataFrame:
    """The same sweep by sweep, with each sweep's weights."""
    total = lambda rows: rows.groupBy("far", "node").agg(F.sum("value").alias("value"))
    placed = settled(numbered(sources.select("id", "weight"), ["id"], "__n"), "sources")
    parts = []
    for k in range(-(-placed.count() // SWEEP)):
        parts.append(settled(sums_and_farness(graph, placed.filter(F.floor(F.col("__n") / SWEEP) == k).select("id", "weight")), "folded"))
        if len(parts) >= 64:
            parts = [_united(parts, total)]
    return _united(parts, total)


def distance_sums(graph: Graph, sources: DataFrame) -> DataFrame:
    """node and total, the weighted sum of its distances from sources (id, weight). Nodes that no source reaches have no row."""
    return sums_and_farness(graph, sources).filter("not far").select("node", F.col("value").alias("total"))
