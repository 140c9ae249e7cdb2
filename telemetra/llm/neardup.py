"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct ``words``-word shingles.  Documents are linked if
their sets' Jaccard similarity is ``percent`` or more; a group is what links connect.

1. Sketch.  The hash of a shingle names one of 256 buckets; a register stores the
   least hash of its bucket as leading-zero count (6 bits) and mantissa (10 bits).
   A bucket without shingles takes the least of a hash of its own over the set, so
   equal registers have the sets' similarity as probability also for small sets.
   Documents with equal sets are one class from here on (128-bit set hash).
2. Band.  48 bands of 5 registers: a pair at 0.8 is missed with probability 5e-9.
3. Star links.  In each bucket all classes are compared with its hub, the class that
   shares most buckets, in rows and not in pairs.  The collision-corrected estimate
   drops pairs six standard errors below the threshold; the others are confirmed on
   their full sets.
4. The rest.  Buckets that still hold several components are compared across
   components.  Where that would be over ``DENSE`` pairs a member, classes are compared
   only if they share one of their rarest shingles, as linked sets must (an exact
   bound from both sizes); in a group of near copies those are the edits.
5. Components by star contraction.

A class that many are compared with is repeated over salted tasks.  What a task
holds is one class and a batch.  Groups of equal documents are aggregated before
the shuffle; nothing is gathered by group.

Null texts and texts without words have the empty set and link with nothing;
texts with fewer words have their whole sequence as one shingle.  A null doc_id
takes part and is the least; rows that share an id are compared by their texts and
may be in different groups.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm import arrays
from telemetra.llm.common import NO_ID, keyed, stage
from telemetra.llm.components import components
from telemetra.session import ship_package

REGISTERS = 256
BANDS, ROWS = 48, 5
MANTISSA = 10
#: Pairs a member above which a bucket is bounded first.
DENSE = 4
#: Comparisons of one class in one task.
PER_TASK = 512

_FRESH = arrays.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and their offsets."""
    data, at = arrays.flat(texts)
    found = arrays.Words(arrays.LOWER[data], at, arrays.SPACED)
    units, rows = found.hashes(), found.rows
    grams = arrays.gram_hashes(units, words)
    spot = np.flatnonzero(arrays.starts_of_windows(rows, words, len(units))[: len(grams)])
    owner = np.searchsorted(rows, spot, side="right") - 1
    value = grams[spot]
    count = np.diff(rows)
    for n in range(1, words):  # short texts are one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            runs = units[rows[short][:, None] + np.arange(n)].reshape(-1)
            value = np.append(value, arrays.gram_hashes(runs, n)[:: n])
            owner = np.append(owner, short)
    n_texts = len(at) - 1
    owner = owner.astype(np.uint16 if n_texts < 1 << 16 else np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n_texts + 1))


def registers(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 256 16-bit registers for each non-empty set of sorted hashes."""
    n = len(at) - 1
    least = np.full((n, REGISTERS), np.uint64(0))
    filled = np.zeros((n, REGISTERS), bool)
    owner, bucket = arrays.owners(at), (value >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(value), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    least[owner[first], bucket[first]] = value[first] & np.uint64((1 << 56) - 1)
    filled[owner[first], bucket[first]] = True
    for i in np.flatnonzero(~filled.all(1)):
        own = value[at[i] : at[i + 1]]
        if len(own):
            empty = np.flatnonzero(~filled[i])
            fresh = (own[:, None] ^ (own[:, None] >> np.uint64(29))) * _FRESH[empty]
            least[i, empty] = fresh.min(0) >> np.uint64(8)
    top = least >> np.uint64(4)  # 52 bits, exact as floating point
    size = np.frexp(top.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(52) - size
    mantissa = (top << (zeros + np.uint64(12))) << np.uint64(1) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype("<u2")


@functools.cache
def _collisions() -> np.ndarray:
    """Chance that registers of unrelated sets of about 2^i and 2^j shingles are equal."""
    steps = 1 << MANTISSA
    cell = 1 + np.arange(steps) / steps
    low = np.concatenate([cell * 2.0 ** -(z + 1) for z in range(52)])
    high = np.concatenate([(cell + 1 / steps) * 2.0 ** -(z + 1) for z in range(52)])
    size = 2.0 ** np.arange(0, 31)
    inside = np.stack(
        [
            np.exp(n * np.log1p(-low / REGISTERS)) - np.exp(n * np.log1p(-high / REGISTERS))
            for n in size
        ]
    )
    return inside @ inside.T


def estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of pairs of register rows."""
    equal = (x == y).mean(1)
    chance = _collisions()[
        np.clip(np.round(np.log2(np.maximum(n_x, 1))), 0, 30).astype(int),
        np.clip(np.round(np.log2(np.maximum(n_y, 1))), 0, 30).astype(int),
    ]
    return (equal - chance) / (1 - chance)


_SKETCH = "_doc long, _tie long, n long, a long, b long, registers binary"


def _sketch(words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            value, at = shingles(part.column("text"), words)
            n = np.diff(at)
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(arrays.mix(value))]
            other = np.r_[np.zeros(1, np.uint64), np.cumsum(arrays.mix(value ^ np.uint64(0x5BD1E995)))]
            a, b = (arrays.signed(t[at[1:]] - t[at[:-1]]) for t in (total, other))
            raw = registers(value, at).reshape(-1).view(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_doc"), part.column("_tie"), pa.array(n), pa.array(a), pa.array(b),
                    arrays.binary_array(raw, np.arange(len(n) + 1) * REGISTERS * 2),
                ],
                ["_doc", "_tie", "n", "a", "b", "registers"],
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, _ = arrays.flat(batch.column("registers"))
        code = raw.view("<u2").reshape(batch.num_rows, REGISTERS)[:, : BANDS * ROWS]
        code = code.reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), code.shape[:2]).copy()
        for j in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + code[:, :, j] + np.uint64(1)
        cid = batch.column("cid").to_numpy()
        yield pa.RecordBatch.from_pydict(
            {"key": arrays.signed(arrays.mix(key)).reshape(-1), "cid": np.repeat(cid, BANDS)}
        )


def compare(pairs: DataFrame, payload: DataFrame, judge: Callable, prepare: Callable) -> DataFrame:
    """The pairs (x, y) whose payloads ``judge`` accepts.

    Payloads of x travel to y, one row a pair; a y with many pairs is repeated over
    salted tasks of about PER_TASK pairs.  A task holds one y and a batch.
    """
    size = pairs.groupBy("y").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts"))
    rows = pairs.join(size, "y").select(
        "y", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), "x"
    )
    guests = rows.join(payload.withColumnRenamed("cid", "x"), "x")
    hosts = size.select("y", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hosts = hosts.join(payload.withColumnRenamed("cid", "y"), "y").withColumn(
        "x", F.lit(None).cast("long")
    )
    columns = ["y", "salt", "x", "n", "payload"]
    met = hosts.select(columns).unionByName(guests.select(columns))
    met = met.repartition("y", "salt").sortWithinPartitions("y", "salt", F.asc_nulls_first("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = host_n = None
        for part in arrays.slices(batches, "payload"):
            y = part.column("y").to_numpy()
            x = part.column("x").to_numpy(zero_copy_only=False)
            n = part.column("n").to_numpy()
            opens = np.flatnonzero(np.isnan(x.astype(float)) if x.dtype != np.int64 else np.zeros(len(x), bool))
            ready = prepare(part.column("payload"))
            edges = np.unique(np.r_[0, opens, part.num_rows])
            keep = np.zeros(part.num_rows, bool)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low in opens:
                    host, host_n = ready(low), n[low]
                    low += 1
                if high > low:
                    keep[low:high] = judge(host, host_n, ready, n, low, high)
            yield pa.RecordBatch.from_arrays(
                [part.column("x").filter(pa.array(keep)), pa.array(y[keep])], ["x", "y"]
            )

    return met.mapInArrow(run, "x long, y long")


def _estimated(percent: int) -> tuple[Callable, Callable]:
    def prepare(payload: pa.Array) -> Callable:
        raw, _ = arrays.flat(payload)
        code = raw.view("<u2").reshape(len(payload), REGISTERS)
        return lambda low, high=None: code[low] if high is None else code[low:high]

    def judge(host, host_n, ready, n, low, high):  # noqa: ANN001, ANN202
        own = n[low:high]
        guess = estimate(ready(low, high), host[None, :], own, np.full(len(own), host_n))
        held = np.minimum(np.minimum(own, host_n), REGISTERS)
        margin = 6 * np.sqrt(0.16 / held)
        possible = 100 * np.minimum(own, host_n) >= percent * np.maximum(own, host_n)
        return possible & (guess >= percent / 100 - margin)

    return judge, prepare


def _exact(percent: int, words: int) -> tuple[Callable, Callable]:
    def prepare(payload: pa.Array) -> Callable:
        value, at = shingles(payload, words)
        return lambda low: value[at[low] : at[low + 1]]

    def judge(host, host_n, ready, n, low, high):  # noqa: ANN001, ANN202
        out = []
        for i in range(low, high):
            own = ready(i)
            at = np.minimum(np.searchsorted(host, own), len(host) - 1)
            both = int((host[at] == own).sum())
            out.append(100 * both >= percent * (len(host) + len(own) - both))
        return np.array(out)

    return judge, prepare


class _Groups:
    """The steps of one run."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        """``texts`` has (_doc, _tie, text); the first two tell different texts apart."""
        self.words, self.percent = words, percent
        self.sketches = stage(texts.mapInArrow(_sketch(words), _SKETCH), "sketches")
        sets = self.sketches.filter("n > 0").groupBy("a", "b", "n")
        least = F.min(F.struct("_doc", "_tie"))
        classes = sets.agg(least.alias("_key"), F.first("registers").alias("registers"))
        classes = classes.select("a", "b", "n", "_key._doc", "_key._tie", "registers")
        # the number is fixed when the table is written
        self.classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        members = self._members()
        hubs = self._hubs(members)
        star = members.join(hubs, "key").filter("cid <> hub")
        star = star.select(F.col("cid").alias("x"), F.col("hub").alias("y")).distinct()
        self.texts = stage(self._texts(texts, members), "texts", compression="zstd")
        links = stage(self._confirmed(star), "links")
        groups = components(links)
        rest = self._rest(members, groups)
        more = stage(self._confirmed(rest), "links")
        self.groups = groups if more.isEmpty() else components(links.unionByName(more))

    def _members(self) -> DataFrame:
        """(key, cid) of all buckets with several classes."""
        bands = self.classes.select("cid", "registers").mapInArrow(_bands, "key long, cid long")
        shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        return stage(bands.join(shared, "key"), "members")

    def _hubs(self, members: DataFrame) -> DataFrame:
        """For each bucket, the class that meets most others over all buckets."""
        meets = members.groupBy("cid").agg(F.sum("size").alias("meets"))
        ranked = members.join(meets, "cid")
        best = F.max(F.struct("meets", (-F.col("cid")).alias("c")))
        return ranked.groupBy("key").agg((-best["c"]).alias("hub"))

    def _texts(self, texts: DataFrame, members: DataFrame) -> DataFrame:
        """(cid, n, payload): the text of one document of each class in a shared bucket."""
        wanted = members.select("cid").distinct().join(self.classes.drop("registers"), "cid")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in arrays.slices(batches, "text"):
                value, at = shingles(part.column("text"), words)
                total = np.r_[np.zeros(1, np.uint64), np.cumsum(arrays.mix(value))]
                a = arrays.signed(total[at[1:]] - total[at[:-1]])
                same = pa.array(a == part.column("a").to_numpy())
                kept = part.filter(same).select(["cid", "n", "text"])
                yield kept.rename_columns(["cid", "n", "payload"])

        found = texts.join(wanted, ["_doc", "_tie"])
        found = found.mapInArrow(run, "cid long, n long, payload string")
        # rows that repeat a document come more than once
        return found.dropDuplicates(["cid"])

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        sketch = self.classes.select("cid", "n", F.col("registers").alias("payload"))
        near = stage(compare(pairs, sketch, *_estimated(self.percent)), "near")
        return compare(near, self.texts, *_exact(self.percent, self.words))

    def _rest(self, members: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of one bucket in different components."""
        sized = members.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select(
            "key", "cid", F.coalesce("component", "cid").alias("component")
        )
        counts = sized.groupBy("key", "component").agg(F.count("*").alias("c"))
        buckets = counts.groupBy("key").agg(
            F.max_by("component", F.struct("c", "component")).alias("main"),
            F.sum("c").alias("all"), F.max("c").alias("most"),
        ).filter("most < all")
        odd = F.col("all") - F.col("most")
        buckets = buckets.withColumn("dense", odd * F.col("all") > DENSE * (odd + F.col("all")))
        open_ = sized.join(buckets.select("key", "main", "dense"), "key")
        sizes = self.classes.select("cid", "n")
        open_ = stage(open_.join(sizes, "cid"), "open")
        pairs = self._across(open_.filter("NOT dense").select("key", "cid", "component", "n"))
        dense = open_.filter("dense")
        if dense.isEmpty():
            return pairs
        return pairs.unionByName(self._across(self._rare(dense))).distinct()

    def _across(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components that share a key and whose sizes allow a link."""
        counts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        main = counts.groupBy("key").agg(
            F.max_by("component", F.struct("c", "component")).alias("main")
        )
        b = rows.join(main, "key")  # members of the largest component meet the others only
        a = b.filter("component <> main")
        a, b = a.alias("a"), b.alias("b")
        cross = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component"))
        once = (F.col("b.component") == F.col("b.main")) | (F.col("a.cid") < F.col("b.cid"))
        low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
        fits = cross & once & (100 * low >= self.percent * high)
        if "place" in rows.columns:
            need = F.ceil(self.percent * (low + high) / (100 + self.percent))
            for side in ("a", "b"):
                fits &= F.col(f"{side}.place") <= F.col(f"{side}.n") - need + 1
        pairs = a.join(b, fits)
        return pairs.select(F.col("a.cid").alias("x"), F.col("b.cid").alias("y")).distinct()

    def _rare(self, dense: DataFrame) -> DataFrame:
        """(key, cid, component, n) where the key is one of a class's rarest shingles.

        With all shingles in one order, rare ones first, sets that share ``need`` of n
        share one of their first n - need + 1.  A link needs p / (100 + p) of both sizes
        together, and no partner is smaller than the least of the class's buckets.
        """
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in arrays.slices(batches, "payload"):
                value, at = shingles(part.column("payload"), words)
                cid = np.repeat(part.column("cid").to_numpy(), np.diff(at))
                yield pa.RecordBatch.from_pydict({"cid": cid, "key": arrays.signed(value)})

        floor = dense.groupBy("key").agg(F.min("n").alias("floor"))
        classes = dense.join(floor, "key").groupBy("cid", "component", "n")
        classes = stage(classes.agg(F.min("floor").alias("floor")), "dense")
        found = self.texts.join(classes.select("cid"), "cid")
        found = found.mapInArrow(run, "cid long, key long")
        held = found.groupBy("key").agg(F.count("*").alias("held"))
        order = Window.partitionBy("cid").orderBy("held", "key")  # one class's shingles
        ranked = found.join(held, "key").withColumn("place", F.row_number().over(order))
        partner = F.greatest("floor", F.ceil(F.col("n") * percent / 100))
        need = F.ceil(percent * (F.col("n") + partner) / (100 + percent))
        first = ranked.join(classes, "cid").filter(F.col("place") <= F.col("n") - need + 1)
        return first.filter("held > 1").select("key", "cid", "component", "n", "place")

    def result(self) -> DataFrame:
        """(a, b, n, least, tie): the least document of each set's group."""
        grouped = self.classes.join(self.groups.withColumnRenamed("node", "cid"), "cid", "left")
        grouped = grouped.withColumn("component", F.coalesce("component", "cid"))
        least = grouped.groupBy("component").agg(F.min(F.struct("_doc", "_tie")).alias("_key"))
        return grouped.join(least, "component").select(
            "a", "b", "n", F.col("_key._doc").alias("least"), F.col("_key._tie").alias("tie")
        )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    ship_package(docs.sparkSession)
    texts = keyed(docs.select("doc_id", "text")).select("_doc", "_tie", "text")
    run = _Groups(texts, words, percent)
    rows = run.sketches.select("_doc", "n", "a", "b").join(run.result(), ["a", "b", "n"], "left")
    group = F.coalesce("least", "_doc")
    real = lambda c: F.when(c != NO_ID, c)
    return rows.select(
        real(F.col("_doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real(group).alias("component_id"),
        (group == F.col("_doc")).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group, and all of its columns.

    Rows are told apart by id and text: of rows that share an id, those of other groups stay.
    The row of least id stays, null first, then of least hash of the text; of equal
    rows any one.  Texts without words are in no group and stay, each row of them.
    """
    ship_package(docs.sparkSession)
    name = lambda c: f"_doc_{c}"  # noqa: E731 - no column of the input can clash
    rows = keyed(docs.select(*[F.col(f"`{c}`").alias(name(c)) for c in docs.columns]), name("doc_id"), name("text"))
    run = _Groups(rows.select("_doc", "_tie", F.col(name("text")).alias("text")), words, percent)
    found = run.sketches.select("_doc", "_tie", "n", "a", "b").join(run.result(), ["a", "b", "n"])
    first = (F.col("_doc") == F.col("least")) & (F.col("_tie") == F.col("tie"))
    gone = found.filter(~first).select("_doc", "_tie").distinct()
    left = rows.join(stage(gone, "gone"), ["_doc", "_tie"], "left_anti")
    # rows that share id and text are one key
    again = found.filter(first).groupBy("_doc", "_tie").agg(F.count("*").alias("_n")).filter("_n > 1")
    again = stage(again.select("_doc", "_tie"), "repeated")
    once = left.join(again, ["_doc", "_tie"], "left_anti").select(*[name(c) for c in docs.columns])
    whole = F.first(F.struct(*[name(c) for c in docs.columns])).alias("_row")
    repeated = left.join(again, ["_doc", "_tie"]).groupBy("_doc", "_tie").agg(whole).select("_row.*")
    return once.unionByName(repeated).toDF(*docs.columns)
