"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sets with Jaccard similarity
of 0.75 or more differ in few elements for their sizes: with sizes a <= b at most (a + b) / 7,
which is at most a / 3. Sizes fall into bands; for the band of the smaller set the feature
domain is hashed into partitions, and the content of one partition is a signature. A partition
is spoilt only by an element in which two sets differ, so among the first H + 1 non-empty
partitions of a set, H being its bound on the difference, one has equal content in both: the
two share a signature. A set signs for its own band and, where a smaller partner could be
there, for the band below. A set whose elements fill too few partitions also signs its empty ones.

Sets that share a signature are checked: first by counts of their elements in 256 classes,
whose difference never exceeds that of the sets, then exactly on the elements. Signatures
may be shared by very many sets (copies with edits, common passages), so pairs are not listed:

1. the centre of a bucket is its smallest set; each set is checked against the centre it
   meets most often;
2. components of the links found so far are built; what is already connected needs no check;
3. in buckets of at most ``SMALL`` sets all pairs of different components are checked;
4. in larger buckets, only sets stay that have not enough other signatures to be found by
   them (each set signs some more partitions than needed, so common content rarely matters).
   They are checked against a few centres each, and those that still share a bucket with
   another component sign once more, each of their rarest elements being a partition: sets
   this similar share one of the rarest n / 4 + 1 elements of each, at places that leave
   enough elements behind for both sizes.

Equal sets are one set (64-bit sums of element hashes), so exact copies cost nothing more.

Defined results: null and wordless texts have an empty set and are linked with nothing; their
component is their own doc_id; a document without id takes part, and a group of only such
documents has a null component; rows that repeat a document fall into one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabbridge.llm.grouping import HotKeys, components, seen_before
from tabbridge.llm.staging import Scratch, released, result, scratch
from tabbridge.llm.words import FOLDED, Block, blocks, mix, shingles

SHINGLE = 5
SMALL = 8
CENTRES = 3
CLASSES = 256
SLICE_BITS = 12  # signatures go to the buckets in so many slices, by their first bits
PACK = 1 << 18  # and a task sends so many at a time
BATCH_BYTES = 2 << 20  # the JVM and the Python worker both hold a batch
_U = np.uint64


def _bands() -> np.ndarray:
    """First size of every band; each is 16/9 of the last, so only neighbours can join."""
    edges = [3]
    while edges[-1] < 1 << 40:
        edges.append(-(-edges[-1] * 16 // 9))
    return np.array(edges, np.int64)


BANDS = _bands()


class Sets:
    """The distinct shingles of a block's documents."""

    def __init__(self, block: Block):
        count = np.diff(block.bounds)
        hashes, at = shingles(block, SHINGLE)
        doc = np.searchsorted(block.bounds, at, side="right") - 1
        of_doc = np.append(0, np.cumsum(np.maximum(count - SHINGLE + 1, 0)))
        for d in np.flatnonzero(count > SHINGLE).tolist():
            hashes[of_doc[d] : of_doc[d + 1]].sort()
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            whole = [self._sequence(block.hash[block.bounds[d] : block.bounds[d + 1]]) for d in short]
            place = np.searchsorted(doc, short)
            hashes, doc = np.insert(hashes, place, np.array(whole, np.uint64)), np.insert(doc, place, short)
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        self.hash, self.doc = hashes[first], doc[first]
        self.size = np.bincount(self.doc, minlength=len(count)).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.id = np.zeros(len(count), np.int64)
        full = np.flatnonzero(self.size)
        if len(full):
            sums = np.add.reduceat(mix(self.hash), self.bounds[full])
            self.id[full] = mix(sums + self.size[full].astype(np.uint64)).view(np.int64)

    @staticmethod
    def _sequence(words: np.ndarray) -> int:
        """Of fewer words than a shingle has; told apart from every shingle by its length."""
        value = len(words)
        for word in words.tolist():
            value = (value * 0x9E3779B97F4A7C15 + word) % (1 << 64)
        return int(mix(np.array([value], np.uint64))[0])

    def classes(self) -> np.ndarray:
        """Elements of each set in each of CLASSES classes."""
        cell = self.doc * CLASSES + (self.hash >> _U(56)).astype(np.int64)
        return np.bincount(cell, minlength=len(self.size) * CLASSES).reshape(-1, CLASSES)

    def instances(self):
        """(docs, band, bound): the sets that sign for a band, and how much they may differ."""
        docs = np.flatnonzero(self.size >= BANDS[0])
        size = self.size[docs]
        own = np.searchsorted(BANDS, size, side="right") - 1
        yield docs, own, size // 3
        below = BANDS[own] - 1  # the largest size of the band below
        able = (own > 0) & (4 * below >= 3 * size)
        yield docs[able], own[able] - 1, (size[able] + below[able]) // 7

    def signatures(self):
        """(docs, band, spare, signature, its doc) for each kind of instance.

        ``spare`` is how many signatures of a set may lie in large buckets before it can
        miss a partner in the others.
        """
        element = mix(self.hash ^ _U(0x5851F42D4C957F2D))
        mixed = mix(element)
        halves = (mixed & _U(0xFFFFFFFF)).astype(float), (mixed >> _U(32)).astype(float)
        for docs, band, bound in self.instances():
            slack = 2 + BANDS[band] // 12
            parts = 12 + -(-BANDS[band] * 7 // 10)
            of_doc = np.full(len(self.size), -1, np.int64)
            of_doc[docs] = np.arange(len(docs))
            mine = of_doc[self.doc]
            rows = mine >= 0
            mine = mine[rows]
            part = ((element[rows] >> _U(32)) * parts[mine].astype(np.uint64)) >> _U(32)
            # the partitions of all sets, one after the other; sums of 32-bit halves are exact in doubles
            before = np.append(0, np.cumsum(parts))
            cell = before[mine] + part.astype(np.int64)
            low, high = (np.bincount(cell, x[rows], before[-1]).astype(np.uint64) for x in halves)
            cell = np.flatnonzero(np.bincount(cell, minlength=before[-1]))
            content = low[cell] + (high[cell] << _U(32))
            of = np.repeat(np.arange(len(docs)), parts)[cell]
            cell -= before[of]
            filled = np.bincount(of, minlength=len(docs))
            rank = np.arange(len(of)) - (np.cumsum(filled) - filled)[of]
            signed = rank < (bound + 1 + slack)[of]
            code = ((band[of] << 40) | cell).astype(np.uint64)[signed]
            signature, signer = mix(content[signed] + mix(code)), of[signed]
            for k in np.flatnonzero(filled <= bound):
                empty = np.setdiff1d(np.arange(parts[k]), cell[of == k])
                code = (_U(int(band[k])) << _U(40)) | empty.astype(np.uint64)
                signature = np.concatenate([signature, mix(mix(code) ^ _U(0xA5A5A5A5))])
                signer = np.concatenate([signer, np.full(len(empty), k)])
            # the last bit tells the two bands a set signs for apart
            signature = (signature & ~_U(1)) | (band[signer] & 1).astype(np.uint64)
            spare = np.minimum(filled, bound + 1 + slack) - bound - 1
            yield docs, band, spare, signature, docs[signer]


_PROFILE = "tie long, n_shingles long, id long, odd int, own_spare int, low_spare int, classes binary"


def _profiles(batches, packed: Packed | None = None):
    """A row of each document; the signatures of its set go to ``packed``."""
    known = set()
    for batch in batches:
        parts = []
        for block in blocks(batch.column("text"), FOLDED):
            sets = Sets(block)
            n = len(sets.size)
            spare, odd = np.zeros((2, n), np.int32), np.zeros(n, np.int32)
            fresh = None if packed is None else ~seen_before(known, sets.id)
            for kind, (docs, band, left, signature, doc) in enumerate(sets.signatures()):
                spare[kind, docs] = left
                if kind == 0:
                    odd[docs] = band & 1
                if packed is not None:
                    new = fresh[doc]
                    packed.add(signature[new], sets.id[doc[new]])
            wide = np.minimum(sets.classes(), 255).astype(np.uint8)
            parts.append((sets.size, sets.id, odd, spare[0], spare[1], [row.tobytes() for row in wide]))
        columns = [np.concatenate(c) if i < 5 else sum(c, []) for i, c in enumerate(zip(*parts))] or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        arrays = [batch.column("doc_id"), batch.column("tie"), *[pa.array(c, t) for c, t in zip(columns, kinds)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[x.split()[0] for x in _PROFILE.split(", ")]])


class Packed:
    """Signatures and their sets on the way to the buckets, many in a row.

    A row holds those of one slice of the signatures' range; a salted one (see ``HotKeys``)
    only those beyond the limit.
    """

    def __init__(self):
        self.hot, self.held, self.n = HotKeys(), [], 0

    def add(self, signatures: np.ndarray, ids: np.ndarray) -> None:
        self.held.append(self.hot.route(signatures, ids))
        self.n += len(self.held[-1][0])

    def rows(self) -> dict[str, pa.Array]:
        """Columns slice, salt, keys and ids of what has been added since the last call."""
        keys, salts, ids = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        # the salt of a task is always the same
        place = (keys >> _U(64 - SLICE_BITS)).astype(np.uint16) | ((salts > 0).astype(np.uint16) << np.uint16(SLICE_BITS))
        order = np.argsort(place, kind="stable")
        many = np.bincount(place, minlength=2 << SLICE_BITS)
        full = np.flatnonzero(many)
        ends = pa.py_buffer(np.append(0, 8 * np.cumsum(many[full])).astype(np.int32))
        keys, ids = (pa.Array.from_buffers(pa.binary(), len(full), [None, ends, pa.py_buffer(x[order])]) for x in (keys, ids))
        salt = np.where(full >> SLICE_BITS, self.hot.salt, 0).astype(np.int32)
        return {"slice": pa.array((full & ((1 << SLICE_BITS) - 1)).astype(np.int32)), "salt": pa.array(salt), "keys": keys, "ids": ids}


def _filled(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of all columns of ``schema``; those not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_SIGNED = "slice int, salt int, keys binary, ids binary"
_FOUND = "key long, centre long, large boolean"


@released
def _profile_and_sign(batches):
    """Profile rows, dealt over all slices below 0, and rows of packed signatures."""
    packed, schema = Packed(), None
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for batch in _profiles(batches, packed):
        if schema is None:
            schema = pa.schema([*batch.schema, *[(x.split()[0], t) for x, t in zip(_SIGNED.split(", "), kinds)]])
        n = len(batch)
        spread = {"slice": pa.array(-1 - np.arange(n, dtype=np.int32) % (1 << SLICE_BITS)), "salt": pa.array(np.zeros(n, np.int32))}
        yield _filled(dict(zip(batch.schema.names, batch.columns)) | spread, schema)
        if packed.n >= PACK:
            yield _filled(packed.rows(), schema)
    if packed.n:
        yield _filled(packed.rows(), schema)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit values of all rows of a binary column, and where each row starts."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.int64, (ends[-1] - ends[0]) // 8, ends[0]), (ends - ends[0]) // 8


def _bucket_rows(key: np.ndarray, id: np.ndarray, salted: bool) -> dict[str, pa.Array]:
    """Columns key, id, centre and large of the keys with several sets."""
    order = np.argsort(key)
    key, id = key[order], id[order]
    again = key[1:] == key[:-1]
    shared = np.append(False, again) | np.append(again, False)
    key, id = key[shared], id[shared]
    order = np.lexsort((id, key))
    key, id = key[order], id[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (id[1:] != id[:-1]))[: len(key)]
    key, id = key[fresh], id[fresh]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.diff(np.append(start, len(key)))
    columns = key, id, np.repeat(id[start], n), np.repeat((n > SMALL) | salted, n)
    several = np.repeat(n > 1, n)
    return dict(zip(("key", "id", "centre", "large"), (pa.array(x[several]) for x in columns)))


@released
def _buckets(batches):
    """Profile rows as they are, and rows (key, id, centre, large) of the buckets with several sets.

    Rows come in order of slice and salt; a task holds the signatures of one slice.
    """
    open_slice, held, schema = None, [], None

    def close():
        key, id = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return _filled(_bucket_rows(key, id, open_slice[1] > 0), schema)

    for batch in batches:
        if schema is None:
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            profile = batch.schema.names[: -len(_SIGNED.split(", "))]
            schema = pa.schema([*[batch.schema.field(x) for x in profile], *[(x.split()[0], t) for x, t in zip(_FOUND.split(", "), kinds)]])
        signed = batch.column("slice").to_numpy() >= 0
        if not signed.all():
            rows = batch.filter(pa.array(~signed))
            yield _filled({x: rows.column(x) for x in profile}, schema)
            batch = batch.filter(pa.array(signed))
        if not len(batch):
            continue
        place, salt = batch.column("slice").to_numpy(), batch.column("salt").to_numpy()
        (keys, at), (ids, _) = _values(batch.column("keys")), _values(batch.column("ids"))
        start = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (salt[1:] != salt[:-1])))
        for lo, hi in zip(start, np.append(start[1:], len(batch))):
            name = int(place[lo]), int(salt[lo])
            if held and name != open_slice:
                yield close()
            open_slice = name
            held.append((keys[at[lo] : at[hi]].copy(), ids[at[lo] : at[hi]].copy()))
    if held:
        yield close()


@released
def _pack(batches):
    """(id, elements) of the texts whose set is the one asked for."""
    for batch in batches:
        asked, ids, packed = batch.column("id").to_numpy(), [], []
        for block in blocks(batch.column("text"), FOLDED):
            sets = Sets(block)
            for d in np.flatnonzero(sets.id == asked[block.first_doc : block.first_doc + len(sets.id)]):
                ids.append(int(sets.id[d]))
                packed.append(sets.hash[sets.bounds[d] : sets.bounds[d + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["id", "elements"])


def _list(batches):
    for batch in _pack(batches):
        found = [np.frombuffer(x, np.int64) for x in batch.column("elements").to_pylist()]
        column = pa.array(found, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), column], names=["id", "elements"])


def _near(size_a, size_b, common):
    return 100 * common >= 75 * (size_a + size_b - common)


@released
def _by_classes(batches):
    """Pairs whose class counts do not rule them out."""
    for batch in batches:
        one, two = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int64) for c in ("c1", "c2")
        )
        n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
        differ = np.abs(one - two).sum(1)  # cut counts only make this smaller
        yield batch.filter(pa.array(_near(n1, n2, (n1 + n2 - differ) / 2))).select(["a", "b"])


@released
def _by_elements(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(_near(len(one), len(two), common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _texts(ids: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, text) of one document for each set id."""
    texts = ids.join(sets.select("id", "doc_id", "tie"), "id").select("id", "doc_id", "tie")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    same = rows["doc_id"].eqNullSafe(texts["doc_id"]) & (rows["tie"] == texts["tie"])
    return rows.join(texts, same).select("id", "text")


def _by_rarest(ids: DataFrame, labels: DataFrame, docs: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """Pairs of different components that share one of the rarest elements of both.

    Sets of n and m elements need ceil(3 (n + m) / 7) common ones, and an element at place p of
    n, rarest first, has only n - p others behind it. The rarest common element of two similar
    sets therefore tells by its place in one how large the other may be, its ``reach``.
    """
    lists = _texts(ids, docs, sets).mapInArrow(_list, "id long, elements array<long>").dropDuplicates(["id"])
    rows = tables.put(lists.select("id", F.size("elements").alias("n"), F.explode("elements").alias("key")))
    common = rows.groupBy("key").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "key")
    first = rows.join(common.where("df > 1"), "key").withColumn("unique", F.col("n") - F.count("*").over(Window.partitionBy("id")))
    first = first.withColumn("place", F.col("unique") + F.row_number().over(order)).where("place <= floor(n / 4) + 1")
    placed = tables.put(_placed(first.selectExpr("id", "n", "key", "7 * (n - place + 1) div 3 - n AS reach"), labels))
    tables.drop(rows)
    return _within_reach(placed)


def _size_band(size: str) -> str:
    return f"cast(floor(ln({size}) * 20) AS int)"


def _within_reach(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components with a common key, each of a size in the other's reach.

    Both sets of a pair list the bands its sizes can lie in, so sets that only share the key
    do not meet. Sets of a key's most frequent component only meet those outside it.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    most = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.count("*").alias("k"))
    rows = placed.join(most.where("k > 1"), "key").withColumn("often", F.col("component") == F.col("most"))
    small = rows.where("reach >= n").selectExpr(
        "key", "id", "n", "reach", "component", f"{_size_band('n')} AS small",
        f"explode(sequence({_size_band('n')}, {_size_band('least(reach, 4 * n div 3)')})) AS large", "often",
    ).withColumn("sides", F.explode(F.expr("if(often, array(1), array(2, 3))")))
    large = rows.where("4 * reach >= 3 * n").selectExpr(
        "key", "id AS id2", "n AS n2", "reach AS reach2", "component AS component2", f"{_size_band('n')} AS large",
        f"explode(sequence({_size_band('(3 * n + 3) div 4')}, {_size_band('least(reach, n)')})) AS small", "often",
    ).withColumn("sides", F.explode(F.expr("if(often, array(2), array(1, 3))")))
    alike = "component <> component2 and (n < n2 or n = n2 and id < id2) and n2 <= reach and n <= reach2 and 4 * n >= 3 * n2"
    return (
        small.drop("often").join(large.drop("often"), ["key", "small", "large", "sides"]).where(alike)
        .select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()
    )


def _check(pairs: DataFrame, docs: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """The pairs (a, b) of set ids that are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("classes").alias("c1"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("classes").alias("c2"))
    likely = tables.put(pairs.join(one, "a").join(two, "b").mapInArrow(_by_classes, "a long, b long"))
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    packed = tables.put(_texts(wanted, docs, sets).mapInArrow(_pack, "id long, elements binary").dropDuplicates(["id"]))
    x = packed.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    y = packed.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    linked = tables.put(likely.join(y, "b").join(x, "a").mapInArrow(_by_elements, "a long, b long"))
    tables.drop(likely, packed)
    return linked


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _joined(labels: DataFrame, links: DataFrame, tables: Scratch) -> DataFrame:
    """The labels after more links: only the components they touch are worked on."""
    if not links.limit(1).count():
        return labels
    of_a = labels.select(F.col("id").alias("a"), F.col("component").alias("a1"))
    of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("b1"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("a1", "a").alias("a"), F.coalesce("b1", "b").alias("b")
    )
    moved = components(between, tables).select(F.col("id").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = moved.join(labels.select(F.col("id").alias("component")), "component", "left_anti")
    return tables.put(old.unionByName(new.select(F.col("component").alias("id"), F.col("to").alias("component"))))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows (key, id, component) of the buckets with several components."""
    mixed = rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
    return rows.join(mixed.select("key"), "key")


def ngram_groups(docs: DataFrame, tables: Scratch) -> DataFrame:
    """doc_id, tie, n_shingles, component and component_id of every row of ``docs``.

    ``component`` tells groups apart, also those without any doc_id; it is null for empty sets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    signed = rows.mapInArrow(_profile_and_sign, f"doc_id {kind}, {_PROFILE}, {_SIGNED}")
    dealt = signed.repartition("slice", "salt").sortWithinPartitions("slice", "salt")
    found = tables.put(dealt.mapInArrow(_buckets, f"doc_id {kind}, {_PROFILE}, {_FOUND}"))
    profiles = found.where("large IS NULL").drop("key", "centre", "large")
    buckets = found.where("large IS NOT NULL").select("key", "id", "centre", "large")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie"))
    sets = tables.put(
        profiles.where("n_shingles >= 3")
        .groupBy("id")
        .agg(
            first.alias("f"), F.max("n_shingles").alias("n"), F.max("odd").alias("odd"), F.max("own_spare").alias("own_spare"),
            F.max("low_spare").alias("low_spare"), F.max("classes").alias("classes"),
        )
        .select("id", "f.doc_id", "f.tie", "n", "odd", "own_spare", "low_spare", "classes")
    )

    met = buckets.where("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("n"))
    often = met.groupBy("id").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    pairs = often.select(F.greatest("centre", "id").alias("a"), F.least("centre", "id").alias("b")).distinct()
    labels = components(_check(pairs, docs, sets, tables), tables)

    small = tables.put(_apart(_placed(buckets.where("not large").select("key", "id"), labels)))
    other = small.select("key", F.col("id").alias("id2"), F.col("component").alias("component2"))
    cross = (
        small.join(other, "key").where("id > id2 and component <> component2")
        .select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    )
    labels = _joined(labels, _check(cross, docs, sets, tables), tables)
    tables.drop(small)

    large = buckets.where("large").select("key", "id").distinct()
    own = (F.col("key").bitwiseAND(F.lit(1)) == F.col("odd")).alias("own")
    signed = large.join(sets.select("id", "odd", "own_spare", "low_spare"), "id").withColumn("own", own)
    spare = F.when(F.col("own"), F.first("own_spare")).otherwise(F.first("low_spare"))
    missing = signed.groupBy("id", "own").agg(F.count("*").alias("n"), spare.alias("spare")).where("n > spare")
    left = tables.put(signed.join(missing.select("id", "own"), ["id", "own"]).select("key", "id"))
    for centres_each in (CENTRES, 2 * CENTRES):
        apart = tables.put(_apart(_placed(left, labels)))
        # centres of the bucket's largest component: the pairs are those outside it
        sizes = apart.groupBy("key", "component").agg(F.count("*").alias("m"))
        most = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.max("m").alias("m"))
        slot = F.pmod(F.xxhash64("id"), F.lit(centres_each)).alias("slot")
        able = apart.join(most, "key").where("m = 1 or component = most")
        centres = able.groupBy("key", slot).agg(F.min_by("component", "id").alias("c1"), F.min("id").alias("centre"))
        pairs = (
            apart.join(centres, "key").where("component <> c1")
            .select(F.greatest("centre", "id").alias("a"), F.least("centre", "id").alias("b")).distinct()
        )
        labels = _joined(labels, _check(pairs, docs, sets, tables), tables)
        tables.drop(apart)
    rest = tables.put(_apart(_placed(left, labels)).select("id").distinct())
    tables.drop(left)
    labels = _joined(labels, _check(_by_rarest(rest, labels, docs, sets, tables), docs, sets, tables), tables)

    firsts = profiles.where("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    grouped = _placed(firsts, labels)
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = tables.put(grouped.select("id", "component").join(named, "component"))
    return profiles.join(of_set, "id", "left").select(
        "doc_id", "tie", "n_shingles", "component",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    with scratch(docs.sparkSession, "ngrams", maxBytesPerBatch=BATCH_BYTES) as tables:
        groups = ngram_groups(docs, tables)
        return result(groups.select("doc_id", "n_shingles", "component_id"), "ngrams")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of each group, and one row of repeated ones.

    Only the ids that stay are staged; the rows are taken from ``docs`` when they are read.
    """
    names = docs.columns
    with scratch(docs.sparkSession, "ngrams", maxBytesPerBatch=BATCH_BYTES) as tables:
        groups = ngram_groups(docs, tables)
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
        alone = F.when(F.col("component").isNull(), F.struct("doc_id", "tie"))
        group = [F.col("component"), alone.alias("alone")]
        kept = groups.groupBy(*group).agg(F.min(place).alias("p")).select(
            F.col("p.doc_id").alias("kept_id"), F.coalesce("p.tie", F.lit(0)).alias("kept_tie")
        ).distinct()
        kept = result(kept, "ngrams")
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
        F.col("doc_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"),
    )
    same = rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["tie"] == kept["kept_tie"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "tie"]).select("row.*")
