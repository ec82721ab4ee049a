"""MinHash near-duplicates by an inverted join on signature coordinates.

A text's shingle set is signed by COORDINATES minima.  Texts of equal sets form a class.  Each class is
posted under the (coordinate, value) pairs of its prefix: of COORDINATES entries, in one global order from
rare to common, the first COORDINATES - MATCHES + 1.  Two signatures that agree in MATCHES coordinates
share a posting there, whatever the order is (prefix merging).  Postings are apart by powers of 4 of the
sets' sizes; a set that a link could take over the next power is posted on both sides.

Inside a posting, members are not paired with each other but measured against its hub, the member whose
entries collide most overall, by the number of coordinates in which packed signatures differ.  That
number is a metric, so it sorts members into rings about the hub: the members of its inner ring are its
family, and two members whose rings aren't neighbours can't be linked.  Members outside the inner ring
are measured against a second hub, chosen among them.  Only members whose rings leave room for a link are
compared with each other (skip merging), so a large group of near copies costs one comparison a member.
Linked texts are always of one family.

Full sets decide within families.  First each member is confirmed with its hub.  If a family is not one
component then, its members outside the largest component are compared with all others in blocks of
bounded size: a task counts the shingles that two blocks share through a sorted list of one, and returns
only links that connect what was apart, never the pairs it compared.

Defined cases.  A null or empty text, or one without words, has an empty set, links with nothing and is
its own component.  A text with fewer words than a shingle has its whole sequence as one shingle.
Repeated rows have equal sets and meet in one class; rows of one id and unequal texts are linked each by
its own text.  A row of null id takes part with its text and has the id of its component like the others;
a component without any id has a null one.  `kept` holds where the row's id is its component's: for each
row of null id in a component without ids, and for no other.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import bytetext
from tabwarden.llm.components import connected_components
from tabwarden.llm.tables import written

COORDINATES = 64
#: Of 64 coordinates, each equal with probability 0.8, fewer than 36 are equal once in a million pairs.
MATCHES = 36
#: The packed signature has 4 bits a coordinate; equal sets agree in 64, unrelated ones in about 4.
PACKED_MATCHES = 38
PACKS = 4
PACK = tuple(f"s{i}" for i in range(PACKS))
#: Shingles in a block of a family, on average; a task holds two blocks.
BLOCK = 1 << 18
#: Slots of the bitmap of texts that are wanted once more.
BITS = 1 << 23
#: Entries of the table of collision counts that orders the coordinates.
SKETCH = 1 << 20

_A = bytetext.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_X = bytetext.mix(np.arange(101, COORDINATES + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signature(distinct: np.ndarray) -> np.ndarray:
    return np.min((distinct[:, None] ^ _X) * _A, axis=0)


def _slots(signature: np.ndarray) -> np.ndarray:
    """The sketch entry of each (coordinate, value)."""
    return (bytetext.mix(signature + np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(SKETCH - 1)).astype(np.int64)


def _packed(signature: np.ndarray) -> np.ndarray:
    """Four bits of each minimum: 16 coordinates in each of PACKS words, for rows of signatures."""
    bits = (bytetext.mix(signature) & np.uint64(15)).reshape(-1, PACKS, 16)
    return np.bitwise_or.reduce(bits << (4 * np.arange(16, dtype=np.uint64)), axis=2).view(np.int64)


def _sets(batch: pa.RecordBatch, shingle_words: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, last, raw, offsets in bytetext.chunks(batch.column("text")):
        hashes, begin = bytetext.words(raw, offsets).shingles(shingle_words)
        for i in range(last - first):
            yield first + i, np.unique(hashes[begin[i] : begin[i + 1]])


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, text_id, text) -> (doc_id, text_id, n_shingles, set_id binary, signature array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            ids: list[bytes | None] = [None] * batch.num_rows
            signed = np.zeros((batch.num_rows, COORDINATES), dtype=np.uint64)
            for i, distinct in _sets(batch, shingle_words):
                sizes[i] = len(distinct)
                if len(distinct):
                    ids[i] = hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()
                    signed[i] = _signature(distinct)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * COORDINATES), pa.array(signed.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(sizes), pa.array(ids, type=pa.binary()), flat], names=["doc_id", "text_id", "n_shingles", "set_id", "signature"])

    return docs.mapInArrow(run, "doc_id long, text_id binary, n_shingles long, set_id binary, signature array<long>")


def _sketch(classes: DataFrame) -> np.ndarray:
    """Postings counted by sketch entry, over all classes: at most SKETCH rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            flat = batch.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, COORDINATES)
            counts += np.bincount(_slots(flat).ravel(), minlength=SKETCH)
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 1 << 16):
            part = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])

    found = classes.select("signature").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.ones(SKETCH, dtype=np.int32)
    rows = found.select("slot", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _coded(spark: SparkSession, classes: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """(prio, node, n, s0 to s3, keys) of each class: keys are those of its prefix.

    prio stands for the class in postings.  It leads with the class's collisions over all coordinates, so a
    posting's largest prio is its hub, and ends in a hash of its set; classes of equal prio are each a hub.
    """
    shared = spark.sparkContext.broadcast(sketch)
    prefix = COORDINATES - MATCHES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            nodes, sizes, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "mark"))
            flat = batch.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, COORDINATES)
            for at in range(0, len(nodes), 2048):
                sign = flat[at : at + 2048]
                entries = bytetext.mix(sign + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                common = counts[_slots(sign)]
                # one total order for all classes: by count, then by the entry's own hash
                order = np.lexsort((entries, common), axis=1)[:, :prefix]
                rare = np.take_along_axis(entries, order, axis=1)
                size = sizes[at : at + 2048]
                power = np.int64(np.log2(size + 0.5)) // 2  # 4 ** power <= size < 4 ** (power + 1)
                both = size * 100 >= percent << 2 * (power + 1)
                keys = np.concatenate([bytetext.mix(rare + p.astype(np.uint64)[:, None]) for p in (power, power + 1)], axis=1)
                # an entry that the sketch counts once is in no other class's posting
                shared_keys = np.take_along_axis(common, order, axis=1) > 1
                shared_keys = np.concatenate([shared_keys, shared_keys & both[:, None]], axis=1)
                ends = np.append(0, np.cumsum(shared_keys.sum(axis=1))).astype(np.int32)
                weight = (np.log2(common).sum(axis=1) * 4).astype(np.uint64)
                prio = ((weight << np.uint64(50)) | (marks[at : at + 2048].view(np.uint64) >> np.uint64(14))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[shared_keys].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prio), pa.array(nodes[at : at + 2048]), pa.array(size), *(pa.array(x) for x in _packed(sign).T), lists],
                    names=["prio", "node", "n", *PACK, "keys"],
                )

    marked = classes.select("node", "n", "signature", F.xxhash64("set_id").alias("mark"))
    return marked.mapInArrow(run, f"prio long, node long, n long, {', '.join(f'{c} long' for c in PACK)}, keys array<long>")


def _differing(a: str, b: str) -> Column:
    """In how many coordinates packed signatures differ; columns with prefixes a and b."""
    low = F.lit(0x1111111111111111)
    unequal = F.lit(0)
    for c in PACK:
        x = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    return unequal


def _fit(a: str, b: str, percent: int) -> Column:
    """Sizes leave room for the similarity."""
    return F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent


def _passing(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` may be among the wanted ones: what a bitmap of fixed size lets pass before a shuffle."""
    slot = F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int").alias("slot")
    bits = np.zeros(BITS, dtype=bool)
    bits[wanted.select(slot).distinct().toArrow()["slot"].to_numpy()] = True  # at most BITS slots
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.drop_columns(["slot"]).filter(pa.array(shared.value[batch.column("slot").to_numpy()]))

    return rows.select("*", slot).mapInArrow(run, rows.schema)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(node, hubs, is_hub, shingles) of the wanted classes (node, doc_id, text_id, hubs, is_hub), from the texts of the rows that stand for them.

    Texts pass a bitmap of the wanted ones before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: list[tuple[int, np.ndarray]] = []

            def out(some=some, batch=batch):
                values = np.concatenate([s for _, s in some]).view(np.int64)
                ends = np.cumsum([0, *(len(s) for _, s in some)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                rows = pa.array([i for i, _ in some])
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("node", "hubs", "is_hub")), lists], names=["node", "hubs", "is_hub", "shingles"])

            total = 0
            for i, distinct in _sets(batch, shingle_words):
                some.append((i, distinct))
                total += len(distinct)
                if total > 1 << 20:
                    yield out()
                    some.clear()
                    total = 0
            if some:
                yield out()

    texts = _passing(docs.where("text IS NOT NULL"), wanted, "text_id")
    w = wanted.select("node", "hubs", "is_hub", F.col("doc_id").alias("w_id"), F.col("text_id").alias("w_text"))
    joined = texts.join(w, texts["doc_id"].eqNullSafe(w["w_id"]) & (texts["text_id"] == w["w_text"]))
    once = joined.groupBy("node").agg(F.first("hubs").alias("hubs"), F.first("is_hub").alias("is_hub"), F.first("text").alias("text"))
    return once.mapInArrow(run, "node long, hubs array<long>, is_hub boolean, shingles array<long>")


def _confirm(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes and their hubs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_ids, b_ids = batch.column("a"), batch.column("b")
            keep = []
            a_sets, b_sets = batch.column("a_set"), batch.column("b_set")
            for i in range(batch.num_rows):
                x, y = (s[i].values.to_numpy(zero_copy_only=False) for s in (a_sets, b_sets))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a_ids.take(pa.array(keep, pa.int64())), b_ids.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    members = sets.select(F.explode("hubs").alias("a"), F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    hubs = sets.where("is_hub").select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    sizes_fit = F.least(F.size("a_set"), F.size("b_set")) * 100 >= F.greatest(F.size("a_set"), F.size("b_set")) * percent
    return members.join(hubs, "a").where(sizes_fit).mapInArrow(run, "a long, b long")


def _measured(members: DataFrame, codes: DataFrame, name: str) -> DataFrame:
    """Postings (key, prio) of two members or more, with codes, their number, the hub's node and `name`, the ring about it."""
    hubs = members.groupBy("key").agg(F.max("prio").alias("hub"), F.count("*").alias("members")).where("members > 1")
    coded = hubs.join(codes.select(F.col("prio").alias("hub"), F.col("node").alias("h_node"), *(F.col(c).alias(f"h_{c}") for c in PACK)), "hub")
    joined = members.join(coded, "key").join(codes, "prio").withColumn("apart", _differing("", "h_"))
    # a ring is as wide as two linked signatures may differ, so links are within a ring or between neighbours
    return joined.withColumn(name, F.expr(f"apart div {COORDINATES - PACKED_MATCHES + 1}").cast("int"))


def _families(coded: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of hubs with members like them, and (node, root) of families: all pairs of like signatures are within one."""
    code = ("node", "n", *PACK)
    codes = coded.select("prio", *code)
    every = coded.select(F.explode("keys").alias("key"), "prio")
    # first hubs: an inner member (ring 0) is done with, but for members of the next ring
    first = written(_measured(every, codes, "ring").select("key", "prio", *code, "ring", "h_node", "members"), "postings")
    rest = first.where("ring > 0")
    second = written(_measured(rest.select("key", "prio"), codes, "ring2").select("key", *code, "ring2", "h_node", "members"), "postings")
    near = lambda t, ring: t.where((F.col(ring) == 0) & (F.col("node") != F.col("h_node"))).select(F.col("h_node").alias("a"), F.col("node").alias("b"))
    to_hub = written(near(first, "ring").unionByName(near(second, "ring2")).distinct(), "pairs")
    # cells of a posting: 0, the inner members of the first hub, and 1 to 3, the others by their ring about
    # the second; a member looks into those that may hold one like it, and of two neighbours the outer looks.
    # Two members alone, one of them the hub, have met already
    none = F.lit(None).cast("int")
    edge, more = rest.where("ring = 1 AND members > 2"), second.where("members > 2")
    x = edge.select("key", *code, none.alias("own"), F.lit(0).alias("cell"))
    x = x.unionByName(more.where("ring2 > 0").select("key", *code, (F.col("ring2") + 1).alias("own"), F.explode(F.array(F.col("ring2"), F.col("ring2") + 1)).alias("cell")))
    y = _passing(first.where("ring = 0").select("key", *code), edge, "key").withColumn("cell", F.lit(0))
    y = y.unionByName(more.select("key", *code, (F.col("ring2") + 1).alias("cell")))
    x, y = (t.select("key", "cell", *(F.col(c).alias(p + c) for c in t.columns if c not in ("key", "cell"))) for t, p in ((x, "x_"), (y, "y_")))
    once = F.col("x_own").isNull() | (F.col("cell") != F.col("x_own")) | (F.col("x_node") > F.col("y_node"))
    like = _fit("x_", "y_", percent) & (_differing("x_", "y_") <= COORDINATES - PACKED_MATCHES)
    met = x.join(y, ["key", "cell"]).where(once & (F.col("x_node") != F.col("y_node")) & like)
    pairs = to_hub.unionByName(met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))
    return to_hub, written(connected_components(pairs), "families")


def _stars(parts: DataFrame) -> DataFrame:
    return parts.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _linking(left: list[np.ndarray], right: list[np.ndarray], label: np.ndarray, same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets of `left` and `right` (`same`: within left) that join labels; label: of left, then of right."""
    sizes = np.array([len(s) for s in right])
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), sizes)[order]
    label = label.copy()
    of_right = label if same else label[len(left) :]
    for i, s in enumerate(left):
        if (of_right == label[i]).all():
            continue
        low, high = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        linked = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (of_right != label[i]))
        if len(linked):
            met, first = np.unique(of_right[linked], return_index=True)
            yield from ((i, int(linked[j])) for j in first)
            label[np.isin(label, met)] = label[i]


def _within_families(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join components `own` of members (node, family, own, n) of one family, found in blocks."""

    def run(key, table):
        table = table.combine_chunks()
        nodes = table["node"].to_numpy()
        label = np.unique(table["own"].to_numpy(), return_inverse=True)[1]
        side = table["is_left"].to_numpy(zero_copy_only=False)
        lists = table["shingles"].combine_chunks()
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        found: tuple[list, list] = ([], [])
        x, y = np.flatnonzero(side), np.flatnonzero(~side)
        same = key[1].as_py() == key[2].as_py()
        if same:
            y = x
        if len(x) and len(y):
            left, right = ([flat[ends[k] : ends[k + 1]] for k in rows] for rows in (x, y))
            for i, j in _linking(left, right, label[x] if same else label[np.concatenate([x, y])], same, percent):
                found[0].append(nodes[x[i]])
                found[1].append(nodes[y[j]])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    by_own = members.groupBy("family", "own").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    by_family = by_own.groupBy("family").agg(F.max(F.struct("count", "n", "own")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("owns")).where("owns > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = by_family.select("family", F.col("main.own").alias("main"), blocks(F.col("main.n")).alias("main_blocks"), blocks(F.col("n") - F.col("main.n")).alias("rest_blocks"))
    dealt = members.join(split, "family").withColumn("in_main", F.col("own") == F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    # tasks (i, j): blocks i <= j of the rest, or block i of the rest and block -1-j of the main component
    to_main = F.expr("transform(sequence(0, main_blocks - 1), k -> struct(block AS i, -1 - k AS j, true AS is_left))")
    to_rest = F.expr("transform(sequence(0, rest_blocks - 1), k -> struct(least(block, k) AS i, greatest(block, k) AS j, block <= k AS is_left))")
    of_main = F.expr("transform(sequence(0, rest_blocks - 1), k -> struct(k AS i, -1 - block AS j, false AS is_left))")
    tasks = dealt.select("family", "node", "own", F.explode(F.when(F.col("in_main"), of_main).otherwise(F.concat(to_main, to_rest))).alias("t"))
    tasks = written(tasks.select("family", "node", "own", "t.*"), "tasks")
    rows = tasks.join(_passing(sets.select("node", "shingles"), tasks, "node"), "node")
    return rows.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of `docs`.

    Texts are linked when 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id reachable over links, and a row is kept if that is its own.  Ids are integers.
    `percent` under 80 would need a lower MATCHES.
    """
    if percent < 80:
        raise ValueError("the prefix is made for a similarity of 0.8 or more")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_id"), text.alias("text"))
    signed = written(signatures(named, shingle_words), "signatures")
    # a class's smallest id stands for it, a null one if there is no other; its number is made once, as the table is written
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", F.col("n_shingles").alias("n"), "signature")
    classes = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(member).alias("m"))
    classes = written(classes.select("set_id", "m.doc_id", "m.text_id", "m.n", "m.signature", F.monotonically_increasing_id().alias("node")), "classes")
    coded = written(_coded(spark, classes, _sketch(classes), percent), "coded")
    to_hub, families = _families(coded, percent)
    # what each class is compared with first: its hubs, 2 a posting at most
    hubs = to_hub.groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("hubs"))
    is_hub = to_hub.select(F.col("a").alias("node"), F.lit(True).alias("is_hub")).distinct()
    wanted = classes.select("node", "doc_id", "text_id").join(families.select("node"), "node").join(hubs, "node", "left").join(is_hub, "node", "left")
    wanted = written(wanted.select("node", "doc_id", "text_id", F.coalesce("hubs", F.array().cast("array<long>")).alias("hubs"), F.coalesce("is_hub", F.lit(False)).alias("is_hub")), "wanted")
    sets = written(_shingle_sets(named, wanted, shingle_words), "sets")
    links = written(_confirm(sets, percent), "links")
    parts = written(connected_components(links), "components")
    members = families.select("node", F.col("root").alias("family")).join(parts.withColumnRenamed("root", "own"), "node", "left").join(classes.select("node", "n"), "node")
    members = written(members.select("node", "family", F.coalesce("own", "node").alias("own"), "n"), "members")
    more_links = written(_within_families(members, sets, percent), "links")
    if more_links.head(1):
        parts = written(connected_components(_stars(parts).unionByName(more_links)), "components")
    # a component's id is the smallest of its classes' ids
    grouped = parts.join(classes.select("node", "doc_id"), "node")
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = parts.join(least, "root").select("node", "component_id", F.lit(True).alias("linked"))
    by_set = classes.select("set_id", "node", "doc_id").join(linked, "node", "left").select("set_id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    own = signed.where("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = signed.where("set_id IS NOT NULL").select("doc_id", "n_shingles", "set_id").join(by_set, "set_id").select("doc_id", "n_shingles", "component_id").unionByName(own)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
