"""MinHash near-dedup with tensored banding.

A document's set: its distinct shingles (runs of `shingle` words, A-Z lower-cased; the whole sequence as one where there are fewer).
Two documents are linked when 100 * shared >= `percent` * united. Equal sets collapse first, so copies cost nothing.

Tensored banding: `side` keys A_i and `side` keys B_j are made of PART minhashes each, and every pair (A_i, B_j) is a table's key.
So side * side tables need 2 * side * PART minhashes instead of 2 * side * side * PART. Two sets of similarity p share no table
with a chance of about 2 * (1 - p**PART)**side, which `side` holds to LOST at the threshold (7e-5 at 0.85, then 2e-6 at 0.9); a
component hangs on many links. Sets so small that they can only link with equal sets need no key.

Table entries carry four bits of each minhash. Pairs of one table key that agree in fewer of these than is likely at the threshold,
by five deviations, are no candidates. What candidates connect is a family; each task, over all its tables, gives at most one edge a member (to the
least member it connects to), so a family is never expanded into its pairs. A key that holds many sets of one chunk sends on one of them, and its
sets are one family without further question: families may be larger than needed, never smaller. Then each set of a family goes to the
family's task once (families over BLOCK shingles are cut into blocks, and each pair of blocks is one task's). There
sets of different components so far are compared by their whole minhashes, by the same rule, and links confirmed on the full sets, which a second pass
over the documents makes for members of families alone (a bitmap of fixed size keeps most others out, the join the rest).
Components grow from edges by least labels and jumps, in rounds that are written out.

Defined cases: null and empty texts have no set and link with nothing; a null doc_id is never a component's id unless all in it are
null; rows of equal doc_id and text are one document, all kept or none; rows of equal doc_id and different texts stay apart, unless
linked; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_file, lean, marked, maybe_in, read_bitmap, spot_of, stage, table, unstage
from .substrings import BASES, rolling, word_hash

PERCENT = 85
PART, LOST = 2, 1e-4
BLOCK = 1 << 20
ENTRIES_PER_TASK = 1 << 19
SETS_PER_CHUNK, HOT = 2048, 256
BITMAP_BITS = 27
SHINGLES_PER_CHUNK = 1 << 19
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Layout:
    """The tables for a threshold in percent. entry: a table's key, the set's id, four bits of each minhash, 1 if it stands for
    all sets of the key in its chunk; least: the shingles of the smallest set that can link with another; matching, near: in how many
    minhashes candidates agree, by four bits and whole."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent is 50 to 100")
        p = percent / 100
        self.percent, self.side = percent, 2
        while 2 * (1 - p**PART) ** self.side > LOST:
            self.side += 1
        self.hashes = 2 * self.side * PART
        self.matching, self.near = (math.floor(self.hashes * q - 5 * math.sqrt(self.hashes * q * (1 - q))) for q in (p + (1 - p) / 16, p))
        self.least = math.ceil(100 / (100 - percent)) - 1 if percent < 100 else 1 << 62
        self.entry = np.dtype([("key", "<u8"), ("sid", "<i8"), ("bits", "u1", self.hashes // 2), ("whole", "u1")])
        self.factors = np.random.default_rng(20).integers(1, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; none without words."""
    words = (text or "").encode().translate(LOWER).split()
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    return np.unique(mixed(rolling(h, min(size, h.size), BASES[1]))) if h.size else h


def signatures(sets: list[np.ndarray], layout: Layout) -> np.ndarray:
    """32 high bits of the minhashes of non-empty sets."""
    out = np.empty((len(sets), layout.hashes), np.uint32)
    starts = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    for k, factor in enumerate(layout.factors):
        out[:, k] = np.minimum.reduceat(every * factor, starts) >> np.uint64(32)
    return out


def described(docs: DataFrame, shingle: int, layout: Layout) -> DataFrame:
    """doc_id, sid, n_shingles, s1 and s2 (128 bits that name the set), sig (packed, null for empty sets)."""
    names = ["doc_id", "sid", "n_shingles", "s1", "s2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                sets, total = [], 0
                while first + len(sets) < batch.num_rows and total < SHINGLES_PER_CHUNK:
                    sets.append(shingles(batch.column(1)[first + len(sets)].as_py(), shingle))
                    total += sets[-1].size
                part = batch.slice(first, len(sets))
                some = [k for k, s in enumerate(sets) if s.size]
                sig = [None] * len(sets)
                for k, row in zip(some, signatures([sets[k] for k in some], layout) if some else (), strict=True):
                    sig[k] = row.tobytes()
                sums = [(int(mixed(s).sum().view(np.int64)), int(mixed(s ^ M1).sum().view(np.int64))) if s.size else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([s.size for s in sets], pa.int64()), pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()), pa.array(sig, pa.binary())], names=names)
                first += len(sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"doc_id {kind}, sid long, n_shingles long, s1 long, s2 long, sig binary")


def entries_of(sids: np.ndarray, sigs: np.ndarray, layout: Layout) -> np.ndarray:
    """Entries of all tables for these sets, side * side a set."""
    half, tables = layout.side * PART, layout.side**2
    wide = sigs.astype(np.uint64)

    def keys(block: np.ndarray) -> np.ndarray:
        out = np.zeros((block.shape[0], layout.side), np.uint64)
        for p in range(PART):
            out = mixed(out * M2 + block[:, p::PART] + np.uint64(1))
        return out

    a, b = keys(wide[:, :half]), keys(wide[:, half:])
    number = np.arange(tables, dtype=np.uint64)
    key = mixed((a[:, :, None] * M1 + b[:, None, :]).reshape(len(sids), -1) + number)
    out = np.empty(key.size, layout.entry)
    out["key"], out["sid"] = key.reshape(-1), np.repeat(sids, tables)
    low = (sigs & 15).astype(np.uint8)
    out["bits"] = np.repeat(low[:, 0::2] << 4 | low[:, 1::2], tables, axis=0)
    out["whole"] = 0
    return out


def matches(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many four-bit minhashes agree with those of one set."""
    x = bits ^ one
    return ((x & 0xF0) == 0).sum(axis=1) + ((x & 0x0F) == 0).sum(axis=1)


def groups_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by key and id, and the start and size of each key's."""
    e = e[np.lexsort((e["sid"], e["key"]))]
    starts = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])) if len(e) else np.zeros(0, np.int64)
    return e, starts, np.diff(np.append(starts, len(e)))


def star(sids: np.ndarray) -> np.ndarray:
    """Edges from the least of sorted ids to the others."""
    return np.column_stack([np.full(sids.size - 1, sids[0]), sids[1:]])


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges (least, other) that connect what these edges connect: one for each id but the least of its component."""
    known, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label, was = np.arange(known.size), None
    while was is None or (label != was).any():  # the roots of both ends hook on to the lesser, then every id points to its root
        was = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, was[end], low)
        while (label != label[label]).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(known.size))
    return np.column_stack([known[label[other]], known[other]])


def gathered(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a chunk to send on, and edges among those that stay: a key of more than HOT sets sends its first."""
    e, starts, sizes = groups_of(e)
    edges, stay = [np.zeros((0, 2), np.int64)], np.ones(len(e), bool)
    for at, size in zip(starts[sizes > HOT], sizes[sizes > HOT], strict=True):
        edges.append(star(e["sid"][at : at + size]))
        stay[at + 1 : at + size] = False
        e["whole"][at] = 1
    return e[stay], np.unique(np.concatenate(edges), axis=0)


def family_edges(e: np.ndarray, matching: int) -> np.ndarray:
    """Edges (least, other) that connect what the candidates among these entries connect."""
    e, starts, sizes = groups_of(e)
    out = [np.zeros((0, 2), np.int64)]
    at = starts[sizes == 2]
    ok = (matches(e["bits"][at], e["bits"][at + 1]) >= matching) | (e["whole"][at] | e["whole"][at + 1]).astype(bool)
    out.append(np.column_stack([e["sid"][at[ok]], e["sid"][at[ok] + 1]]))
    for first, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        own = e[first : first + size]
        for group in [np.arange(size)] if own["whole"].any() else alike(own["bits"], matching):
            out.append(star(own["sid"][group]))
    return np.unique(np.concatenate(out), axis=0)


def candidates(reps: DataFrame, layout: Layout) -> DataFrame:
    """Staged, distinct edges (a, b): two sets of one family connected by them can be linked, others cannot. A task sends at most one
    edge a set, from the least of what it connects, so the tables of a large family do not add up."""
    n = reps.count()
    tasks = max(1, -(-n * layout.side**2 // ENTRIES_PER_TASK))
    buckets = 1 << (4 * tasks).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries by bucket; a bucket below 0 holds edges."""
        for whole in batches:
            for at in range(0, whole.num_rows, SETS_PER_CHUNK):
                batch = whole.slice(at, SETS_PER_CHUNK)
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, layout.hashes)
                e, near = gathered(entries_of(batch.column(0).to_numpy(), sigs, layout))
                bucket = (e["key"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [bucket.size]])
                names, bodies = bucket[edges[:-1]].tolist(), [e[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]
                if len(near):
                    names.append(-1 - int(near[0, 0]) % (1 << 20))
                    bodies.append(near.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], [np.zeros((0, 2), np.int64)]
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name < 0:
                    found.append(np.frombuffer(body, np.int64).reshape(-1, 2))
                else:
                    held.append(np.frombuffer(body, layout.entry))
        if held:
            e = np.concatenate(held)
            held.clear()
            found.append(family_edges(e, layout.matching))
        every = forest(np.concatenate(found))
        yield pa.RecordBatch.from_arrays([pa.array(every[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])

    entries = reps.select("sid", "sig").mapInArrow(lean(deal), "bucket long, entries binary")
    met = entries.repartition(int(tasks), "bucket").mapInArrow(lean(meet), "a long, b long")
    return stage(met.distinct(), "neardup-candidates")


def alike(bits: np.ndarray, matching: int) -> Iterator[np.ndarray]:
    """Groups of sets connected by pairs that may be similar."""
    open_ = np.arange(len(bits))
    while open_.size:
        group, todo, open_ = [open_[0]], [open_[0]], open_[1:]
        while todo and open_.size:
            near = matches(bits[open_], bits[todo.pop()]) >= matching
            group.extend(open_[near])
            todo.extend(open_[near])
            open_ = open_[~near]
        yield np.sort(np.array(group))


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Staged sid, body (packed sorted shingles), family of the wanted (sid, family)."""
    path = bitmap_file(wanted.select(spot_of(F.col("sid"), BITMAP_BITS).alias("spot")), BITMAP_BITS, "neardup-bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = read_bitmap(path)
        for batch in batches:
            some = np.flatnonzero(marked(held, batch.column(2).to_numpy()))
            for at in range(0, some.size, 512):
                rows = batch.take(pa.array(some[at : at + 512]))
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array([shingles(t, shingle).tobytes() for t in rows.column(0).to_pylist()], pa.binary())], names=["sid", "body"])

    made = docs.select("text", "sid", spot_of(F.col("sid"), BITMAP_BITS).alias("spot")).mapInArrow(lean(run), "sid long, body binary")
    # rows of one document (equal doc_id and text) make one set
    return stage(made.join(wanted, "sid").dropDuplicates(["sid"]), "neardup-sets")


def spanning(sids: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, layout: Layout) -> list[tuple[int, int]]:
    """Links that connect just what all links among these sets connect; of two blocks, what links across them connect."""
    n, percent = len(sets), layout.percent
    sizes = np.array([s.size for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sids, sizes, blocks = [sets[k] for k in order], sids[order], sizes[order], blocks[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sigs = signatures(sets, layout)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.astype(np.int32)
    mark = np.zeros(known.size, bool)
    del known
    label, out, two = np.arange(n), [], blocks.min() != blocks.max()
    for k in range(n - 1):
        top = np.searchsorted(100 * sizes, 10000 * sizes[k] // percent + 100, "right")  # the sizes that can be similar
        open_ = label[k + 1 : top] != label[k]
        if two:
            open_ &= blocks[k + 1 : top] != blocks[k]
        js = k + 1 + np.flatnonzero(open_)
        if js.size:
            js = js[(sigs[js] == sigs[k]).sum(axis=1) >= layout.near]
        if not js.size:
            continue
        mark[ids[starts[k] : starts[k + 1]]] = True
        for at in range(0, js.size, 256):
            part = js[at : at + 256]
            ends = np.cumsum(sizes[part])
            shared = np.add.reduceat(mark[np.concatenate([ids[starts[j] : starts[j + 1]] for j in part])].astype(np.int32), ends - sizes[part])
            for j in part[100 * shared >= percent * (sizes[k] + sizes[part] - shared)]:
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    out.append((int(sids[k]), int(sids[j])))
        mark[ids[starts[k] : starts[k + 1]]] = False
    return out


def dealt(sets: DataFrame) -> DataFrame:
    """The sets of each family by task: family, part, block, sid, body. A family of up to BLOCK shingles is one part; a larger one has
    a part for each pair of its blocks, a block with itself included."""
    totals = stage(sets.groupBy("family").agg(F.sum(F.length("body") / 8).alias("total")).where(F.col("total") > BLOCK), "neardup-large")
    blocks = F.coalesce(F.ceil(F.col("total") / BLOCK), F.lit(1))
    rows = sets.join(totals, "family", "left").select("family", blocks.alias("blocks"), F.pmod(F.xxhash64("sid"), blocks).alias("block"), "sid", "body")
    part = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    return rows.select("family", F.explode(part).alias("part"), "block", "sid", "body")


def links(sets: DataFrame, layout: Layout) -> DataFrame:
    """Staged links (a, b), confirmed on full sets."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, blocks, bodies = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(sids) > 1 and (got := spanning(np.array(sids, np.int64), bodies, np.array(blocks, np.int64), layout)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for family, part, block, sid, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, part) != now:
                    yield from done()
                    now, sids, blocks, bodies = (family, part), [], [], []
                sids.append(sid)
                blocks.append(block)
                bodies.append(np.frombuffer(body, np.uint64))
        yield from done()

    rows = dealt(sets).repartition("family", "part").sortWithinPartitions("family", "part")
    return stage(rows.mapInArrow(lean(connect), "a long, b long"), "neardup-links")


def components(edges: DataFrame) -> DataFrame:
    """Staged node, label: the least node of each component, for nodes with edges.

    A round gives each node the least label around it and then the label of its label; rounds end when nothing changes.
    Minima are taken before the exchange, and joins may split a node with many edges.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "neardup-edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "neardup-labels")
    changed = True
    while changed:  # labels only fall, so this ends
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        low = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage(low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "neardup-labels")
        changed = new.where("label <> was").limit(1).count()
        unstage(labels)
        labels = new
    unstage(both)
    return labels


def deduplicated(docs: DataFrame, shingle: int = 3, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, sid (of equal doc_id and text), n_shingles, component_id, kept (doc_id is the
    component's), first (true for one sid of the component)."""
    layout = Layout(percent)
    docs = docs.select("doc_id", "text").withColumn("sid", F.xxhash64("doc_id", F.xxhash64("text")))
    rows = stage(described(docs.select("doc_id", "text", "sid"), shingle, layout), "neardup-docs")
    sets = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("least"), F.min(F.struct("sid", "sig")).alias("rep"), F.first("n_shingles").alias("n"))
    reps = stage(sets.select("s1", "s2", "least", "rep.sid", "rep.sig", "n"), "neardup-reps")
    found = candidates(reps.where(F.col("n") >= layout.least), layout)
    families = components(found)
    members = sets_of(docs, families.select(F.col("node").alias("sid"), F.col("label").alias("family")), shingle)
    confirmed = links(members, layout)
    labels = components(confirmed)
    unstage(found, families, members, confirmed)
    named = reps.select("s1", "s2", "least", "sid").join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    ids = named.groupBy("label").agg(F.min("least").alias("first"))
    of_set = stage(named.join(ids, "label").select("s1", "s2", F.col("first.doc_id").alias("component_id"), F.col("first.sid").alias("first_sid")), "neardup-components")
    out = rows.select("doc_id", "sid", "n_shingles", "s1", "s2").join(of_set, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    first = F.when(F.col("n_shingles") > 0, F.col("sid") == F.col("first_sid")).otherwise(True)
    return out.select("doc_id", "sid", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component, its first by (doc_id, a hash of the text); rows without a set all stay.

    Only rows that go, or that the table repeats, meet in an exchange; a bitmap lets the others pass where they lie.
    """
    members = stage(deduplicated(docs, shingle, percent).select("sid", "n_shingles", "first"), "neardup-members")
    fate = members.where("n_shingles > 0").groupBy("sid").agg(F.first("first").alias("_first"), F.count("*").alias("_n"))
    fate = stage(fate.where("not _first or _n > 1").withColumnRenamed("sid", "_sid"), "neardup-fate")
    rows = maybe_in(docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("_sid")), fate, "_sid")
    met = rows.where("_maybe").join(fate, "_sid", "left")
    single = met.where("_first is null").select("row.*")
    repeated = met.where("_first").dropDuplicates(["_sid"]).select("row.*")
    return rows.where("not _maybe").select("row.*").unionByName(single).unionByName(repeated)


def op9_neardups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
