"""Near-duplicate documents: MinHash bands, verification, components.

1. One pass over the texts gives each document its set of word shingles as a
   64-bit class (documents with the same set share it), a signature of
   ``hashes`` universal hash minima and the keys of its bands.  From here on
   only classes are compared, so exact copies cost one comparison.
2. Each bucket (band key) links its members to one hub, the smallest class:
   linear in the bucket's size.  Links whose signatures agree well enough are
   confirmed on the full sets.
3. Components by alternating large-star and small-star.
4. Members of a bucket that are still in different components may be linked
   with each other although not with the hub.  Those buckets are compared in
   blocks: members outside the bucket's largest component against all members,
   signatures first, then full sets, which tasks read from files in the shared
   folder; then components once more.  So no link that any band proposes is
   lost, and pairs are never rows: a task returns a member's partners as one
   row, and of its links one for each component.

The chance that no band proposes a pair of similarity s is (1-s^r)^b; with 32
bands of 4 it is 5e-8 at 0.8.  A signature estimate lies 5 standard deviations
(0.18) below 0.8 once in some millions; lower ones are not confirmed.

Defined results: a document without words, with null or empty text, has no
shingles, is linked with nothing and is its own component.  Repeated rows and
equal texts are one class and so one component.  ``component_id`` is the
smallest non-null id reachable; null if there is none.  Rows with the same id
and text are one document to ``deduplicated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import batch, column, local_file, mapped, partitions, put, remove, saved, signed, workspace
from ledgerfold.llm.textkernel import mix, shingles, u64, word_slices

BLOCK = 256         # members of a block in step 4
MARGIN = 0.18       # below the threshold, signature estimates are not confirmed


def _universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20260101)
    return r.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(elements: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash a*x+b (mod 2^32) over the set."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i:i + 1024, None] * a + b).min(axis=0), out=out)
    return out


def fingerprints(docs: DataFrame, k: int, bands: int, rows: int, text: str) -> DataFrame:
    """uid, n_shingles, node (class of the set), sig, bands for every row."""
    a, b = _universal(bands * rows)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for item in batches:
            ids = item.column(0)
            for i, j, words in word_slices(item.column(1)):
                n, node, sigs, keys = [], [], [], []
                for d in range(j - i):
                    own = np.unique(shingles(words.hash[words.first[d]:words.first[d + 1]], k))
                    n.append(len(own))
                    if not len(own):
                        node.append(None)
                        sigs.append(None)
                        keys.append(None)
                        continue
                    node.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                    minima = signature(own, a, b)
                    sigs.append(minima.tobytes())
                    key = salt.copy()
                    for column_ in minima.reshape(bands, rows).T:
                        key = (key ^ column_) * u64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    keys.append(signed(mix(key)))
                yield batch(["uid", "n_shingles", "node", "sig", "bands"],
                            [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))])

    return docs.select("uid", text).mapInArrow(run, "uid long, n_shingles long, node long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int, text: str) -> DataFrame:
    """node and its sorted distinct shingle hashes (``items``)."""
    def run(batches):
        for item in batches:
            nodes = item.column(0)
            for i, j, words in word_slices(item.column(1)):
                sets = [np.unique(shingles(words.hash[words.first[d]:words.first[d + 1]], k)).tobytes() for d in range(j - i)]
                yield batch(["node", "items"], [nodes.slice(i, j - i), pa.array(sets, pa.binary())])

    return docs.select("node", text).mapInArrow(run, "node long, items binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``least`` of places."""
    sig = classes.select("node", "sig")
    both = (pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a")
            .join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b"))

    def run(batches):
        for item in batches:
            if item.num_rows:
                one = np.frombuffer(b"".join(item.column("sig_a").to_pylist()), np.uint32).reshape(item.num_rows, -1)
                two = np.frombuffer(b"".join(item.column("sig_b").to_pylist()), np.uint32).reshape(item.num_rows, -1)
                keep = (one == two).mean(axis=1) >= least
                yield batch(["a", "b"], [column(item, "a")[keep], column(item, "b")[keep]])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, text: str, percent: int, uri: str) -> DataFrame:
    """Pairs whose full sets have 100*intersection >= percent*union.  ``pairs``
    is read twice and must be a stored table."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = nodes.join(classes.select("node", "uid"), "node")
    sets = saved(shingle_sets(docs.join(needed, "uid").dropDuplicates(["node"]), k, text), f"{uri}-sets")
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "items": "items_a"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "items": "items_b"}), "b"))

    def run(batches):
        for item in batches:
            keep = np.zeros(item.num_rows, dtype=bool)
            for r in range(item.num_rows):
                one = np.frombuffer(item.column("items_a")[r].as_buffer(), np.uint64)
                two = np.frombuffer(item.column("items_b")[r].as_buffer(), np.uint64)
                low, high = sorted((len(one), len(two)))
                if 100 * low >= percent * high:
                    merged = np.sort(np.concatenate([one, two]), kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                    keep[r] = 100 * common >= percent * (low + high - common)
            yield batch(["a", "b"], [column(item, "a")[keep], column(item, "b")[keep]])

    return saved(both.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long"), f"{uri}-links")


def components(edges: DataFrame, uri: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest
    node of its component.  Alternating large-star and small-star; each round
    is stored, so lost executors cost one round at most."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        near = e.union(turned) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = near.join(low, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    e, before, step = edges.where("a <> b").select("a", "b"), None, 0
    while True:
        e = saved(star(e, True), f"{uri}/large{step}")
        e = saved(star(e, False), f"{uri}/small{step}")
        now = state(e)
        if now == before or now[0] == 0:
            break
        before, step = now, step + 1
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _across(members: DataFrame, classes: DataFrame, least: float, bands: int) -> DataFrame:
    """Candidates of different components within a bucket: members outside the
    largest component, in blocks, against all.  A row per member and block:
    node, partners whose signatures agree and their labels.  A pair that shares
    several buckets is a candidate in the first of its common bands only."""
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    bucket = (sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
              .where("parts > 1").select("key", F.col("most.label").alias("largest"), "n", F.col("most.n").alias("n_largest")))
    joined = (members.join(bucket, "key").join(classes.select("node", "sig"), "node")
              .withColumn("minor", F.col("label") != F.col("largest"))
              .withColumn("minor_blocks", F.ceil((F.col("n") - F.col("n_largest")) / BLOCK).cast("int"))
              .withColumn("all_blocks", F.ceil(F.col("n") / BLOCK).cast("int")))

    def block(n: str):
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    keys = ["key", "i", "j"]
    left = (joined.where("minor").withColumn("i", block("minor_blocks"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1))).withColumn("side", F.lit(0)))
    right = (joined.withColumn("j", block("all_blocks"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1))).withColumn("side", F.lit(1)))
    own = [*keys, "band", "side", "node", "label", "sig"]
    cells = left.select(*own).union(right.select(*own))

    def run(cell: pa.Table) -> pa.Table:
        side, node, label = (cell[c].to_numpy() for c in ("side", "node", "label"))
        sig, band = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint32).reshape(len(node), -1), cell["band"][0].as_py()
        right, rows = np.flatnonzero(side == 1), []
        for r in np.flatnonzero(side == 0) if len(right) else ():
            equal = sig[right] == sig[r]
            first = equal.reshape(len(right), bands, -1).all(axis=2).argmax(axis=1)
            hit = right[(equal.mean(axis=1) >= least) & (label[right] != label[r]) & (first == band)]
            if len(hit):
                rows.append((node[r], node[hit], label[hit]))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table({"node": pa.array(columns[0], pa.int64()), "partners": pa.array(columns[1], pa.list_(pa.int64())), "labels": pa.array(columns[2], pa.list_(pa.int64()))})

    return cells.groupBy(*keys).applyInArrow(run, "node long, partners array<long>, labels array<long>")


class SetFiles:
    """Sets by node, in files by the node's hash that tasks memory-map."""

    def __init__(self, uri: str, files: int, counts: dict[int, int]):
        self.uri, self.files, self.counts, self._open = uri, files, counts, {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    @staticmethod
    def place(nodes: np.ndarray, files: int) -> np.ndarray:
        return (mix(nodes.view(np.uint64)) % u64(files)).astype(np.int64)

    @classmethod
    def store(cls, sets: DataFrame, uri: str) -> SetFiles:
        """``sets`` has a row per node: node, items."""
        files = 4 * partitions(sets.sparkSession)

        def placed(batches):
            for b in batches:
                yield batch(["file", "node", "items"], [cls.place(column(b, "node"), files), b.column("node"), b.column("items")])

        def write(batches):
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            file, node, items = t["file"].to_numpy(), t["node"].to_numpy(), t["items"].to_pylist()
            for f in np.unique(file):
                at = np.flatnonzero(file == f)
                at = at[np.argsort(node[at])]
                ends = np.cumsum([len(items[i]) // 8 for i in at]).astype("<i8")
                put(uri, f"{f}.sets", [node[at].astype("<i8").tobytes(), ends.tobytes(), *[items[i] for i in at]])
                yield batch(["file", "n"], [[int(f)], [len(at)]])

        rows = sets.mapInArrow(placed, "file long, node long, items binary").repartition(partitions(sets.sparkSession), "file").mapInArrow(write, "file long, n long").collect()
        return cls(uri, files, {r.file: r.n for r in rows})

    def get(self, nodes: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(nodes)
        place = self.place(nodes, self.files)
        for f in np.unique(place).tolist():
            if f not in self._open:
                n, raw = self.counts[f], mapped(local_file(self.uri, f"{f}.sets")).view("<u8")
                self._open[f] = raw[:n].view("<i8"), np.r_[0, raw[n:2 * n].view("<i8")], raw[2 * n:]
            own, ends, items = self._open[f]
            at = np.flatnonzero(place == f)
            for i, r in zip(at, np.searchsorted(own, nodes[at]), strict=True):
                out[i] = items[ends[r]:ends[r + 1]]
        return out


def _linked(found: DataFrame, classes: DataFrame, docs: DataFrame, k: int, text: str, percent: int, uri: str) -> DataFrame:
    """Links (a, b) of the candidates of ``_across`` (a stored table), by their
    full sets: one a row for each component that the node is linked with.
    Candidate pairs stay inside the task that confirms them."""
    def named(batches):
        for b in batches:
            flat = pa.concat_arrays([b.column(0), b.column(1).flatten()])
            yield batch(["node"], [flat.unique()])

    nodes = found.select("node", "partners").mapInArrow(named, "node long").distinct()
    needed = nodes.join(classes.select("node", "uid"), "node")
    sets = SetFiles.store(shingle_sets(docs.join(needed, "uid").dropDuplicates(["node"]), k, text), f"{uri}-files")

    def run(batches):
        for b in batches:
            out = []
            for row in range(b.num_rows):
                node, partners, labels = b.column(0)[row].as_py(), *(b.column(c)[row].values.to_numpy() for c in (1, 2))
                own = sets.get(np.array([node]))[0]
                seen = set()
                for i in range(0, len(partners), BLOCK):
                    lists = sets.get(partners[i:i + BLOCK])
                    size = np.array([len(x) for x in lists])
                    flat = np.concatenate(lists)
                    at = np.searchsorted(own, flat)
                    at[at == len(own)] = 0
                    common = np.add.reduceat((own[at] == flat).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
                    for hit in np.flatnonzero(100 * common >= percent * (size + len(own) - common)):
                        if labels[i + hit] not in seen:
                            seen.add(labels[i + hit])
                            out.append((node, int(partners[i + hit])))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield batch(["a", "b"], [pa.array(c, pa.int64()) for c in columns])

    # one row a task's turn: rows differ in partners
    return found.repartition(4 * partitions(found.sparkSession)).mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
             id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, id, n_shingles and label (component; null without shingles) of
    every row, as a stored table."""
    uri = workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.xxhash64(id_col, text).alias("uid"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    prints = saved(fingerprints(docs, k, bands, rows, "_text"), f"{uri}/prints")
    one = prints.where("n_shingles > 0").groupBy("node").agg(F.min("uid").alias("uid"))
    classes = saved(prints.join(one, ["node", "uid"]).dropDuplicates(["node"]), f"{uri}/classes")
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(keyed.join(buckets, "key").where("node <> hub").select("key", "band", "node", "hub", "n"), f"{uri}/members")
    least = percent / 100 - MARGIN

    pairs = members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = saved(_estimated(pairs, classes, least), f"{uri}/pairs1")
    links = _confirmed(pairs, classes, docs, k, "_text", percent, f"{uri}/first")
    labels = saved(components(links, f"{uri}/stars1"), f"{uri}/labels1")

    rest = (members.where("n > 2").join(labels, "node", "left")
            .select("key", "band", "node", F.coalesce("label", "node").alias("label")))
    found = saved(_across(rest, classes, least, bands), f"{uri}/found")
    if not found.isEmpty():
        more = saved(_linked(found, classes, docs, k, "_text", percent, f"{uri}/second"), f"{uri}/second-links")
        labels = saved(components(links.union(more), f"{uri}/stars2"), f"{uri}/labels2")

    out = (docs.select("uid", "_id").join(prints.select("uid", "n_shingles", "node").distinct(), "uid")
           .join(labels, "node", "left").select("uid", "_id", "n_shingles", F.coalesce("label", "node").alias("label")))
    out = saved(out, f"{uri}-rows")
    remove(uri)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    out = labelled(docs, k, percent, bands, rows, id_col, text)
    lowest = out.where("label is not null").groupBy("label").agg(F.min("_id").alias("low"))
    out = out.join(lowest, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("_id")).otherwise(F.col("low")))
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest id (null
    last).  Documents without words stay."""
    marked = labelled(docs, k, percent, bands, rows, id_col, text)
    first = (marked.where("label is not null").groupBy("label")
             .agg(F.min(F.struct(F.col("_id").isNull(), "_id", "uid")).alias("first")).select(F.col("first.uid").alias("_uid")))
    stay = first.union(marked.where("label is null").select(F.col("uid").alias("_uid")))
    return (docs.withColumn("_uid", F.xxhash64(id_col, text)).join(stay, "_uid", "left_semi")
            .dropDuplicates(["_uid"]).select(*docs.columns))
