"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their hashes. It is cut into fragments, and fragments, not documents, are dealt
to tasks. Two sets of sizes a and b with Jaccard t or more differ in at most (a + b)(1 - t)/(1 + t) n-grams; cut into
more fragments than that, at least one fragment is the same in both. So a document sends one number for each of its
fragments, and documents that share a number are candidates. A candidate pair stays if its counts of n-grams per cell
allow a link: first each document is held against the first one with the same number, then those with one number that
this has not connected against each other. The closure of what stays gives clusters outside which no link exists; that of
all candidates would not do, for long documents share numbers by chance and chain into one cluster that grows with the
table. Inside a cluster the overlaps of fragments are counted apart and summed per pair, exactly; clusters with
many documents are split into blocks and the pairs of blocks are dealt to tasks, so no task holds more than two blocks.

Documents with the same set are one class from the start and never make pairs. Links between classes leave a task as a
spanning forest and a number of links per class; components come from contracting the forests.

Sizes fall into bands; a document is cut as its own band asks and, if it may link with a larger one of the next band,
as that one asks too.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.graph import connected_components
from taxolith.llm.shingles import mix, shingle_set

#: Documents and n-grams of one block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_GRAMS = 512, 1_000_000
#: Columns of a fragment when overlaps are counted.
FRAGMENT = 2_048
#: Orders of n-grams by which a set with many weak fragments is cut.
ORDERS = 8
#: N-grams of one cell at most on average; the counts per cell bound an overlap from above. A document has so many cells as its size asks.
CELL = 8
#: A band's largest size over its smallest.
BAND = 1.3


@functools.cache
def bands(num: int, den: int, upto: int) -> list[int]:
    """Smallest sizes of the bands; no link spans more than two neighbours."""
    starts = [1]
    while starts[-1] <= upto:
        s = starts[-1]
        starts.append(max(s * den // num + 1, math.ceil(s * BAND)))
    return starts


def fragments_of(band: int, starts: list[int], num: int, den: int) -> tuple[int, int]:
    """(fragments, weak ones that change nothing) for pairs whose larger set is in the band."""
    differ = 2 * (starts[band + 1] - 1) * (den - num) // (den + num)
    if not differ:
        return 1, 0
    spare = 1 + differ // 4
    return differ + 1 + spare, spare


def fragment_keys(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """The numbers a set sends; two sets that link share one.

    A weak fragment, empty or of one n-gram, is not sent: many unlike documents share it. Fragments are more than
    differences by the number of weak ones allowed, so if all that two linked sets share are weak, both have too many.
    Such a set is cut again by another order of n-grams, until it has few; after ORDERS orders it sends weak ones too.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64)
    starts = bands(num, den, 1 << max(8, (2 * n).bit_length()))
    own = int(np.searchsorted(starts, n, "right")) - 1
    out = []
    for band in (own, own + 1):
        if band > own and n * den < num * starts[band]:
            break  # too small for any set of the next band
        k, spare = fragments_of(band, starts, num, den)
        # both sets of a pair must call the same fragments weak: the bound depends on the band alone
        least = 1 if num * starts[band] > 3 * k * den else 0
        for order in range(ORDERS):
            ordered = grams if not order else np.sort(mix(grams ^ np.uint64(order)))
            place = ((ordered >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            sizes = np.bincount(place.astype(np.int64), minlength=k)
            scattered = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ordered))))
            ends = np.cumsum(sizes)
            sums = scattered[ends] - scattered[ends - sizes]
            tag = np.arange(k, dtype=np.uint64) + np.uint64((band << 32) + (order << 48))
            keys = mix(mix(sums + sizes.astype(np.uint64)) ^ mix(tag))
            strong = sizes > least
            out.append(keys[strong])
            if k - strong.sum() <= spare:
                break
        else:
            out.append(keys[~strong])
    return np.concatenate(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def first_digest(grams: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)[0])


def fragmented(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (digest of the set), keys, cells (n-grams per cell), of every row of docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            sizes, k1, k2, flat, ends, cells = [], [], [], [], [0], []
            for text in b.column("text").to_pylist():
                grams = shingle_set(text, n)
                digest = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
                keys = fragment_keys(grams, num, den)
                sizes.append(len(grams)), k1.append(int(digest[0])), k2.append(int(digest[1]))
                flat.append(keys), ends.append(ends[-1] + len(keys)), cells.append(cells_of(grams).tobytes())
            values = pa.array(signed(np.concatenate([*flat, np.zeros(0, np.uint64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(cells, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "keys", "cells"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>, cells binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: counted fragment by fragment, then summed."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))) - 1
    shared = np.bincount(column) > 1  # an n-gram of one set alone adds nothing
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = int(shared.sum())
    for start in range(0, width, FRAGMENT):
        a, b = np.searchsorted(column, (start, start + FRAGMENT))
        part = np.zeros((len(sets), min(FRAGMENT, width - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest number in each one's component of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        after = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        after = after[after]
        if (after == label).all():
            return label
        label = after


def cells_of(grams: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each cell of the order; empty, for not known, if a byte can't hold a count."""
    level = max(3, (len(grams) // CELL).bit_length())
    counts = np.bincount((grams.view(np.uint64) >> np.uint64(64 - level)).astype(np.int64), minlength=1 << level)
    return counts.astype(np.uint8) if counts.max() < 256 else np.zeros(0, np.uint8)


def coarser(cells: np.ndarray, width: int) -> np.ndarray:
    return cells.astype(np.uint16) if len(cells) == width else cells.reshape(width, -1).sum(axis=1, dtype=np.uint16)


def may_link(size_a: int, size_b: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether an overlap, cell by cell at most the smaller count, may reach the threshold."""
    if den * min(size_a, size_b) < num * max(size_a, size_b):
        return False
    if not len(a) or not len(b):
        return True
    width = min(len(a), len(b))
    most = int(np.minimum(coarser(a, width), coarser(b, width)).sum(dtype=np.int64))
    return den * most >= num * (size_a + size_b - most)


def plausible(sizes: np.ndarray, cells: list[np.ndarray], num: int, den: int, *apart: np.ndarray) -> np.ndarray:
    """Symmetric matrix of pairs that may_link() lets pass and that differ in each of the arrays apart."""
    order = np.argsort(sizes, kind="stable")
    size, width, apart = sizes[order], np.array([len(cells[k]) for k in order]), [x[order] for x in apart]
    end = np.searchsorted(size * num, size * den, "right")
    out = np.zeros((len(sizes), len(sizes)), bool)
    known = np.flatnonzero(width)
    for w in np.unique(width[known]):
        # larger sets have no fewer cells: all that rows of this width meet further on are made as coarse
        rows = known[width[known] == w]
        span = known[(known >= rows[0]) & (known < end[rows[-1]])]
        table = np.stack([coarser(cells[order[k]], w) for k in span])
        for a, i in enumerate(rows):
            met = np.arange(a + 1, np.searchsorted(span, end[i]))
            for x in apart:
                met = met[x[span[met]] != x[i]]
            if len(met):
                most = np.minimum(table[met], table[a]).sum(axis=1, dtype=np.int64)
                out[order[i], order[span[met]]] = den * most >= num * (size[i] + size[span[met]] - most)
    for i in np.flatnonzero(width == 0):
        near = (den * size >= num * size[i]) & (den * size[i] >= num * size) & (np.arange(len(size)) != i)
        for x in apart:
            near &= x != x[i]
        out[order[i], order[near]] = True
    return out | out.T


def first_links(edges: DataFrame, num: int, den: int) -> DataFrame:
    """The edges(a, b, na, nb, ca, cb) that may_link() lets pass, as (a, b)."""

    def run(batches):
        for t in batches:
            rows = zip(*(t.column(c).to_pylist() for c in ("na", "nb", "ca", "cb")), strict=True)
            yield t.filter(pa.array([may_link(na, nb, np.frombuffer(ca, np.uint8), np.frombuffer(cb, np.uint8), num, den) for na, nb, ca, cb in rows], pa.bool_())).select(["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def block_candidates(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(a, b) that connect what plausible() connects among the rows of each (cluster, i, j), labels that are equal already left out."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pdf = pdf.drop_duplicates(["cluster", "i", "j", "node"]).sort_values(["cluster", "i", "j", "node"])
    group, node, size, cells = pdf[["cluster", "i", "j"]].to_numpy(), pdf["node"].to_numpy(), pdf["n_shingles"].to_numpy(), [np.frombuffer(c, np.uint8) for c in pdf["cells"]]
    label, block = pdf["label"].to_numpy(), pdf["block"].to_numpy()
    cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1), len(pdf)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        apart = [label[x:y]] if group[x, 1] == group[x, 2] else [label[x:y], block[x:y]]
        linked = plausible(size[x:y], cells[x:y], num, den, *apart)
        some = linked.any(axis=1)
        a.append(node[x:y][some]), b.append(node[x:y][forest(linked)][some])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def placed_in_blocks(members: DataFrame, docs_limit: int, grams_limit: int) -> DataFrame:
    """members(node, cluster, n_shingles, ...) with blocks, block: clusters over a limit are split by the node's hash."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("grams"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("docs") / docs_limit), F.ceil(F.col("grams") / grams_limit)).cast("long").alias("blocks"))
    return members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def dealt(placed: DataFrame, bins: int) -> DataFrame:
    """A row per pair of blocks that a member belongs to (i, j), and the bin of the task; small clusters share a bin."""
    rows = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    return rows.withColumn("bin", F.when(F.col("blocks") > 1, F.xxhash64("cluster", "i", "j")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins))))


def packed(text: str | None) -> bytes:
    return zlib.compress((text or "").encode("utf-8", "surrogatepass"), 1)


def unpacked(data: bytes) -> str:
    return zlib.decompress(data).decode("utf-8", "surrogatepass")


def block_links(pdf: pd.DataFrame, n: int, num: int, den: int) -> pd.DataFrame:
    """Links among the rows of each (cluster, i, j): all pairs of a block with i = j, else pairs across.

    Rows come with packed texts, which are a fraction of their sets; a text that is not its node's, because its
    identifier has several, is left out.
    """
    nodes, roots, counts = [], [], []
    for (_, i, j), rows in pdf.groupby(["cluster", "i", "j"], sort=False):
        found = [shingle_set(unpacked(t), n) for t in rows["packed"]]
        own = [first_digest(g) == k for g, k in zip(found, rows["node"], strict=True)]
        rows = rows.drop(columns="packed").assign(grams=pd.Series([signed(g) for g in found], rows.index, object))[own]
        rows = rows.drop_duplicates("node").sort_values(["block", "node"])
        if rows.empty:
            continue
        sets = list(rows["grams"])
        size, node, copies = np.array([len(s) for s in sets]), rows["node"].to_numpy(), rows["copies"].to_numpy()
        left = None if i == j else int((rows["block"] == i).sum())
        if left is not None and not 0 < left < len(sets):
            continue
        linked = plausible(size, list(map(cells_of, sets)), num, den, *([] if left is None else [rows["block"].to_numpy()]))
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            continue
        sets, size, node, copies = [sets[k] for k in some], size[some], node[some], copies[some]
        linked = linked[np.ix_(some, some)]
        if linked.sum() <= 8 * len(some):
            for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked[x, y] = linked[y, x] = den * both >= num * (size[x] + size[y] - both)
        else:
            both = overlaps(sets)
            linked &= den * both >= num * (size[:, None] + size[None, :] - both)
        some = linked.any(axis=1)
        nodes.append(node[some]), roots.append(node[forest(linked)][some]), counts.append((linked @ copies)[some])
    cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
    return pd.DataFrame({"node": cat(nodes), "root": cat(roots), "links": cat(counts)})


def jaccard_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, n_links.

    Two documents link when den * intersection >= num * union of their sets of n-word shingles. component_id is the
    smallest doc_id reachable by links, itself included; n_links counts the linked rows. Null and blank texts have no
    shingles and link with nothing, not with each other either. Rows that repeat an identifier and a text are linked as
    copies are; texts that share an identifier are told apart. Very long texts are taken whole, other columns ignored.
    Rows without an identifier link with equal sets only; their component_id is the smallest identifier there, or null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = common.kept(fragmented(texts, n, num, den), "fragments")
    # the numbers take most of the room and are read once: they go before sets are moved
    table = common.kept(keyed.drop("keys"), "sets")
    filled = table.where("n_shingles > 0")

    # classes of equal sets; the smallest identifier stands for each
    classes = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    classes = common.kept(classes.withColumn("node", F.col("k1")), "classes")
    repeated = classes.where("copies > 1").select("k1", "k2", "min_id")
    copies = filled.join(common.checked(repeated), ["k1", "k2"]).where("not (doc_id <=> min_id)").select("doc_id", "k1").distinct()
    copies = common.kept(copies, "copies")

    # candidates: sets that sent the same number for the same fragment
    sent = keyed.where("n_shingles > 0").join(common.checked(copies), ["doc_id", "k1"], "left_anti").select(F.explode("keys").alias("key"), F.col("k1").alias("sid"))
    w = Window.partitionBy("key")
    shared = common.kept(sent.withColumn("first", F.min("sid").over(w)).where("first <> sid").select("key", "first", "sid"), "shared")
    common.discard(copies, keyed)
    asked = common.kept(shared.select("sid").union(shared.select("first")).distinct(), "asked")
    # sets with one number are equal: any row has their cells
    cells = common.kept(filled.select(F.col("k1").alias("sid"), "n_shingles", "cells").join(common.checked(asked), "sid").dropDuplicates(["sid"]), "cells")
    common.discard(asked)

    # counts per cell let candidates pass, before any set is moved: against the first of a number, then what is not connected yet with each other
    side = lambda x: cells.select(F.col("sid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
    star = shared.select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    star = common.kept(first_links(star.select("a", "b", "na", "nb", "ca", "cb"), num, den), "first_links")
    labels = connected_components(star).select(F.col("node").alias("sid"), F.col("root").alias("label"))
    labelled = shared.join(labels, "sid", "left").select("key", F.col("sid").alias("node"), F.coalesce("label", "sid").alias("label"))
    apart = labelled.withColumns({"least": F.min("label").over(w), "most": F.max("label").over(w)}).where("least <> most")
    apart = common.kept(apart.select(F.col("key").alias("cluster"), "node", "label"), "apart")
    rows = placed_in_blocks(apart.join(cells.withColumnRenamed("sid", "node"), "node"), BLOCK_DOCS, 1 << 40)
    fine = dealt(rows, apart.count() // BLOCK_DOCS + 4).groupBy("bin").applyInPandas(lambda pdf: block_candidates(pdf, num, den), "a long, b long")
    clusters = connected_components(star.union(fine)).withColumnsRenamed({"root": "cluster"})
    common.discard(shared, cells, star, apart)

    common.collected(spark)

    # clusters to blocks
    members = classes.select("node", "min_id", "copies", "n_shingles").join(clusters, "node")
    placed = common.kept(placed_in_blocks(members, BLOCK_DOCS, BLOCK_GRAMS), "clusters")
    bins = int(placed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] // BLOCK_GRAMS) * 2 + 4
    chosen = texts.join(common.checked(placed), texts.doc_id == placed.min_id)

    def pack(batches):
        for b in batches:
            yield b.set_column(b.schema.get_field_index("text"), "packed", pa.array([packed(t) for t in b.column("text").to_pylist()], pa.binary()))

    with_texts = chosen.select("node", "cluster", "copies", "blocks", "block", "text").mapInArrow(pack, "node long, cluster long, copies long, blocks long, block long, packed binary")
    links = common.kept(dealt(with_texts, bins).groupBy("bin").applyInPandas(lambda pdf: block_links(pdf, n, num, den), "node long, root long, links long"), "links")
    common.discard(placed)
    components = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))

    # back to classes, then to rows
    found = classes.join(components.withColumnRenamed("root", "comp"), "node", "left").join(linked, "node", "left")
    found = found.select("k1", "k2", "min_id", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = found.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    resolved = common.kept(found.join(smallest, "comp").select("k1", "k2", "component_id", "n_links"), "resolved")
    common.discard(classes, links)
    none = table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return filled.select("doc_id", "n_shingles", "k1", "k2").join(resolved, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id", "n_links").unionByName(none)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))
