"""Near-duplicate documents with an LSH forest of MinHash signatures.

1. A text becomes its set of word shingles, the set a digest and 128 minima. Equal sets
   form one class by digest; only the class member with the smallest id goes on.
2. 64 orders of the signatures (trees) start with four minima each, different ones. In each
   order a document's next neighbours with the same first four minima are candidates.
   They are those with the longest common prefix, so that depth adapts: in an empty
   region four equal minima suffice, in a crowded one neighbours agree on up to twelve. Two
   sets of similarity 0.8 agree on the first four in one of the first 32 trees alone with a
   chance of 1 - (1 - 0.8^4)^32 = 0.99999995. The first pass takes, in 32 trees, the next neighbours,
   and confirms each document's two likeliest; the second, once the links of the first are
   known, looks further in all trees, takes all that it finds, and passes over neighbours
   that are connected already. So a crowd of copies gives few candidates.
3. Candidates are confirmed on full sets, in cells of bounded size: the connected
   candidates of a region meet in one cell; if they are too many they are dealt to
   several, and what crosses cells is confirmed afterwards, first the best pair of any
   two groups, then all that still join different groups. A pair already connected needs
   no confirmation, since it cannot change a component. So a group of n copies costs
   about n confirmations, and no step holds a whole group or emits all its pairs.
4. Regions with more documents than the second pass looks at, of which not all are connected, are
   crowds. All their pairs that can be similar enough are found by the prefixes of their sets in order of
   frequency, and confirmed likewise; so in a crowd nothing is missed.
5. Components of the confirmed links give the result.

Null and empty texts have no set and are linked with nothing. Rows that share a
``doc_id`` count as one document, linked through each of their texts; a row with a null id
is dropped from the candidates and kept as its own component (null). Long texts are used
whole. An empty table gives an empty result. Columns other than id and text play no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from likeness.llm.components import components
from likeness.llm.words import VISIBLE, mix, runs, slices, words_of
from likeness.sources.checkpoints import written

HASHES = 128
#: Trees of the first pass, and of the second.
FEW_TREES = 32
TREES = 64
DEPTH = 4
DEEPER = 8
#: How many next neighbours the second pass looks at.
REACH = 4
#: How many of its candidates each document has confirmed in the first pass.
FIRST = 2
#: How many documents with one shingle meet in one part.
CROWD_ROWS = 1000
SLICE_BYTES = 1 << 19
#: About how many documents and shingles meet in one cell.
CELL_DOCS = 4000
CELL_SHINGLES = 2_000_000
# Which minima a tree compares, in order: runs of the signature, then steps of 32 through it.
_T, _J = np.arange(FEW_TREES)[:, None], np.arange(DEPTH + DEEPER)
MINIMA = np.concatenate([_T * DEPTH + _J, _T + 32 * (_J % 4) + 5 * (_J // 4)]) % HASHES
MULTIPLIERS = np.random.default_rng(77).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's begin."""
    words = words_of(texts, VISIBLE)
    low, high = words.first[:-1], words.first[1:]
    counts = np.where(high - low >= n, high - low - n + 1, np.minimum(high - low, 1))
    first = np.r_[0, np.cumsum(counts)]
    # A shingle that starts at word p of a long text; short texts are one shingle.
    long = np.repeat(high - low >= n, counts)
    start = np.arange(first[-1]) - np.repeat(first[:-1] - low, counts)
    values = np.empty(first[-1], np.uint64)
    values[long] = runs(words.hashes, n)[start[long]]
    for t in np.flatnonzero((high > low) & (high - low < n)):
        values[first[t]] = runs(words.hashes[low[t]:high[t]], high[t] - low[t])[0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][counts > 0]] = True
    kept = np.r_[0, np.cumsum(new)]
    return values[new], kept[first]


def forest_keys(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first minima (16 bits each) and the next (8 bits each), by tree and text."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((HASHES, len(first) - 1), np.uint32)
    product = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, MULTIPLIERS[k], out=product)
        np.minimum.reduceat(product, first[:-1], out=minima[k])
    head = np.zeros((TREES, len(first) - 1), np.uint64)
    tail = np.zeros_like(head)
    for j in range(DEPTH):
        head = head << np.uint64(16) | (minima[MINIMA[:, j]] & np.uint32(0xFFFF))
    for j in range(DEPTH, DEPTH + DEEPER):
        tail = tail << np.uint64(8) | (minima[MINIMA[:, j]] & np.uint32(0xFF))
    return head.view(np.int64), tail.view(np.int64)


def _signatures(n: int):
    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                values, first = shingle_sets(part.column("text"), n)
                size = np.diff(first)
                full = size > 0
                starts = np.r_[first[:-1][full], len(values)]
                digests = np.zeros((2, len(size)), np.uint64)
                trees = pa.array([], pa.struct([("head", pa.int64()), ("tail", pa.int64())]))
                if full.any():
                    digests[0, full] = np.add.reduceat(mix(values), starts[:-1])
                    digests[1, full] = np.add.reduceat(mix(values ^ np.uint64(0xABCDEF1234567)), starts[:-1])
                    head, tail = forest_keys(values, starts)
                    trees = pa.StructArray.from_arrays(
                        [pa.array(head.T.ravel()), pa.array(tail.T.ravel())], ["head", "tail"])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(size, pa.int64()),
                    pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(full * TREES)], pa.int32()), trees)],
                    ["doc_id", "n_shingles", "d1", "d2", "trees"])
    return run


def candidates(classes: DataFrame, reach: int) -> DataFrame:
    """``a, b, cell_a, cell_b, votes`` of forest neighbours that are not in one component.

    ``classes`` has ``node``, ``component``, ``cell`` and ``trees``.
    """
    order = W.partitionBy("tree", "head").orderBy("tail", "node")
    own = ["node", "component", "cell"]
    rows = classes.select(*own, F.posexplode("trees").alias("tree", "key")).select(
        "tree", *own, "key.head", "key.tail")
    following = F.array(*[F.lead(F.struct("node", "tail", "component", "cell"), i).over(order)
                          for i in range(1, reach + 1)])
    pairs = rows.withColumn("near", following).select("node", "tail", "cell", F.explode(F.filter(
        "near", lambda x: x.isNotNull() & (x["component"] != F.col("component")))).alias("n"))
    differing = F.col("tail").bitwiseXOR(F.col("n.tail"))
    common = F.lit(DEEPER)
    for i in range(DEEPER):  # bytes that agree, from the highest
        common = F.when(F.shiftrightunsigned(differing, 8 * i) != 0, F.lit(DEEPER - 1 - i)).otherwise(common)
    less = F.col("node") < F.col("n.node")
    return pairs.where("node <> n.node").select(
        F.least("node", "n.node").alias("a"), F.greatest("node", "n.node").alias("b"),
        F.when(less, F.col("cell")).otherwise(F.col("n.cell")).alias("cell_a"),
        F.when(less, F.col("n.cell")).otherwise(F.col("cell")).alias("cell_b"),
        (common + DEPTH).alias("depth")).groupBy("a", "b", "cell_a", "cell_b").agg(
            F.sum("depth").alias("votes"))


def likeliest(pairs: DataFrame, n: int) -> DataFrame:
    """The pairs that are among the ``n`` with most votes of either document."""
    order = W.partitionBy("doc").orderBy(F.col("votes").desc(), "a", "b")
    return pairs.withColumn("doc", F.explode(F.array("a", "b"))).withColumn(
        "place", F.row_number().over(order)).where(F.col("place") <= n).select("a", "b", "votes").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """``100 * intersection >= percent * union`` of two sorted sets."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def _sets(table: pa.Table, n: int) -> dict[int, np.ndarray]:
    column = table.column("text").combine_chunks()
    ids, sets = table.column("node").to_pylist(), {}
    for begin, end in slices(column, SLICE_BYTES):
        values, first = shingle_sets(column.slice(begin, end - begin), n)
        for i, a, b in zip(ids[begin:end], first[:-1].tolist(), first[1:].tolist()):
            sets.setdefault(i, []).append(values[a:b].copy())
    return sets


def _confirm_cell(n: int, percent: int):
    """Unites the documents of a cell along their pairs, the likeliest first."""
    def run(nodes: pa.Table, pairs: pa.Table) -> pa.Table:
        sets = _sets(nodes, n)
        parent = {i: i for i in sets}

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        pairs = pairs.sort_by([("votes", "descending"), ("a", "ascending"), ("b", "ascending")])
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            if a in sets and b in sets and (ra := root(a)) != (rb := root(b)) and any(
                    similar(x, y, percent) for x in sets[a] for y in sets[b]):
                parent[max(ra, rb)] = min(ra, rb)
        linked = [(i, root(i)) for i in parent if root(i) != i]
        return pa.table({"a": pa.array([x for x, _ in linked], pa.int64()),
                         "b": pa.array([y for _, y in linked], pa.int64())})
    return run


def _confirm_pairs(n: int, percent: int):
    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column("text_a"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                x, first_x = shingle_sets(part.column("text_a"), n)
                y, first_y = shingle_sets(part.column("text_b"), n)
                keep = [similar(x[first_x[i]:first_x[i + 1]], y[first_y[i]:first_y[i + 1]], percent)
                        for i in range(len(part))]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose sets are similar, each with its two texts in one row."""
    sides = [texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").mapInArrow(
        _confirm_pairs(n, percent), "a long, b long").distinct()


def _placed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node, cell`` of all documents with candidates; ``sizes`` has ``node, n_shingles``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        components(pairs), "node", "left").withColumn("region", F.coalesce("component", "node")).join(
            sizes, "node")
    regions = nodes.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    parts = regions.select("region", F.greatest(
        F.ceil(F.col("docs") / CELL_DOCS), F.ceil(F.col("shingles") / CELL_SHINGLES)).alias("parts"))
    total = regions.agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).first()
    cells = max(1, -(-4 * (total["docs"] or 0) // CELL_DOCS), -(-(total["shingles"] or 0) // CELL_SHINGLES))
    # A region of one part goes to a cell whole, one of several with a part to each.
    return written(nodes.join(parts, "region").select("node", F.pmod(F.xxhash64(
        "region", F.pmod(F.xxhash64("node"), "parts")), F.lit(cells)).cast("int").alias("cell")), "placed")


def _links(pairs: DataFrame, texts: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links enough to connect all that the candidates can connect.

    ``texts`` has ``node, cell, text``; ``known`` are links found before.
    """
    inside = pairs.where("cell_a = cell_b").select("a", "b", "votes", F.col("cell_a").alias("cell"))
    links = written(texts.groupBy("cell").cogroup(inside.groupBy("cell")).applyInArrow(
        _confirm_cell(n, percent), "a long, b long"), "links")
    across = pairs.where("cell_a <> cell_b").select("a", "b", "votes")
    for only_best in (True, False):
        if across.isEmpty():
            break
        found = components(known.unionByName(links))
        for side in "ab":
            label = found.select(F.col("node").alias(side), F.col("component").alias(f"root_{side}"))
            across = across.join(label, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        across = written(across.where("root_a <> root_b"), "across")
        tried = across
        if only_best:
            tried = across.groupBy(F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y")).agg(
                F.max_by(F.struct("a", "b"), F.struct("votes", "a", "b")).alias("p")).select("p.a", "p.b")
        links = links.unionByName(written(confirmed(tried, texts, n, percent), "links"))
        across = across.select("a", "b", "votes")
    return links


def crowded(known: DataFrame) -> DataFrame:
    """``node, component`` of documents in a region of a tree that the second pass did not see whole.

    A region (one head of one tree) of up to ``REACH + 1`` documents is seen whole, and one whose documents are all
    connected needs no more.
    """
    rows = known.select("node", "component", F.posexplode("trees").alias("tree", "key")).select(
        "node", "component", "tree", "key.head")
    regions = rows.groupBy("tree", "head").agg(
        F.count("*").alias("docs"), F.min("component").alias("low"), F.max("component").alias("high")).where(
            (F.col("docs") > REACH + 1) & (F.col("low") < F.col("high"))).select("tree", "head")
    return rows.join(regions, ["tree", "head"], "left_semi").select("node", "component").distinct()


def _listed(n: int):
    """Every shingle of each document, once."""
    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                values, first = shingle_sets(part.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("component"), lists], ["node", "component", "shingles"])
    return run


def prefix_pairs(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b, votes`` of all documents of different components that can be similar enough; none is left out.

    ``texts`` has ``node``, ``component`` and ``text``. Shingles are put in order of their frequency among these
    documents. Two sets of the wanted similarity share ``common`` shingles, at least ``percent`` of ``100 + percent``
    hundredths of both sizes; so the first that they share in this order stands so early in both that
    ``common`` are left from there. What many documents share comes last in
    the order and hardly ever so early. A shingle that many documents have there all the same is
    met in parts by parts, so that no task holds all its documents.
    """
    rows = texts.mapInArrow(_listed(n), "node long, component long, shingles array<long>").select(
        "node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy(F.col("shingle").alias("s")).agg(F.countDistinct("node").alias("docs")).where("docs > 1")
    # A shingle of one document alone is rarer than all others, and links to nothing.
    by_node = W.partitionBy("node", "size").orderBy(F.coalesce("docs", F.lit(1)), "shingle")
    left = F.col("size") - F.col("place") + 1
    prefix = written(rows.join(often, F.col("shingle") == F.col("s"), "left").withColumn(
        "place", F.row_number().over(by_node)).where(
            (100 * left >= percent * F.col("size")) & F.col("docs").isNotNull()).select(
                "node", "component", "size", "shingle", left.alias("left")), "prefixes")
    parts = prefix.groupBy("shingle").agg(F.ceil(F.count("*") / CROWD_ROWS).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = prefix.join(parts, "shingle").withColumn("own", own)
    fields = ["node", "component", "size", "left"]
    # x is the smaller set, or has the smaller id; as both are at least its size, it shares more.
    small = (100 + percent) * F.col("left") >= 2 * percent * F.col("size")
    x = split.where(small).select(F.struct(*fields).alias("x"), "shingle", F.col("own").alias("p"), every.alias("q"))
    y = split.select(F.struct(*fields).alias("y"), "shingle", every.alias("p"), F.col("own").alias("q"))
    first = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")))
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.size") + F.col("y.size"))
    return x.join(y, ["shingle", "p", "q"]).where(
        first & (F.col("x.component") != F.col("y.component")) & enough).groupBy(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.count("*").alias("votes"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``n`` words to a shingle; documents are linked if their sets' similarity is at least
    ``percent`` hundredths. ``component_id`` is the smallest id reachable through links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(_signatures(n), (
        "doc_id long, n_shingles long, d1 long, d2 long, trees array<struct<head:long,tail:long>>")), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["d1", "d2", "n_shingles"]
    members = full.groupBy(*digest).agg(F.min("doc_id").alias("node"))
    classes = full.join(members.withColumnRenamed("node", "doc_id"), [*digest, "doc_id"]).select(
        F.col("doc_id").alias("node"), "n_shingles", "trees")
    sizes = members.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    # Rows of one id hold together through it, rows of one class through their digest.
    links = full.join(members, digest).where("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    alone = classes.select("node", F.col("node").alias("component"), F.lit(0).alias("cell"), F.slice("trees", 1, FEW_TREES).alias("trees"))
    pairs = written(likeliest(candidates(alone, 1), FIRST), "candidates")
    placed = _placed(pairs, sizes)
    texts = written(docs.select(F.col("doc_id").alias("node"), "text").where("text IS NOT NULL").join(placed, "node"), "texts")
    ends = [placed.select(F.col("node").alias(s), F.col("cell").alias(f"cell_{s}")) for s in "ab"]
    links = links.unionByName(_links(pairs.join(ends[0], "a").join(ends[1], "b"), texts, links, n, percent))
    # What has a neighbour at all was placed with the first pass.
    known = classes.join(placed, "node").join(components(links), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    pairs = written(candidates(known, REACH), "candidates")
    links = links.unionByName(_links(pairs, texts, links, n, percent))
    found = components(links)
    # Regions that neighbours did not cover: all pairs that can be similar at all.
    crowd = written(crowded(known.drop("component").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))), "crowd")
    if not crowd.isEmpty():
        pairs = prefix_pairs(texts.drop("cell").join(crowd, "node"), n, percent)
        pairs = written(pairs.join(ends[0], "a").join(ends[1], "b"), "candidates")
        links = links.unionByName(_links(pairs, texts, links, n, percent))
        found = components(links)
    return rows.select("doc_id", "n_shingles").join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their component, with their own columns.

    Of repeated rows all stay that share the smallest id; give rows ids of their own.
    """
    dropped = near_duplicates(docs, n, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, n=4)
