"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles. Under any one order of all shingles, two sets with Jaccard similarity t or
more share at least l shingles among the first ``n - ceil(t n) + l`` of each. Each document chooses its l by the
cost that the document frequencies of its prefix let expect, and a pair with choices l and l' is verified only if
the two prefixes share min(l, l') shingles.

The order takes a third of the shingles, chosen by hash, before the others and rare ones before frequent ones, so
the frequencies of that third suffice for all but small documents. Equal sets are one node from the start.
Documents whose prefix cannot hold enough shared shingles have no link. The others are grouped into clusters that
shared prefix shingles connect. A small cluster is one block. In a larger one documents that have their most shared
prefix shingle, their home, in common are cut into blocks of bounded size, and each prefix shingle tells, as bits, in
which blocks it occurs: a document meets only blocks in which one of its prefix shingles does. A task has the documents of two
blocks that meet the other one, and counts shared shingles of its pairs by products of incidence matrices. Only links
that change components leave it, so no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquiver.llm import _text
from sparkquiver.llm._components import components, roots
from sparkquiver.llm._keys import KEY, halves, key_of
from sparkquiver.llm._store import Store

#: Similarity as a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 75, 100
#: One in so many shingles comes first in the order.
FIRST_OF = 3
#: The longest prefixes require this many shared shingles; a document of n shingles at most n / 50, but one.
MOST_MATCHES = 8
#: What verifying one candidate costs, for each of its shingles, against reading one posting.
VERIFY_COST = 0.05
#: Documents and shingles in a block, on average, and the most blocks of one size class of a cluster.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 200_000
CLASS_BLOCKS = 1 << 40
#: So many rows of three numbers at most, some 40 MB, are broadcast to pick documents for verification; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def needed_overlap(n: np.ndarray) -> np.ndarray:
    """The fewest shingles of a set of ``n`` that a linked set shares with it."""
    return -(-NUMERATOR * n // DENOMINATOR)


def most_matches(n: np.ndarray) -> np.ndarray:
    return np.clip(n // 50, 1, MOST_MATCHES)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed hashes: 128 bits that depend on the set alone."""
    one = _text.mix(shingles + np.uint64(0x51ED270B))
    two = _text.mix(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return tuple(int(x) for x in np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)]).view(np.int64))  # type: ignore[return-value]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, k1, k2, n, first, digest, tokens) of each document. Of equal sets in a partition one has tokens."""
    row, seen = TaskContext.get().partitionId() << 33, set()
    for b in (part for whole in batches for part in _text.slices(whole)):
        out: list[tuple] = []
        tokens: list[np.ndarray] = []
        for _, sets in _text.document_shingles(_text.as_bytes(b.column(3))):
            for s in sets:
                digest = set_digest(s)
                first = s[s % np.uint64(FIRST_OF) == 0]
                n = len(s)
                need = n - int(needed_overlap(np.int64(n))) + int(most_matches(np.int64(n)))
                repeated = (n, digest) in seen
                seen.add((n, digest))
                all_ = len(first) < need
                tokens.append(s[:0] if repeated else s if all_ else first)
                out.append((row, n, len(first), all_, *digest))
                row += 1
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), b.column(0), b.column(1), b.column(2), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), _lists(tokens)],
            ["row", "id", "k1", "k2", "n", "first", "all", "d1", "d2", "tokens"])


def choose_prefix(n: int, first: int, all_: bool, token: np.ndarray, df: np.ndarray) -> tuple[int, np.ndarray]:
    """The required matches l and the shared shingles in the l-prefix, of those shingles that have a frequency over 1.

    An empty prefix means that the document has no link.
    """
    later = token.view(np.uint64) % np.uint64(FIRST_OF) != 0
    order = np.lexsort((token, df, later))
    token, df, later = token[order], df[order], later[order]
    n_first = int((~later).sum())
    # Place of each shared shingle in the order: unique ones come first within each part.
    place = np.arange(len(token)) + (first - n_first)
    if all_:
        place[n_first:] += (n - first) - (len(token) - n_first)
    reach = n - int(needed_overlap(np.int64(n)))
    best = (np.inf, 1, 0)
    postings = np.concatenate(([0], np.cumsum(df - 1)))
    for l in range(1, int(most_matches(np.int64(n))) + 1):
        k = int(np.searchsorted(place, reach + l))
        if k < l:
            return l, token[:0]
        cost = postings[k] * (1 + VERIFY_COST * n / l)
        if cost < best[0]:
            best = (cost, l, k)
    return best[1], token[: best[2]]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(4)
        flat, size = lists.flatten(), lists.value_lengths().to_numpy()
        token, df = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = np.cumsum(size)
        row, n, first, all_ = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        keep, matches, parts = [], [], []
        for i, (a, z) in enumerate(zip(ends - size, ends)):
            l, prefix = choose_prefix(int(n[i]), int(first[i]), bool(all_[i]), token[a:z], df[a:z])
            if len(prefix):
                keep.append(i)
                matches.append(l)
                parts.append(prefix.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(row[keep], pa.int64()), pa.array(matches, pa.int32()), _lists(parts)], ["row", "matches", "prefix"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, sets in _text.document_shingles(_text.as_bytes(b.column(1))):
            part = b.column(0).slice(a, len(sets))
            yield pa.RecordBatch.from_arrays([part, _lists(sets)], ["row", "tokens"])


def _shared_counts(of: list[np.ndarray], left: int) -> np.ndarray:
    """How many values each of the first ``left`` sets shares with each set; sets have distinct values."""
    size = np.array([len(x) for x in of])
    owner = np.repeat(np.arange(len(of)), size)
    _, value, times = np.unique(np.concatenate(of), return_inverse=True, return_counts=True)
    shared = times[value] > 1
    owner, value = owner[shared], value[shared]
    _, value = np.unique(value, return_inverse=True)
    total = np.zeros((left, len(of)), dtype=np.float32)
    if not len(value):
        return total
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    step = 1024
    for v in range(0, int(value[-1]) + 1, step):
        a, z = np.searchsorted(value, (v, v + step))
        dense = np.zeros((len(of), step), dtype=np.float32)
        dense[owner[a:z], value[a:z] - v] = 1
        total += dense[:left] @ dense.T
    return total


def link_block(n: np.ndarray, matches: np.ndarray, weight: np.ndarray, prefixes: list[np.ndarray], sets: list[np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the first ``left`` documents and the others, or among all if ``left`` is all of them.

    Returns the pairs' two sides and each document's weight of linked documents.
    """
    count = len(n)
    inner = left == count
    common = _shared_counts(prefixes, left)
    wanted = common >= np.minimum(matches[:left, None], matches[None, :])
    wanted &= (DENOMINATOR * np.minimum(n[:left, None], n[None, :]) >= NUMERATOR * np.maximum(n[:left, None], n[None, :]))
    if inner:
        np.fill_diagonal(wanted, False)
    else:
        wanted[:, :left] = False
    degree = np.zeros(count, dtype=np.int64)
    rows, cols = wanted.any(axis=1), wanted.any(axis=0)
    if not rows.any():
        none = np.empty(0, dtype=np.int64)
        return none, none, degree
    # Verification: exact overlaps of the documents that are in some candidate pair.
    i, j = np.flatnonzero(rows), np.flatnonzero(cols)
    if inner:
        overlap = _shared_counts([sets[k] for k in i], len(i)).astype(np.int64)
    else:
        overlap = _shared_counts([sets[k] for k in (*i, *j)], len(i))[:, len(i) :].astype(np.int64)
    union = n[i][:, None] + n[j][None, :] - overlap
    linked = wanted[np.ix_(i, j)] & (DENOMINATOR * overlap >= NUMERATOR * union)
    a, b = np.nonzero(linked)
    a, b = i[a], j[b]
    np.add.at(degree, a, weight[b])
    if inner:
        a, b = a[a < b], b[a < b]
    else:
        np.add.at(degree, b, weight[a])
    return a, b, degree


def _links(key, table):
    """(node, root, degree) of a task's documents that have links."""
    try:
        return _linked(key, table)
    finally:
        if table.num_rows > BLOCK_DOCS:  # as in the last place of ``_text.tidy``, but not for each of many small clusters
            _text.release()


def _linked(key, table):
    table = table.combine_chunks().sort_by("row")
    row = table.column("row").to_numpy()
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    table = table.filter(pa.array(first))
    left_block = key[1].as_py()
    in_left = table.column("block").to_numpy() == left_block
    at = np.concatenate([np.flatnonzero(in_left), np.flatnonzero(~in_left)])
    table = table.take(pa.array(at))
    row, n, matches, weight = (table.column(c).to_numpy() for c in ("row", "n", "matches", "weight"))

    def parts(name: str) -> list[np.ndarray]:
        lists = table.column(name).combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        return np.split(lists.flatten().to_numpy(), ends[:-1])

    left = int(in_left.sum())
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("degree", pa.int64())])
    if not left or (left == len(row)) != (key[1] == key[2]):
        return schema.empty_table()
    a, b, degree = link_block(n, matches, weight, parts("prefix"), parts("tokens"), left)
    if not len(a):
        return schema.empty_table()
    node, root = roots(a, b)
    return pa.table([pa.array(row[node]), pa.array(row[root]), pa.array(degree[node])], schema=schema)


def _bit(block):
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(block, F.lit(64)).cast("int"))


def block_tasks(alive: DataFrame, store: Store) -> DataFrame:
    """(row, cluster, block, b1, b2): the documents of each task, from ``alive`` (row, cluster, n, prefix, home).

    A document is in the tasks of its own block and of those in which one of its prefix shingles occurs, of its size class
    or the next ones, as sets of very different sizes cannot link. Clusters of one document have no task.
    """
    whole = store.put(alive.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).filter("docs > 1"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= 2 * BLOCK_SHINGLES)
    zero = F.lit(0).cast("long")
    single = alive.join(whole.filter(small), "cluster").select("row", "cluster", zero.alias("block"), zero.alias("b1"), zero.alias("b2"))
    large = whole.filter(~small).select("cluster")
    if large.isEmpty():
        return single
    octave = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")
    big = store.put(alive.join(large, "cluster").select("row", "cluster", octave.alias("octave"), "home", "n", "prefix"))
    # Documents of one home fill blocks of their own, spread by their numbers, or share blocks with those of other homes.
    share = F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)
    homes = store.put(big.groupBy("cluster", "octave", "home").agg(share.alias("share")))
    light = homes.filter("share < 0.5").groupBy("cluster", "octave").agg(F.ceil(F.sum("share")).alias("light"))
    heavy = homes.filter("share >= 0.5").select("cluster", "octave", "home", F.ceil("share").alias("parts"))
    before = Window.partitionBy("cluster", "octave").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks at most
    heavy = heavy.withColumn("before", F.coalesce(F.sum("parts").over(before), zero)).join(light, ["cluster", "octave"], "left").select(
        "cluster", "octave", "home", F.lit(True).alias("spread"), (F.coalesce("light", zero) + F.col("before")).alias("base"), "parts")
    light = homes.filter("share < 0.5").join(light, ["cluster", "octave"]).select(
        "cluster", "octave", "home", F.lit(False).alias("spread"), zero.alias("base"), F.col("light").alias("parts"))
    own = F.col("base") + F.pmod(F.xxhash64(F.when(F.col("spread"), F.col("row")).otherwise(F.col("home"))), F.col("parts"))
    placed = store.put(big.join(heavy.unionByName(light), ["cluster", "octave", "home"]).select("row", "cluster", "octave", "home", own.alias("block"), "prefix"))
    held = placed.select("row", "cluster", "octave", "block", "home", F.explode("prefix").alias("token"))
    masks = store.put(held.groupBy("token", F.col("octave").alias("there"), F.floor(F.col("block") / 64).alias("chunk")).agg(F.bit_or(_bit(F.col("block"))).alias("mask")))
    near = F.abs(F.col("octave") - F.col("there")) <= 1
    # A document meets the blocks of its home, and by its other shingles only what those add: in a group of near copies nothing.
    of_home = masks.withColumnsRenamed({"token": "home", "mask": "of_home"})
    adding = store.put(held.filter("token <> home").select("octave", "home", "token").distinct().join(masks, "token").filter(near)
                       .join(of_home, ["home", "there", "chunk"], "left")
                       .filter(F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("of_home", zero))) != 0)
                       .select("octave", "home", "token", "there", "chunk", "mask"))
    keys = ["row", "cluster", "octave", "block", "there", "chunk"]
    met = placed.join(of_home, "home").filter(near).select(*keys, F.col("of_home").alias("mask")).unionByName(
        held.join(adding, ["octave", "home", "token"]).select(*keys, "mask")).groupBy(*keys).agg(F.bit_or("mask").alias("mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("mask").bitwiseAND(_bit(k)) != 0)
    met = met.select("row", "cluster", (F.col("octave") * F.lit(CLASS_BLOCKS) + F.col("block")).alias("block"),
                     F.explode(F.transform(bits, lambda k: F.col("there") * F.lit(CLASS_BLOCKS) + F.col("chunk") * 64 + k)).alias("other"))
    return single.unionByName(met.select("row", "cluster", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, n_links, first, KEY).

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's set is its distinct five-word
    shingles, its whole sequence if it has fewer words, and empty without words. Two documents link if their sets'
    Jaccard similarity is 0.75 or more; all links are found. ``component_id`` is the smallest id that links reach,
    ``n_links`` counts the other rows that a row links with. A row with a null or empty text links with nothing and
    has its own id as component. Repeated rows link with each other. Null ids never become a component's id unless
    it has no other. A very long text is read whole; a worker's memory is some 60 times its bytes. ``first``: the row, or one of rows alike
    in id and text, that has the component's id; each row without words is. KEY: the row's content as a key. An
    empty table gives an empty result. Other columns are not read. Ids are compared as integers.
    """
    spark = docs.sparkSession
    store = Store(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows are found again by 128 bits of their content: rows alike in id and text may stand for each other.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    k1, k2 = halves(F.col("id"), F.col("text"))
    rows = rows.select("id", k1.alias("k1"), k2.alias("k2"), "text")
    sets = store.put(rows.mapInArrow(_text.tidy(_sets), "row long, id long, k1 long, k2 long, n long, first long, all boolean, d1 long, d2 long, tokens array<long>"))
    classes = store.put(sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("row").alias("row"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("least"), F.count("*").alias("weight")))

    postings = sets.select("row", F.explode("tokens").alias("token"))
    frequent = store.put(postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = postings.join(frequent, "token").groupBy("row").agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    heads = sets.select("row", "n", "first", "all", "k1", "k2").join(classes.select("row", "weight"), "row")
    prefixes = store.put(heads.select("row", "n", "first", "all").join(shared, "row").mapInArrow(_text.tidy(_prefixes), "row long, matches int, prefix array<long>"))
    store.drop(frequent)

    # What is in one document's prefix alone cannot match.
    tokens = prefixes.select("row", F.explode("prefix").alias("token"))
    centers = store.put(tokens.groupBy("token").agg(F.min("row").alias("center"), F.count("*").alias("n")).filter("n > 1"))
    matched = tokens.join(centers.withColumnRenamed("n", "having"), "token").groupBy("row").agg(
        F.collect_list("token").alias("prefix"), F.collect_set("center").alias("centers"), F.max(F.struct("having", "token"))["token"].alias("home"))
    alive = store.put(prefixes.select("row", "matches").join(matched, "row").filter(F.size("prefix") >= F.col("matches")).join(heads.drop("first", "all"), "row"))
    store.drop(prefixes, centers)
    edges = alive.select("row", F.explode("centers").alias("center"))
    cluster = components(edges, store)
    connected, alive = alive, store.put(alive.drop("centers").join(cluster.withColumnRenamed("node", "row"), "row", "left").select(
        "row", "n", "weight", "matches", "prefix", "home", "k1", "k2", F.coalesce("root", "row").alias("cluster")))
    store.drop(connected)
    tasks = store.put(block_tasks(alive, store))

    picked = alive.join(tasks.select("row").distinct(), "row", "left_semi")
    keys = picked.select("k1", "k2", "row")
    found = rows.select("k1", "k2", "text").join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, ["k1", "k2"])
    full = store.put(found.select("row", "text").mapInArrow(_text.tidy(_full_sets), "row long, tokens array<long>"))
    work = tasks.join(alive.select("row", "n", "weight", "matches", "prefix"), "row").join(full, "row")
    linked = store.put(work.groupBy("cluster", "b1", "b2").applyInArrow(_links, "node long, root long, degree long"))

    store.drop(full, tasks, alive)
    joined = components(linked.select("node", "root"), store)
    degree = linked.groupBy("node").agg(F.sum("degree").alias("degree")).withColumnRenamed("node", "row")
    labels = store.put(classes.join(joined.withColumnRenamed("node", "row"), "row", "left").join(degree, "row", "left").select(
        "n", "d1", "d2", "least", F.coalesce("root", "row").alias("root"), (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least = store.put(labels.groupBy("root").agg(F.min("least").alias("first")))
    labels = store.put(labels.join(least, "root").select("n", "d1", "d2", "first", "n_links"))
    heads = sets.select("id", "n", "d1", "d2", "k1", "k2")
    own = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    key = key_of(F.col("k1"), F.col("k2")).alias(KEY)
    out = heads.filter("n > 0").join(labels, ["n", "d1", "d2"]).select(
        "id", "n", F.col("first.id").alias("component_id"), "n_links", own.alias("first"), key).unionByName(
        heads.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"), key))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links", "first", KEY)
