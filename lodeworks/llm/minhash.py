"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures (operator 4).

A document's set holds the 64-bit hashes of its 5-word shingles; its signature
holds, for each of ``CHUNKS * WIDTH`` hash functions, 16 bits of the smallest
value. Two signatures that differ in at most ``FAR = 2 * CHUNKS - 1`` places have, by
the pigeonhole principle, a chunk in which they differ in one place at most. So every
document is indexed once for each chunk and each place of it left out: all pairs
within that distance meet under a key, and are then checked on the full sets. (At a
similarity of 0.75 a pair lies beyond it once in 11,000; such a link is found only
by way of other documents.)

Documents with equal sets are one node. To find components, not all pairs under a
key are needed:

1. Each key's members are compared with its centre, the member that shares most
   keys with others. A group of near copies is linked up by that alone.
2. Keys whose members are in different components are left. Their members outside
   the centre's component are compared with all members, in blocks of a bounded
   size: first each with one block of a key, drawn by a hash of both, and the closest
   pairs between two components are checked on the full sets; then with all blocks.
3. Components that still meet, directly or through others, form a cluster. In it all
   documents but those of its largest component pass the inverted lists of all its
   documents, on the full sets, block by block: a block of documents asked for and
   one of documents asked have about ``LISTED`` shingles each, so that a task holds
   no more at any size of a cluster. What is sent grows with the documents outside
   the largest component times the cluster's blocks.

Edge cases: a null or empty text has an empty set and links with nothing; texts of
fewer than five words have one shingle; texts of any length pass whole; rows with a
null id belong to the class of their set and link like others, but cannot give a
component its id (a component of null ids only has a null id); of each component
exactly one row is kept, one with the smallest id, however often that row occurs;
rows that share an id but not a text are told apart; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import Scratch, broadcast_if_small, id_and_text, map_rows, tidy
from lodeworks.llm.components import connected_components

WORDS = 5
CHUNKS, WIDTH = 13, 4
PLACES = CHUNKS * WIDTH
#: Signature distance up to which all pairs meet and are checked on their sets.
FAR = 2 * CHUNKS - 1
#: Similarity, in hundredths, from which on documents link.
SIMILAR = 75
#: Members of a key that are compared in one piece.
BLOCK = 512
#: Closest partners of a document, outside its component, that are checked before whole clusters are searched.
CLOSEST = 4
#: Shingles of the documents of a cluster whose inverted lists are held at once.
LISTED = 1 << 17
BROADCAST_BYTES = 8 << 20
_KEPT_WORDS = 1 << 18
_ODD = np.random.default_rng(5).integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, for words met so far; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the different shingles. Bytes are lower-cased and split as the contract says: A-Z, [\\x20\\x09-\\x0D]."""
    parts = text.encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, parts), dtype=np.uint64, count=n)
    size = min(n, words)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = h * _P + w[j : n - size + 1 + j]
    return np.unique(mixed(h))


def signature(values: np.ndarray) -> bytes:
    low = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(low, (values[at : at + 1024, None] * _ODD).min(axis=0), out=low)
    return (mixed(low) >> np.uint64(48)).astype("<u2").tobytes()


def _signatures(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, PLACES)


def _base(docs: DataFrame) -> DataFrame:
    def start():
        hashes = WordHashes()

        def each(c):
            sets = [shingles(t, hashes) for t in c["text"]]
            return {"row": c["row"], "text_md5": c["text_md5"], "doc_id": c["doc_id"], "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sig": [signature(s) for s in sets]}

        return each

    kinds = [("row", T.LongType()), ("text_md5", T.StringType()), ("doc_id", T.LongType()), ("n", T.LongType()), ("digest", T.BinaryType()), ("sig", T.BinaryType())]
    return map_rows(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("text_md5", F.md5("text")), start, T.StructType([T.StructField(*k) for k in kinds]))


def _all_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of signatures, for each chunk and each place of it left out."""
    sigs = sigs.astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
    out = np.empty((len(sigs), CHUNKS, WIDTH), dtype=np.uint64)
    for gone in range(WIDTH):
        key = np.zeros((len(sigs), CHUNKS), dtype=np.uint64)
        for j in (j for j in range(WIDTH) if j != gone):
            key = (key << np.uint64(16)) | sigs[:, :, j]
        out[:, :, gone] = mixed(key ^ mixed(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gone + 1)))
    return out.reshape(-1, PLACES).view(np.int64)


def _keys(batches):
    """(key, node) of each signature."""
    for batch in batches:
        keys = _all_keys(_signatures(batch.column("sig").to_pylist()))
        nodes = np.repeat(batch.column("node").to_numpy(), PLACES)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], names=["key", "node"])


def _has_first(sigs: np.ndarray, q: np.ndarray, t: np.ndarray, key: int) -> np.ndarray:
    """For rows q and t of the signatures, pair by pair, whether ``key`` is the first one they have in common."""
    out = np.zeros(len(q), dtype=bool)
    for at in range(0, len(q), 4096):  # a bounded number of pairs at once
        x, y = sigs[q[at : at + 4096]].reshape(-1, CHUNKS, WIDTH), sigs[t[at : at + 4096]].reshape(-1, CHUNKS, WIDTH)
        off = x != y
        chunk = (off.sum(axis=2) <= 1).argmax(axis=1)
        row = np.arange(len(x))
        gone = off[row, chunk].argmax(axis=1)
        own, value = x[row, chunk].astype(np.uint64), np.zeros(len(x), dtype=np.uint64)
        for j in range(WIDTH):
            value = np.where(gone == j, value, (value << np.uint64(16)) | own[:, j])
        value = mixed(value ^ mixed((chunk * WIDTH + gone + 1).astype(np.uint64)))
        out[at : at + 4096] = value.view(np.int64) == key
    return out


def _near(batches):
    """Pairs (a, b) within the signature distance and with sizes that allow the similarity."""
    for batch in batches:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        near = (_signatures(c["sig_a"].to_pylist()) != _signatures(c["sig_b"].to_pylist())).sum(axis=1) <= FAR
        n_a, n_b = c["n_a"].to_numpy(), c["n_b"].to_numpy()
        near &= 100 * np.minimum(n_a, n_b) >= SIMILAR * np.maximum(n_a, n_b)
        yield pa.RecordBatch.from_arrays([pa.array(c["a"].to_numpy()[near]), pa.array(c["b"].to_numpy()[near])], names=["a", "b"])


def _similar(batches):
    """Pairs whose full sets are similar."""
    for batch in batches:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k in range(batch.num_rows):
            x, y = (np.frombuffer(c[s][k].as_buffer(), dtype="<u8") for s in ("set_a", "set_b"))
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep[k] = 100 * common >= SIMILAR * (len(both) - common)
        yield pa.RecordBatch.from_arrays([pa.array(c["a"].to_numpy()[keep]), pa.array(c["b"].to_numpy()[keep])], names=["a", "b"])


def _across(closest: int | None):
    """Pairs (a, b) of rows sorted by (key, i, j): targets of block i, queries of block j, of different components.

    With ``closest``, these are a query's closest documents of other components; without, components, as many pairs
    of them as it takes to join those that are close. A pair of documents then counts only under its first key.
    """

    def one(c: dict[str, np.ndarray], found: list) -> None:
        query = c["query"]
        if not query.any() or query.all():
            return
        q, t = np.flatnonzero(query), np.flatnonzero(~query)
        far = np.zeros((len(q), len(t)), dtype=np.uint8)
        for k in range(PLACES):
            far += c["sig"][q, k][:, None] != c["sig"][t, k]
        small, large = np.minimum(c["n"][q][:, None], c["n"][t]), np.maximum(c["n"][q][:, None], c["n"][t])
        x, y = np.nonzero((far <= FAR) & (c["component"][q][:, None] != c["component"][t]) & (100 * small >= SIMILAR * large))
        if closest is None:
            q, t = q[x], t[y]
            first = _has_first(c["sig"], q, t, c["key"][0])
            a, b = _forest(c["component"][q[first]], c["component"][t[first]])
        else:
            far = far[x, y]
            order = np.lexsort((t[y], far, x))
            x, y = x[order], y[order]
            at = np.arange(len(x))
            new = np.ones(len(x), dtype=bool)
            new[1:] = x[1:] != x[:-1]
            near = at - np.maximum.accumulate(np.where(new, at, 0)) < closest
            a, b = c["node"][q[x[near]]], c["node"][t[y[near]]]
        if len(a):
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))

    def pairs(found):
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _by_group(("key", "i", "j"), one, pairs)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the same values as the pairs (a, b): each value with the smallest one it is joined with."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(values))
    while True:
        was = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = np.minimum(root, root[root])
        if (root == was).all():
            break
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]


def _by_group(keys: tuple[str, ...], one, out):
    """Function for ``mapInArrow`` over sorted rows: ``one(columns, found)`` for each group, ``out(found)`` for what it found."""

    def column(name, values):
        return _signatures(values.to_pylist()) if name == "sig" else values.to_numpy(zero_copy_only=False)

    def run(batches):
        held: list[dict[str, np.ndarray]] = []  # parts of a group whose end has not come yet

        def whole():
            return {name: np.concatenate([part[name] for part in held]) for name in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: column(name, batch.column(k)) for k, name in enumerate(batch.schema.names)}
            new = np.zeros(batch.num_rows - 1, dtype=bool)
            for k in keys:
                new |= c[k][1:] != c[k][:-1]
            cuts, found = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows], []
            if held and any(held[-1][k][-1] != c[k][0] for k in keys):
                one(whole(), found)
                held = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held.append({name: v[lo:hi] for name, v in c.items()})
                if hi < batch.num_rows:
                    one(whole(), found)
                    held = []
            if found:
                yield out(found)
        if held:
            one(whole(), found := [])
            if found:
                yield out(found)

    return run


def _linked(c: dict[str, np.ndarray], found: list) -> None:
    """Of one block of a cluster and the documents that pass it: a link of each to every other component that it has one with."""
    targets, queries = np.flatnonzero(~c["query"]), np.flatnonzero(c["query"])
    if not len(targets) or not len(queries):
        return
    sets = [np.frombuffer(c["set"][t], dtype="<u8") for t in targets]
    sizes, component = np.array([len(s) for s in sets]), c["component"][targets]
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    for q in queries:
        own = np.frombuffer(c["set"][q], dtype="<u8")
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owners[at], minlength=len(sets))
        hit = np.flatnonzero((100 * common >= SIMILAR * (sizes + len(own) - common)) & (component != c["component"][q]))
        found += [(c["node"][q], c["node"][targets[hit[k]]]) for k in np.unique(component[hit], return_index=True)[1]]


def _link_rows(found: list):
    a, b = np.array(found, dtype=np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_md5) for each row."""
    scratch = Scratch(df.sparkSession, "minhash")
    docs = id_and_text(df, id_col, text_col)
    base = scratch.write(_base(docs), "base")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    nodes = base.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.max("n").alias("n"), F.max("sig").alias("sig"), first)
    nodes = scratch.write(nodes, "nodes")
    ends = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))

    keys = nodes.select("node", "sig").mapInArrow(tidy(_keys), "key long, node long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = scratch.write(shared, "counts")
    shared = scratch.write(keys.join(shared, "key"), "shared")
    known = scratch.write(shared.groupBy("node").agg(F.sum("members").alias("known")), "known")
    centre = shared.join(known, "node").groupBy("key").agg(F.max(F.struct("known", (-F.col("node")).alias("minus"))).alias("best"))
    centre = scratch.write(centre.select("key", (-F.col("best.minus")).alias("centre")), "centres")
    star = shared.join(centre, "key").where(F.col("node") != F.col("centre"))
    star = scratch.write(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "star")
    close = star.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(tidy(_near), "a long, b long")
    close = scratch.write(close, "close-0")
    edges = scratch.write(_checked(scratch, docs, nodes, close, 0), "edges-0")
    labels = connected_components(edges)
    met = _meeting(scratch, shared, centre, labels, nodes, 1, drawn=True)
    closest = scratch.write(met.mapInArrow(tidy(_across(CLOSEST)), "a long, b long").distinct(), "closest")
    if not closest.isEmpty():
        new = scratch.write(closest.join(close, ["a", "b"], "left_anti"), "close-1")
        if not new.isEmpty():
            edges = scratch.write(edges.union(_checked(scratch, docs, nodes, new, 1)), "edges-1")
            labels = connected_components(edges)
        met = _meeting(scratch, shared, centre, labels, nodes, 2)
        apart = scratch.write(met.mapInArrow(tidy(_across(None)), "a long, b long").distinct(), "apart")
        if not apart.isEmpty():
            edges = scratch.write(edges.union(_searched(scratch, docs, nodes, apart, labels)), "edges-2")
            labels = connected_components(edges)
    classes = nodes.select("digest", "node", "first").join(labels, "node", "left")
    classes = scratch.write(classes.select("digest", F.coalesce("component", "node").alias("component"), "first"), "labelled")
    best = scratch.write(classes.groupBy("component").agg(F.min("first").alias("best")), "best")
    classes = classes.select("digest", "component").join(best, "component")
    classes = scratch.write(classes.select("digest", F.col("best.doc_id").alias("component"), F.col("best.row").alias("chosen")), "classes")
    scratch.keep("base", "classes")
    out = base.select("row", "doc_id", "n", "digest", "text_md5").join(classes, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("row") == F.col("chosen"), F.lit(True)).alias("kept"), "text_md5")


def _sets(scratch: Scratch, docs: DataFrame, nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(node, set) of the nodes in ``asked`` (node), made anew from their texts."""
    wanted = nodes.join(asked.distinct(), "node", "left_semi").select("node", "digest", F.col("first.doc_id").alias("id"))
    wanted = scratch.write(wanted, f"wanted-{k}")
    ids = wanted.select("id").distinct()
    ids = broadcast_if_small(scratch, scratch.write(ids, f"asked-{k}"), f"asked-{k}", BROADCAST_BYTES)

    def start():
        hashes = WordHashes()

        def each(c):
            sets = [shingles(t, hashes) for t in c["text"]]
            return {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "set": [s.astype("<u8").tobytes() for s in sets]}

        return each

    kind = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("set", T.BinaryType())])
    sets = map_rows(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), start, kind)
    once = broadcast_if_small(scratch, wanted.select("node", "digest"), f"wanted-{k}", BROADCAST_BYTES)
    if _repeat(docs, ids):  # ids that are null or repeat bring more rows than nodes
        sets = sets.join(once.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("set").alias("set"))
    return scratch.write(sets.join(once, "digest").select("node", "set"), f"sets-{k}")


def _repeat(docs: DataFrame, ids: DataFrame) -> bool:
    """Whether any of the ids belongs to more than one row."""
    rows = docs.select("doc_id").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _checked(scratch: Scratch, docs: DataFrame, nodes: DataFrame, close: DataFrame, k: int) -> DataFrame:
    """The pairs of ``close`` (a written table) that are similar by their full sets."""
    sets = _sets(scratch, docs, nodes, close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))), k)
    of = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"set_{s}"))
    return close.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(_similar), "a long, b long")


def _meeting(scratch: Scratch, shared: DataFrame, centre: DataFrame, labels: DataFrame, nodes: DataFrame, k: int, drawn: bool = False) -> DataFrame:
    """Members of the keys that have more than one component, dealt to blocks: sorted (key, i, j, query, node, component, n, sig).

    A query goes to all blocks of a key, or with ``drawn`` to one, so that what it finds does not grow with the key's members.
    """
    members = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    main = centre.join(labels, F.col("centre") == F.col("node"), "left").select("key", F.coalesce("component", "centre").alias("main"))
    members = members.join(main, "key").withColumn("out", F.col("component") != F.col("main"))
    members = scratch.write(members.select("key", "node", "component", "out"), f"members-{k}")
    open_keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if("out").alias("outside")).where("outside > 0")
    open_keys = scratch.write(open_keys, f"open-{k}")
    at = lambda of: F.pmod(F.xxhash64("node"), F.ceil(F.col(of) / BLOCK)).cast("int")
    parts = lambda of: F.sequence(F.lit(0), F.ceil(F.col(of) / BLOCK).cast("int") - 1)
    rows = members.join(open_keys, "key").join(nodes.select("node", "n", "sig"), "node")
    targets = rows.select("key", at("all").alias("i"), F.explode(parts("outside")).alias("j"), F.lit(False).alias("query"), "node", "component", "n", "sig")
    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("all") / BLOCK)).cast("int") if drawn else F.explode(parts("all"))
    queries = rows.where("out").select("key", block.alias("i"), at("outside").alias("j"), F.lit(True).alias("query"), "node", "component", "n", "sig")
    return targets.unionByName(queries).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _searched(scratch: Scratch, docs: DataFrame, nodes: DataFrame, apart: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between the components that ``apart`` (a, b) joins to clusters: at least one for each two of them that have any."""
    clusters = connected_components(apart).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    placed = nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    placed = scratch.write(placed.join(clusters, "component"), "placed")
    sizes = placed.groupBy("cluster", "component").agg(F.sum("n").alias("size"))
    largest = F.max(F.struct("size", "component")).alias("largest")
    sizes = sizes.groupBy("cluster").agg(F.sum("size").alias("all"), largest)
    blocks = lambda c: F.ceil(c / LISTED).cast("int")
    sizes = sizes.select("cluster", F.col("largest.component").alias("main"), blocks(F.col("all")).alias("n_i"), blocks(F.col("all") - F.col("largest.size")).alias("n_j"))
    sized = placed.join(scratch.write(sizes, "sizes"), "cluster")
    columns = "cluster", "i", "j", "query", "node", "component"
    own = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    targets = sized.withColumn("i", own("n_i")).withColumn("j", every("n_j")).withColumn("query", F.lit(False)).select(*columns)
    queries = sized.where("component <> main").withColumn("j", own("n_j")).withColumn("i", every("n_i")).withColumn("query", F.lit(True)).select(*columns)
    rows = scratch.write(targets.unionByName(queries), "to-search")
    sets = _sets(scratch, docs, nodes, placed.select("node"), 2)
    keys = "cluster", "i", "j"
    dealt = rows.join(sets, "node").select(*columns, "set").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(_by_group(keys, _linked, _link_rows)), "a long, b long")
