"""Near-duplicate components by min-max hashing.

Each permutation of the shingle space gives two values of a set, its least and
its greatest image, so 80 hash evaluations give a signature of 160 values. Bands
of four values (two permutations) put sets of Jaccard similarity 0.75 together
in one of 40 bands but for about one pair in four million.

What keeps it linear and even:

* copies (equal shingle sets) become one class before banding;
* a bucket is joined as a star, every member to the one that shares most buckets
  with others (an original, among its edited copies), so a bucket of k sets gives
  k-1 candidate pairs; pairs inside one component need no test;
* where a bucket still holds several components after that, its members outside
  the largest are compared with all members in blocks of ``BLOCK``, on full sets
  inside the task; a block gives no more links than join its components. No
  bucket is capped or dropped;
* every link is confirmed on the two full shingle sets;
* components come from min-label propagation with pointer jumping on written
  tables, all joins and aggregates; only a count reaches the driver.

A shingle is compared by a 64-bit hash of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, keep_rows, sized_join, text_key

SHINGLE, SIMILARITY = 5, 75
PERMUTATIONS, BAND = 80, 4
BANDS = 2 * PERMUTATIONS // BAND
#: Members of a bucket that are compared with each other at once, and numbers in a matrix that does so.
BLOCK, WIDE = 512, 4 << 20
#: Bytes hashed at once; a text is cut between words into such parts.
PART = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SIG = "doc_id long, text_key binary, n long, digest binary, sig binary"


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A code for each byte (A-Z as a-z), powers of an odd base and their inverses
    modulo 2**64, and two constants for each permutation."""
    rng = np.random.default_rng(20240607)
    code = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    code[65:91] = code[97:123]
    base = 0x9E3779B97F4A7C15
    power = np.full(PART + 1, base, np.uint64)
    inverse = np.full(PART + 1, pow(base, -1, 2**64), np.uint64)
    power[0] = inverse[0] = 1
    perms = np.stack([rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1),
                      rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)])
    return code, np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64), perms


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``; words also end at ``cuts`` (there
    are none in data longer than a part, which is one text)."""
    code, power, inverse, _ = _constants()
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PART)
        if end < len(data):
            gap = np.flatnonzero(_SPACES[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # one word over a whole part
                rest = np.flatnonzero(_SPACES[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        part = data[at:end]
        word = ~_SPACES[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = cuts[(cuts > at) & (cuts < end)] - at
        begins[inner] = word[inner]
        starts = np.flatnonzero(begins)
        if len(starts):
            if len(part) > PART:  # the one long word
                got = np.zeros(1, np.uint64)
                for piece in (part[i:i + PART] for i in range(0, len(part), PART)):
                    got = _mix(got + (code[piece] * power[:len(piece)]).sum(dtype=np.uint64))
            else:
                stops = np.flatnonzero(word & np.append(begins[1:] | ~word[1:], True)) + 1
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[part] * power[:len(part)], dtype=np.uint64)])
                got = _mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
            hashes.append(got)
            places.append(starts + at)
        at = end
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(hashes) if hashes else empty), (np.concatenate(places) if places else empty.astype(np.int64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of five words (ASCII
    letters lower-cased); with fewer words the one of all of them; none if no word."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    k = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)
    first = 0
    while first < len(raw):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART, "right")) - 1)
        cuts = offsets[first:last + 1] - offsets[first]
        words, places = _word_hashes(data[offsets[first]:offsets[last]], cuts[1:-1])
        bounds = np.searchsorted(places, cuts)
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            windows = _mix(sum((words[i:i + n] * k[i] for i in range(SHINGLE)), np.zeros(n, np.uint64)))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                yield np.unique(windows[a:b - SHINGLE + 1])
            elif b > a:
                yield _mix(np.array([(words[a:b] * k[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)
        first = last


def _signature(hashes: np.ndarray) -> bytes:
    """Least and greatest image under each permutation, interleaved."""
    _, _, _, (factor, flip) = _constants()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 1024):
        image = (x[i:i + 1024, None] ^ flip) * factor
        np.minimum(low, image.min(0), out=low)
        np.maximum(high, image.max(0), out=high)
    return np.stack([low, high], 1).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, sig = [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sig.append(_signature(s) if len(s) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             pa.array(sig, pa.binary())], names=["doc_id", "text_key", "n", "digest", "sig"])
        pa.default_memory_pool().release_unused()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), sets], names=["row_id", "hashes"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets reach the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = 0
            if 100 * min(len(a), len(b)) >= SIMILARITY * max(len(a), len(b)):
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            keep.append(100 * both >= SIMILARITY * (len(a) + len(b) - both))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def _near(group: pa.Table) -> pa.Table:
    """Links between a block's queries and members of different components: all
    intersections at once, as products of 0/1 rows over the shingles that two or
    more sets have; of the pairs that reach the threshold, enough to join what
    they join."""
    query = np.array(group.column("query").to_pylist(), bool)
    ids, comp = group.column("row_id").to_numpy(), group.column("comp").to_numpy()
    order = np.argsort(query, kind="stable")  # members, then queries
    sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    sets, ids, comp, query = [sets[i] for i in order], ids[order], comp[order], query[order]
    first = int((~query).sum())
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    both = np.zeros((len(sets) - first, first))
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, WIDE // len(sets)))
    for left in range(0, columns, width):
        lo, hi = np.searchsorted(column, [left, left + width])
        rows = np.zeros((len(sets), width), np.float32)
        rows[owner[lo:hi], column[lo:hi] - left] = 1
        both += rows[first:] @ rows[:first].T
    union = sizes[first:, None] + sizes[None, :first] - both
    close = (100 * both >= SIMILARITY * union) & (comp[first:, None] != comp[None, :first])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for q, m in zip(*np.nonzero(close)):
        x, y = find(int(comp[first + q])), find(int(comp[m]))
        if x != y:
            parent[x] = y
            a.append(int(max(ids[first + q], ids[m])))
            b.append(int(min(ids[first + q], ids[m])))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for each end of the links (columns ``a, b``), the label being
    the least node of its component."""
    edges = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.write(edges.groupBy("a").agg(F.min("b").alias("b"))
                           .select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]) \
                     .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = scratch.write(step.join(jump, step["label"] == jump["via"])
                             .select("node", "old", F.least("label", "further").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old != label").isEmpty():
            return labels


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, text_key``.

    Sets of similarity 0.75 or more are linked; ``component_id`` is the least
    doc_id reachable. A text that is null or has no word has no shingles and is
    linked with nothing: its component is its own id. Null ids are linked like
    others but never name a component unless it has no other id; ``kept`` is
    ``doc_id <=> component_id``, so repeated rows of one id are all marked.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minmax")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
                         F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(source.mapInArrow(_sign, _SIG).withColumn("row_id", F.monotonically_increasing_id()))
    # written, as are other aggregates below that are joined back: Spark splits the large parts
    # of a join whose two sides are plain shuffles
    classes = scratch.write(signed.filter("n > 0").groupBy("digest").agg(
        F.min("row_id").alias("class"), F.min("doc_id").alias("least")))
    members = scratch.write(signed.drop("sig").join(classes, "digest", "left").drop("digest"))
    copies = members.filter("class != row_id").select("row_id")
    first = sized_join(signed.filter("n > 0"), copies, ["row_id"], "left_anti", 16)

    keys = first.select("row_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("sig", i * F.lit(4 * BAND) + F.lit(1), F.lit(4 * BAND))))).alias("key"))
    buckets = scratch.write(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    met = scratch.write(keys.join(buckets, "key"))
    scratch.drop(signed, buckets)
    # how many meetings a set has in its buckets: the text that others are copies of has the most
    degree = met.groupBy("row_id").agg(F.sum("size").alias("degree"))
    shared = scratch.write(met.join(degree, "row_id").select("key", "row_id", "degree"))
    scratch.drop(met)
    involved = scratch.write(shared.select("row_id").distinct())
    wanted = scratch.write(sized_join(members, involved, ["row_id"], "left_semi", 16).select("doc_id", "text_key", "row_id"))
    texts = sized_join(source, wanted.withColumnsRenamed({"doc_id": "d", "text_key": "t"}).select("d", "t", "row_id")
                       .withColumnsRenamed({"d": "doc_id", "t": "text_key"}), ["doc_id", "text_key"], "inner", 64)
    sets = scratch.write(texts.select("row_id", "text").mapInArrow(_sets, "row_id long, hashes binary")
                         .dropDuplicates(["row_id"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("row_id").alias("a"), F.col("hashes").alias("x")), "a") \
                    .join(sets.select(F.col("row_id").alias("b"), F.col("hashes").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")

    def star(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of each bucket's best-connected member with the others; linear in the rows."""
        best = F.max(F.struct("degree", (-F.col("row_id")).alias("row_id")))["row_id"]
        heads = scratch.write(rows.groupBy("key").agg((-best).alias("head")))
        return rows.join(heads, "key").filter("row_id != head").select(
            F.greatest("row_id", "head").alias("a"), F.least("row_id", "head").alias("b")).distinct(), heads

    pairs, heads = star(shared)
    links = scratch.write(confirmed(pairs))
    labels = components(links, scratch)
    # a head has met all of its bucket; the others of buckets that still hold several components
    # are compared in blocks, on their full sets
    others = shared.join(heads, "key").filter("row_id != head").drop("head")
    named = scratch.write(others.join(labels, others["row_id"] == labels["node"], "left")
                          .select("key", "row_id", F.coalesce("label", "row_id").alias("comp")))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("size"), F.count("*").alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main"))
    sizes = scratch.write(sizes.filter("comps > 1").drop("comps"))
    rest = scratch.write(named.join(sizes, "key").select(
        "key", "row_id", "comp", (F.col("comp") != F.col("main")).alias("minor"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    if not rest.isEmpty():
        # a bucket's members are dealt to blocks; those outside its largest component ask in every block,
        # dealt out likewise, so that a group has at most about BLOCK of both
        own = rest.withColumn("block", F.expr("cast(pmod(xxhash64(row_id), blocks) as int)")).withColumn("query", F.lit(False))
        own = own.withColumn("part", F.explode(F.expr("sequence(0, blocks - 1)")))
        ask = rest.filter("minor").withColumn("part", F.expr("cast(pmod(xxhash64(row_id, 1), blocks) as int)"))
        ask = ask.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("query", F.lit(True))
        cells = own.unionByName(ask).join(sets, "row_id")
        more = cells.select("key", "block", "part", "query", "row_id", "comp", "hashes").groupBy("key", "block", "part") \
                    .applyInArrow(_near, "a long, b long").distinct()
        links = scratch.write(links.unionByName(more))
        labels = components(links, scratch)

    ids = members.filter("row_id = class").select("class", "least")
    named = labels.join(ids, labels["node"] == ids["class"])
    ends = scratch.write(named.select("class", named["label"], "least"))
    names = ends.groupBy("label").agg(F.min("least").alias("name"))
    named = scratch.write(ends.join(names, "label").select("class", "name"))
    out = sized_join(members, named, ["class"], "left", 24)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("name", "least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged."""
    scratch = Scratch(docs.sparkSession, "minmax")
    return keep_rows(docs, near_components(docs, id_col, text_col, scratch), id_col, text_col, scratch)
