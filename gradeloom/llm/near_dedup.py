"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import discard, ready, table, written
from gradeloom.llm.wordhash import mixed, shingle_set

#: At least so many bands of at most so many bins each (see ``layout``), and the chance that a pair at the threshold shares no band.
BANDS, ROWS, MISSED = 40, 8, 3e-6
#: Rows of two longs up to this many are broadcast (about 100 MB as a hash table), more of them joined by a shuffle.
MAX_BROADCAST_ROWS = 1_500_000
#: Ranges whose marks tell how close two documents may be.
MARKS = 640
_MARK_EDGES = (np.arange(MARKS, dtype=np.float64) / MARKS * 2.0**64).astype(np.uint64)
_NIBBLE = np.arange(16, dtype=np.uint64) * np.uint64(4)


@lru_cache
def layout(percent: int) -> tuple[int, int]:
    """(bands, bins in each) for a threshold: the largest bands with which a fifth more than ``BANDS`` miss at most ``MISSED`` of the pairs at it; 40 of 8 for 85, 42 of 6 for 80."""
    share = min(max(percent, 1), 99) / 100
    for rows in range(ROWS, 0, -1):
        count = max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-(share**rows))))
        if 5 * count <= 6 * BANDS:
            break
    return count, rows


@lru_cache
def _randoms(bins: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each bin begins, all bins in the order in which each looks for a value when it is empty, factors of a band's rows)."""
    draw = np.random.Generator(np.random.PCG64(99))
    probes = np.argsort(draw.random((bins, bins)), axis=1).astype(np.int16)
    return (np.arange(bins, dtype=np.float64) / bins * 2.0**64).astype(np.uint64), probes, draw.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, bins: int, rows: int) -> np.ndarray:
    """The least hash in each of ``bins`` equal ranges; an empty one takes that of the first full bin in its own random order."""
    edges, probes, _ = _randoms(bins, rows)
    first = np.searchsorted(shingles, edges)
    last = np.append(first[1:], len(shingles))
    full = first < last
    taken = np.where(full, shingles[np.minimum(first, len(shingles) - 1)] - edges, 0)
    if not full.all():
        empty = np.flatnonzero(~full)
        taken[empty] = taken[probes[empty, full[probes[empty]].argmax(1)]]
    return taken


def bands(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A hash for each band of the threshold's ``layout``."""
    count, rows = layout(percent)
    hashes = mixed(signature(shingles, count * rows, rows) + np.uint64(1)).reshape(count, rows)
    return mixed((hashes * _randoms(count * rows, rows)[2]).sum(1) + np.arange(count, dtype=np.uint64)).view(np.int64)


def marks(shingles: np.ndarray) -> np.ndarray:
    """Four bits of the least hash in each of ``MARKS`` equal ranges, 0 for an empty one, packed into longs."""
    first = np.searchsorted(shingles, _MARK_EDGES)
    full = first < np.append(first[1:], len(shingles))
    bits = np.where(full, np.uint64(1) + mixed(shingles[np.minimum(first, len(shingles) - 1)]) % np.uint64(15), np.uint64(0))
    return (bits.reshape(-1, 16) << _NIBBLE).sum(1, dtype=np.uint64).view(np.int64)


def may_link(percent: int, a: str = "marks", b: str = "hub_marks", n_a: str = "n", n_b: str = "hub_n") -> F.Column:
    """Whether two documents' marks are as close as those of a pair at the threshold can be.

    Of the ranges that either fills, a pair of similarity J agrees in a share of J: they sample the union
    without replacement. A pair is given up where it differs in more ranges than the threshold's share,
    by six standard deviations of that sampling and two ranges.
    """

    def filled(x: F.Column) -> F.Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    both = F.aggregate(F.zip_with(a, b, lambda x, y: filled(x.bitwiseXOR(y)) * 4096 + filled(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    off = 1 - percent / 100
    union = (F.col(n_a) + F.col(n_b)) / (2 - off)
    left = F.greatest(F.lit(0.1), 1 - (both % 4096) / union)
    return F.floor(both / 4096) <= off * (both % 4096) + 6 * F.sqrt((both % 4096) * off * (1 - off) * left) + 2


def node_of(shingles: np.ndarray) -> int:
    """A long that stands for the set: equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, *, key: str, text: str, percent: int) -> DataFrame:
    """(doc, n, node, bands) for every row: size of the shingle set, the set's node and its bands (null for an empty set)."""
    ready(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("_text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, found = [], [], []
            for x in batch.column(1):
                s = shingle_set(x.as_buffer().to_pybytes() if x.is_valid else None)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                found.append(bands(s, percent) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc", "n", "node", "bands"])

    return docs.mapInArrow(sketched, "doc long, n long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, *, key: str, text: str) -> DataFrame:
    """(node, shingles, marks) of the rows that ``wanted`` (doc, node; unique) names, from the whole texts; written."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("_text")).where("doc IS NOT NULL")
    few = wanted.count() <= MAX_BROADCAST_ROWS
    docs = docs.join(F.broadcast(wanted) if few else wanted, "doc").select("_text", "node")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                kept, sets, marked = [], [], []
                for x, node in zip(*batch.slice(at, 256).columns, strict=True):
                    s = shingle_set(x.as_buffer().to_pybytes() if x.is_valid else None)
                    if len(s) and node_of(s) == node.as_py():  # a key may have several texts
                        kept.append(node.as_py())
                        sets.append(s.view(np.int64))
                        marked.append(marks(s))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (sets, marked)]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), *lists], names=["node", "shingles", "marks"])

    sets = written(docs.mapInArrow(made, "node long, shingles array<long>, marks array<long>"), "sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # repeated rows
        whole, sets = sets, written(sets.dropDuplicates(["node"]), "sets")
        discard(whole)
    return sets


def confirmed(edges: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets have 100 * intersection >= ``percent`` * union."""
    left = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that is reachable.

    Rounds of large-star and small-star: edges move to smaller nodes until every component is a star
    around its smallest one. Minima are pre-aggregated and cut off by a written table, so that the
    join on a node with very many links can be split. The end is told by number and hash sum of the edges.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    told = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = told(edges)
    while True:
        # large-star: each neighbour that is larger than the node is linked to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the node and its smaller neighbours are linked to the smallest of them
        large = written(large, "large-star")
        smallest = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small, "links")
        discard(edges, least, large, smallest)
        now, edges = told(new), new
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def near_links(docs: DataFrame, members: DataFrame, *, key: str, text: str, percent: int) -> DataFrame:
    """Confirmed links (a, b) among ``members`` (node, doc, n, bands), whose sets are pairwise different; written.

    Each bucket of a band is tested as a star around its most central member: the one whose buckets
    are the largest in all, so that of copies with different changes the unchanged original is tested
    against all. Where a bucket then still holds several components, the members outside its largest
    one are hubs too: they are tested against the bucket's members of other components, if their marks
    are close enough for a link (see ``may_link``). So every two members of
    a bucket are connected, tested or too different, and a group that connects costs a star, not all pairs.
    Two members that share several buckets are paired in one of them only: as they are of different
    components, all of these buckets are split, and the pair is made where the bucket's hash is the least.
    """
    rows = members.select("node", "n", F.explode("bands").alias("hash"))  # a band's hash tells the band too
    sizes = written(rows.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    few = sizes.count() <= MAX_BROADCAST_ROWS
    buckets = written(rows.join(F.broadcast(sizes) if few else sizes, "hash"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    hub = F.struct("weight", (-F.col("node")).alias("node"), "n")
    hubs = buckets.join(weight, "node").groupBy("hash").agg(F.max(hub).alias("h"))
    hubs = written(hubs.select("hash", (-F.col("h.node")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    fits = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (F.col("node") != F.col("hub"))
    pair = F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    tested = written(buckets.join(hubs, "hash").where(fits).select(*pair).distinct(), "star-edges")
    wanted = members.select("doc", "node").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = shingle_sets(docs, wanted, key=key, text=text)
    links = written(confirmed(tested, sets, percent=percent), "confirmed")
    found = components(links)
    own = buckets.join(found, "node", "left").select("node", "n", "hash", F.coalesce("component", "node").alias("component"))
    own = written(own, "labelled")
    parts = own.groupBy("hash", "component").agg(F.count("*").alias("k")).groupBy("hash")
    parts = parts.agg(F.count("*").alias("parts"), F.max(F.struct("k", (-F.col("component")).alias("c"))).alias("most")).where("parts > 1")
    parts = written(parts.select("hash", (-F.col("most.c")).alias("main")), "split-buckets")
    inside = written(own.join(parts, "hash"), "apart")
    lists = inside.groupBy("node").agg(F.collect_list("hash").alias("hashes"))  # at most as many as there are bands
    known = written(lists.join(sets.select("node", "marks"), "node"), "marked")
    inside = written(inside.join(known, "node"), "apart")
    hubs_too = inside.where("component <> main").select("hash", *(F.col(c).alias("hub" if c == "node" else f"hub_{c}") for c in ("node", "n", "component", "marks", "hashes")))
    once = (F.col("component") == F.col("main")) | (F.col("node") < F.col("hub"))
    first = F.array_min(F.array_intersect("hashes", "hub_hashes")) == F.col("hash")
    pairs = inside.join(hubs_too, "hash").where(fits & F.expr("component <> hub_component") & once & first & may_link(percent)).select(*pair)
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "other-edges")
    more = written(links.union(confirmed(pairs, sets, percent=percent)), "confirmed")
    discard(sizes, buckets, hubs, tested, sets, links, own, parts, inside, known, pairs)
    return more


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """For every row: key, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of five-word
    shingles (words without ASCII white space, A-Z lower-cased; fewer words are one shingle). A component
    is all that links reach; its id is the smallest key in it, whose row is kept.

    An empty or null text has no shingles, is linked with nothing and is a component of its own. Equal
    texts are one node of the graph, so copies are never paired. Rows that share a key are one document
    with the links of all of them. A row with a null key takes part in no link; its component_id is
    null and it is kept. An empty table gives none; other columns are ignored.
    """
    rows = written(sketches(docs, key=key, text=text, percent=percent), "sketches")
    some = rows.where("doc IS NOT NULL AND n > 0")
    # what depends on the set alone is the same in all rows of a node
    classes = written(some.groupBy("node").agg(F.min("doc").alias("doc"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes")
    links = near_links(docs, classes, key=key, text=text, percent=percent)
    # rows that share a key belong together too
    shared = written(some.groupBy("doc").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("doc", "lo"), "shared-keys")
    links = links.union(some.select("doc", "node").join(shared, "doc").where("node <> lo").select("lo", "node").distinct())
    found = components(links).join(classes.select("node", "doc"), "node")
    least = written(found.groupBy("component").agg(F.min("doc").alias("component_id")), "components")
    named = written(found.join(least, "component").select("node", "component_id"), "named")
    member = some.select("doc", "node").join(classes.select("node", F.col("doc").alias("rep")), "node").join(named, "node", "left")
    named = member.groupBy("doc").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    out = rows.select("doc", "n").join(named, "doc", "left")
    component = F.coalesce("component_id", "doc")
    kind = docs.schema[key].dataType
    return out.select(F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS d, doc_id AS c FROM documents
  UNION
  SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.d
)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, documents.doc_id = m.c AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(c) AS c FROM reach GROUP BY d) m ON m.d = documents.doc_id
"""
