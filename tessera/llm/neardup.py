"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct shingles (runs of words, lower case by ASCII).
Documents of equal sets are one class; classes carry a signature of
``COORDINATES`` minima. Each pair (coordinate, value) is a key; a class is
posted under the ``COORDINATES - matches + 1`` rarest of its keys by a sketch of
key counts, which any two classes that agree in ``matches`` coordinates must
share one of (prefix merging; the order by rarity keeps passages that many
documents hold out of the prefixes). Keys that only one class has are left out
at once. Pairs found at a key are looked at in three steps, each of which lets
most be skipped: by one bit of each coordinate and by the parities below, on
the remaining coordinates in full, and those with ``matches`` agreements on
their full sets.

Parities: a class keeps, for each of ``BUCKETS`` buckets, whether it has an odd
number of shingles there. Two sets differ in as many shingles at least as they
have unlike buckets, so a pair with too many of them for its sizes is no link.
This bound is exact; it parts the members of a large group of loose copies,
whose signatures all agree in more than ``matches`` coordinates.

No list yields all its pairs. In ``ROUNDS`` rounds every list has a leader, each
member is confirmed against the one of its lists' leaders that agrees with it
most, links join components, and lists that lie within one component are done.
A last round compares what is left across components, long lists in blocks,
each pair at the first key that both have. So a group of n copies costs n
comparisons a round, and every link that matters to the components has been
looked at.

``matches`` and the bit filter follow from the similarity: a pair just at it
fails either with a chance below ``MISS``, pairs above it with a smaller one.

Tables between the steps are written to the shared folder and removed once
their successors are there; a class's full set is fetched from its text once.

Nulls: a null or wordless text has an empty set and links with nothing; rows
with a null id are not linked; rows that repeat an id are judged by their own
sets; an empty table gives no rows; other columns are ignored, or kept by
``representatives``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import rolling
from tessera.llm.common import erase, slices, written
from tessera.llm.graph import components

COORDINATES, ROUNDS, LEADERS, BUCKETS = 64, 2, 2, 512
MISS = 1e-6  # chance with which a pair just at the threshold may fail the count, and the bit filter
SLOTS = 1 << 18  # of the sketch of key counts
MARKS = 1 << 26  # of the bitmap that tells which documents' sets are wanted
LIST_BLOCK = 256
_BATCH = 500_000
_PAIR_BYTES = 4_000_000  # of sets compared at a time
_RANDOM = np.random.default_rng(64)
_XOR = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _below(p: float, least: int) -> float:
    """Chance that fewer than ``least`` of the coordinates have what each has with chance p."""
    return sum(comb(COORDINATES, i) * p**i * (1 - p) ** (COORDINATES - i) for i in range(least))


def thresholds(percent: int) -> tuple[int, int]:
    """Agreements that a pair needs, and one-bit disagreements beyond which it is skipped."""
    j = percent / 100
    matches = max(m for m in range(1, COORDINATES + 1) if m == 1 or _below(j, m) < MISS)
    return matches, next(r for r in range(COORDINATES + 1) if r == COORDINATES or 1 - _below((1 - j) / 2, r + 1) < MISS)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle."""
    out = []
    for words in rolling.word_hashes_of([(t or b"").lower() for t in texts]):
        n = len(words)
        out.append(np.unique(rolling.windows(words, width if n >= width else n) ^ np.uint64(0 if n >= width else n * 0x51ED27)) if n else np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every non-empty set under each coordinate's permutation."""
    every = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat((every ^ _XOR[i]) * _MULTIPLY[i], begins) >> np.uint64(32)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of every set, one bit a bucket: whether an odd number of its shingles fall there; as 64-bit words."""
    bucket = (rolling.mixed(np.concatenate(sets)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(owner * BUCKETS + bucket, minlength=len(sets) * BUCKETS).reshape(-1, BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, signature, bits, parity) of every row; no signature for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, found, bits, parity = ([None] * len(sets) for _ in range(4))
            if full:
                minima = signatures([sets[i] for i in full])
                packed = np.packbits((minima & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0]
                for i, m, b, odd in zip(full, minima, packed.tolist(), parities([sets[i] for i in full]).tolist(), strict=True):
                    keys[i], found[i], bits[i], parity[i] = set_key(sets[i]), m.tobytes(), b, odd
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, pa.array(keys, pa.binary()), pa.array(found, pa.binary()), pa.array(bits, pa.int64()), pa.array(parity, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "set_key", "signature", "bits", "parity"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, bits long, parity array<long>")


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each signature, and the slots in which they are counted."""
    minima = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    keys = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32) | minima
    return keys, (rolling.mixed(keys) >> np.uint64(46)).astype(np.int64)


def key_counts(classes: DataFrame) -> np.ndarray:
    """How many keys of all classes fall into each slot; as large whatever the number of classes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_keys(batch.column(0))[1].ravel(), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["slot", "n"])

    rows = classes.select("signature").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefixes(classes: DataFrame, counts: np.ndarray, matches: int) -> DataFrame:
    """(node, keys): each class with the rarest of its keys, rarest first, in an order that is the same for all."""
    prefix = COORDINATES - matches + 1
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                keys, slots = _keys(part.column(1))
                rare = np.lexsort((keys, shared.value[slots]))[:, :prefix]
                chosen = np.take_along_axis(keys, rare, 1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, chosen.size + 1, prefix, dtype=np.int32)), pa.array(chosen.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "keys"])

    return classes.select("node", "signature").mapInArrow(choose, "node long, keys array<long>")


def _near(x: str, y: str, apart: int, percent: int) -> Column:
    """Whether the classes ``sketch_x`` and ``sketch_y`` may be a link, by bits, sizes and parities."""
    p, q = F.col(f"sketch_{x}"), F.col(f"sketch_{y}")
    both = p["n"] + q["n"]
    unlike = F.abs(p["n"] - q["n"])
    odd = sum((F.bit_count(p[f"p{i}"].bitwiseXOR(q[f"p{i}"])) for i in range(1, BUCKETS // 64)), F.bit_count(p["p0"].bitwiseXOR(q["p0"])))
    # sets that differ in d shingles have (both - d) / 2 in common and (both + d) / 2 in all
    links = [(100 + percent) * d <= (100 - percent) * both for d in (unlike, odd)]
    return links[0] & (F.bit_count(p["bits"].bitwiseXOR(q["bits"])) <= apart) & links[1]


def counted(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) that agree in ``matches`` coordinates at least, and in how many."""
    own = classes.select("node", "signature")
    both = pairs.join(own.toDF("a", "sig_a"), "a").join(own.toDF("b", "sig_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            n = (x == y).sum(1)
            keep = pa.array(n >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(n[n >= matches].astype(np.int32))], ["a", "b", "matches"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches int")


def _bytes_at(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def fetched(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, members): the full sets of classes (node, set_key, rep), from their texts in one pass over the documents.

    A bitmap by the hash of the id, MARKS / 64 words at most whatever the number of
    documents, keeps the other texts from leaving the scan; what it lets through
    is told apart by the set's key.
    """
    place = F.xxhash64("rep").bitwiseAND(F.lit(MARKS - 1))
    words = wanted.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(rep) & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    placed = docs.where("doc_id is not null").select("text", F.xxhash64("doc_id").bitwiseAND(F.lit(MARKS - 1)).alias("place"))
    marked = F.expr("shiftrightunsigned(mask, cast(place & 63 as int)) & 1 = 1")
    here = placed.join(F.broadcast(words), (F.shiftright("place", 6) == F.col("word")) & marked).select("text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BATCH):
            sets = shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "members"])

    sets = here.mapInArrow(sets_of, "set_key binary, members binary")
    return written(wanted.select("node", "set_key").join(sets, "set_key").select("node", "members").dropDuplicates(["node"]), "sets")


class Confirming:
    """Compares pairs of classes on their full sets, each of which it fetches once."""

    def __init__(self, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> None:
        self.classes, self.docs, self.width, self.percent = classes, docs, width, percent
        self.sets: list[DataFrame] = []

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach ``percent`` of their union in common."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for known in self.sets:
            nodes = nodes.join(known.select("node"), "node", "left_anti")
        wanted = written(nodes.join(self.classes.select("node", "set_key", "rep"), "node"), "wanted")
        if not self.sets or not wanted.isEmpty():
            self.sets.append(fetched(wanted, self.docs, self.width))
        erase(wanted)
        sets = self.sets[0]
        for more in self.sets[1:]:
            sets = sets.unionByName(more)
        both = pairs.select("a", "b").join(sets.toDF("b", "of_b"), "b").join(sets.toDF("a", "of_a"), "a")
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in slices(batches, "of_a", _PAIR_BYTES) for part in slices(iter([whole]), "of_b", _PAIR_BYTES)):
                keep = []
                for x, y in zip(_bytes_at(batch.column(2)), _bytes_at(batch.column(3)), strict=True):
                    every = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                    common = int((every[1:] == every[:-1]).sum())
                    keep.append(100 * common >= percent * (len(every) - common))
                yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

        return written(both.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long"), "links")


def shared_postings(prefixed: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, place, node, sketch) of the keys that more than one class is posted under."""
    posted = prefixed.select("node", F.posexplode("keys").alias("place", "key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sketch = F.struct(F.col("n_shingles").alias("n"), "bits", *(F.col("parity")[i].alias(f"p{i}") for i in range(BUCKETS // 64))).alias("sketch")
    kept = written(posted.join(shared, "key"), "shared")
    out = written(kept.join(classes.select("node", sketch), "node").select("key", "place", "node", "sketch"), "postings")
    erase(kept)
    return out


def _led(posted: DataFrame, of: DataFrame | None, turn: int, apart: int, percent: int) -> DataFrame:
    """Pairs of members with leaders of other components: every list has a leader of its own in every turn, and each
    member keeps the ``LEADERS`` of its lists' leaders that it is nearest to by its bits."""
    here = _placed(posted, of)
    lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("component").alias("of_a"), F.col("sketch").alias("sketch_a")))
    lists = here.groupBy("key").agg(lead.alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "lead.a", "lead.of_a", "lead.sketch_a")
    lists = written(lists, "leaders")  # a table of its own, so that the join's long lists can be split at run time
    met = here.withColumnRenamed("sketch", "sketch_b").join(lists, "key").where((F.col("component") != F.col("of_a")) & _near("a", "b", apart, percent))
    closest = F.bit_count(F.col("sketch_a.bits").bitwiseXOR(F.col("sketch_b.bits")))
    best = F.slice(F.sort_array(F.collect_set(F.struct(closest.alias("d"), F.col("a").alias("a")))), 1, LEADERS)
    return met.groupBy(F.col("node").alias("b")).agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def _placed(posted: DataFrame, of: DataFrame | None) -> DataFrame:
    if of is None:
        return posted.withColumn("component", F.col("node"))
    return posted.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _across(posted: DataFrame, prefixed: DataFrame, of: DataFrame, apart: int, percent: int) -> DataFrame:
    """All pairs across components that share a key, each at the first key that both have; lists dealt out in blocks of about ``LIST_BLOCK``."""
    here = _placed(posted, of)
    lists = here.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    lists = written(lists.select("key", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks")), "lists")
    earlier = F.slice("keys", 1, F.col("place"))
    alive = here.join(lists, "key").join(prefixed, "node")
    rows = written(alive.select("key", "node", "component", "sketch", "blocks", earlier.alias("before"), F.pmod(F.xxhash64(F.col("node") + 99), F.col("blocks")).cast("int").alias("block")), "blocks")
    left = rows.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("node").alias("a"), F.col("component").alias("of_a"), F.col("sketch").alias("sketch_a"), F.col("before").alias("before_a"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), F.col("component").alias("of_b"), F.col("sketch").alias("sketch_b"), F.col("before").alias("before_b"))
    first = ~F.arrays_overlap("before_a", "before_b")
    apart_here = (F.col("of_a") != F.col("of_b")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    met = left.join(right, ["key", "i", "j"]).where(apart_here & _near("a", "b", apart, percent) & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _merged(of: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of nodes after new links; nodes that stand alone have none."""
    if of is None:
        return written(components(links), "components")
    a = links.join(of.toDF("a", "of_a"), "a", "left").join(of.toDF("b", "of_b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    new = components(a)
    old = of.join(new.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = written(old.unionByName(new.join(old.select("node"), "node", "left_anti")), "components")
    erase(of)
    return out


def linked(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row a row: doc_id, text_key (a hash of its text), n_shingles, set_key, component_id, kept."""
    matches, apart = thresholds(percent)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(sketched(source, width), "sketches")
    sketch = [F.first(c).alias(c) for c in ("signature", "bits", "parity", "n_shingles")]
    grouped = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), *sketch)
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    prefixed = written(prefixes(classes, key_counts(classes), matches), "prefixes")
    posted = shared_postings(prefixed, classes)
    confirming = Confirming(classes, source, width, percent)
    of = None
    for turn in range(rounds + 1):
        pairs = _led(posted, of, turn, apart, percent) if turn < rounds else _across(posted, prefixed, of, apart, percent)
        found = counted(pairs, classes, matches)
        if turn < rounds:  # the best leader of each; what it may miss comes in the last round
            found = found.groupBy("b").agg(F.max_by("a", F.struct("matches", F.col("a"))).alias("a"))
        found = written(found.select("a", "b"), "pairs")
        links = confirming.links(found)
        of = _merged(of, links)
        erase(found, links)
    erase(prefixed, posted, *confirming.sets)
    placed = classes.select("node", "set_key", "rep").join(of, "node", "left").select("set_key", "rep", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = placed.join(least, "component").select("set_key", "component_id")
    whole = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(ids, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "text_key", "n_shingles", "set_key", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that their groups keep, with their own columns. Rows of one id and text go or stay together."""
    gone, key = (f"{name}_{uuid.uuid4().hex}" for name in ("dropped", "key"))  # names that no column of the input has
    dropped = linked(docs, width, percent).where("not kept").select(F.col("doc_id").alias(gone), F.col("text_key").alias(key)).distinct()
    same = (docs["doc_id"].cast("long") == F.col(gone)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key))
    return docs.join(dropped, same, "left_anti")
