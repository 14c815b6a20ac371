"""MinHash near-duplicate detection by bottom-k sketches from one hash function.

1. Every text becomes a set of hashed word shingles. Its sketch is the ``k`` smallest hashes. Texts with equal
   sets form one class; from here on a class counts once, however many copies it has.
2. Retained values are counted over all classes. A linked pair shares at least half of either sketch (for
   k = 64 and a similarity of 0.85 a pair misses that once in 10^10), so with values ordered from rare to
   frequent, both meet in the first half of that order. Only these values are listed: values held once need
   no list, and passages many texts share drop out unless they are most of the text.
3. The full sets of listed texts tell how many of a text's shingles no other one holds. They bound the overlap a
   text can have with any other, so copies with too many edits of their own are ruled out without being compared.
4. Inverted lists yield pairs in three rounds. First the lists of each text's rarest few values compare their
   members with one leader, the member with fewest shingles of its own: a group of near copies comes together here. Then
   all lists do so, where members are of different components. Last, every member outside its list's largest
   component is compared with all members of other components, so no pair of a list is left out.
5. A pair passes if the overlap estimated from its union sketch is within reach, then its full sets are compared.
6. Links are joined to components by label spreading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from counterscope.llm.shared import components, counted_broadcast, likely, map_batches, one_of_each, staged, text_key, without
from counterscope.llm.words import shingle_sets, word_hashes

# A null doc_id has the largest id and is told from that by ``none``, so it comes last.
LAST_ID = 2**63 - 1
OWN = ("id", "none", "text_key")
# Standard deviations the estimate may lie below the threshold.
MARGIN = 6.0


def _scan(width: int, size: int, full: bool):
    """Map batches (id, none, text_key, text) to sets: their number, digest and sketch, or with ``full`` all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(1024, whole.num_rows * (1 << 23) // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                counts, nodes, values = [], [], []
                for found in shingle_sets(*word_hashes(batch.column("text")), width):
                    counts.append(len(found))
                    nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    values.append(found.tobytes() if full else found[:size].view(np.int64))
                kind = pa.binary() if full else pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("none"),
                        batch.column("text_key"),
                        pa.array(counts, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array(values, kind),
                    ],
                    ["id", "none", "text_key", "n_shingles", "node", "set" if full else "sketch"],
                )

    return run


def _row_schema(last: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("none", T.BooleanType()),
            T.StructField("text_key", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.BinaryType()),
            last,
        ]
    )


def _similar(percent: int, size: int):
    """Keep pairs that are similar: the union sketch must not rule it out, then the full sets decide."""
    threshold = percent / 100
    slack = MARGIN * (threshold * (1 - threshold)) ** 0.5
    last = np.uint64(2**64 - 1)

    def sketches_allow(x: np.ndarray, y: np.ndarray) -> bool:
        # up to here both sketches are complete
        bound = min(x[size - 1] if len(x) >= size else last, y[size - 1] if len(y) >= size else last)
        x, y = x[: np.searchsorted(x[:size], bound, "right")], y[: np.searchsorted(y[:size], bound, "right")]
        both = np.sort(np.concatenate([x, y]))
        shared = np.count_nonzero(both[1:] == both[:-1])
        union = len(both) - shared
        return shared / union >= threshold - slack / union**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                # sets are sorted, so a set begins with its sketch
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                similar = sketches_allow(x, y)
                if similar:
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = np.count_nonzero(both[1:] == both[:-1])
                    similar = 100 * shared >= percent * (len(both) - shared)
                keep.append(bool(similar))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _links(pairs: DataFrame, members: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) of nodes that are similar on their full sets, of staged candidate pairs."""
    sets = members.select("node", "set")
    first = counted_broadcast(pairs).join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}), "a")
    both = first.join(sets.withColumnsRenamed({"node": "b", "set": "set_b"}), "b")
    return map_batches(both, _similar(percent, size), "a binary, b binary")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct shingle set, with the least (id, none, text_key) of its texts."""
    return (
        rows.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min(F.struct(*OWN)).alias("least"),
            F.count("*").alias("copies"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
        )
    )


def _lists(classes: DataFrame) -> DataFrame:
    """Inverted lists (value, node, n) over the rarer half of each sketch, without values held once."""
    held = classes.select("node", F.size("sketch").alias("length"), F.explode("sketch").alias("value"))
    often = held.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1")
    order = Window.partitionBy("node").orderBy("holders", "value")
    alone = F.col("length") - F.count("*").over(Window.partitionBy("node"))
    return (
        held.join(often, "value")
        .withColumn("rare", F.row_number().over(order))
        .withColumn("alone", alone)
        .filter(F.expr("alone + rare <= length - length div 2 + 1"))
        .select("value", "node", "rare")
    )


def _alone(members: DataFrame) -> DataFrame:
    """How many shingles of a member no other member holds (node, alone); members without such are not listed."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, found in zip(batch.column("owner"), batch.column("set")):
                own = np.frombuffer(found.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), owner.as_py()))], ["value", "owner"])

    numbered = members.select("owner", "node")
    held = map_batches(members.select("owner", "set"), values, "value long, owner long")
    single = held.groupBy("value").agg(F.count("*").alias("holders"), F.min("owner").alias("owner")).filter("holders = 1")
    return single.groupBy("owner").agg(F.count("*").alias("alone")).join(numbered, "owner").select("node", "alone")


def _open(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """Lists with members of several components, each with the component most of them are in."""
    if found is None:
        lists = lists.withColumn("component", F.col("node"))
    else:
        lists = lists.join(counted_broadcast(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = staged(lists, "lists")
    sizes = lists.groupBy("value", "component").agg(F.count("*").alias("many"))
    tops = sizes.groupBy("value").agg(F.max(F.struct("many", "component")).alias("top"), F.count("*").alias("parts"))
    tops = staged(tops.filter("parts > 1").select(F.col("value").alias("of"), F.col("top.component").alias("top")), "tops")
    return staged(lists.join(counted_broadcast(tops), F.col("value") == F.col("of")).drop("of"), "open-lists")


def _components(lists: DataFrame, members: DataFrame, percent: int, size: int, few: int = 4) -> DataFrame | None:
    """Components over all links between members of lists (value, node, rare, n, alone), or None if there is no link."""
    links, found = None, None
    most = F.least(F.col("n") - F.col("alone"), F.col("leader.n") - F.col("leader.alone"))
    able = 100 * most >= percent * (F.col("n") + F.col("leader.n") - most)
    apart = F.col("component") != F.col("leader.component")
    leader = F.struct("alone", "node", "n", "component")
    for rounds in ("rarest", "leaders", "rest"):
        now = _open(lists.filter(F.col("rare") <= few) if rounds == "rarest" else lists, found)
        if now.isEmpty():
            continue
        if rounds == "rest":
            held = now.groupBy("node").agg(F.collect_list("value").alias("values"))  # a part of the sketch
            now = now.join(staged(held, "held"), "node")
            first = now.filter(F.col("component") != F.col("top")).select(
                F.col("value").alias("of"), leader.alias("leader"), F.col("values").alias("others")
            )
            # a pair comes from one list only: of two members outside the largest component once, and at the
            # least value both hold (both are in every open list of theirs, and together in no closed one)
            once = (F.col("component") == F.col("top")) | (F.col("node") < F.col("leader.node"))
            once = once & (F.array_min(F.array_intersect("values", "others")) == F.col("of"))
        else:
            first, once = now.groupBy(F.col("value").alias("of")).agg(F.min(leader).alias("leader")), F.lit(True)
        first = counted_broadcast(staged(first, "leaders"))
        pairs = now.join(first, (F.col("value") == F.col("of")) & apart & once & able)
        pairs = pairs.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
        more = staged(_links(staged(pairs, "pairs"), members, percent, size), "verified")
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            found = components(links)
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, size: int = 64) -> DataFrame:
    """Label every row (doc_id, text) with the component of near-duplicate texts it belongs to.

    Two texts are linked when 100 * |intersection| >= percent * |union| of their sets of ``width``-word
    shingles. ``size`` values are retained per sketch; 80 percent or more is safe with 64.

    Returns one row per input row: doc_id, text_key, n_shingles, component_id (least doc_id reachable),
    kept (doc_id is the component's), stays (exactly this text stays for its component; several equal
    rows may), copies. Null or wordless texts have an empty set and are linked with nothing. A null doc_id
    counts as the largest: such a row is labelled null only in a component without ids. Rows that repeat a doc_id with
    other text are texts of their own; of texts with one doc_id the one with the least hash goes first. Texts are read whole, whatever their
    length. An empty table gives no rows. Columns other than doc_id and text, whatever their names, are not read.
    """
    if percent < 80 or size < 64:
        raise ValueError("sketches of 64 values are safe from 80 percent on")
    given = F.col("doc_id").cast("long")
    texts = docs.select(
        F.coalesce(given, F.lit(LAST_ID)).alias("id"), given.isNull().alias("none"), text_key().alias("text_key"), F.col("text")
    )
    sketch = T.StructField("sketch", T.ArrayType(T.LongType()))
    rows = staged(map_batches(texts, _scan(width, size, False), _row_schema(sketch)), "sketches")
    classes = staged(_classes(rows), "classes")
    lists = staged(_lists(classes), "lists")
    listed = classes.join(lists.select("node").distinct(), "node", "left_semi")
    wanted = staged(listed.select(F.col("least.id").alias("id"), F.col("least.text_key").alias("text_key")), "wanted")
    # a text too many does no harm, as members are listed classes only; so no text is shuffled, however many are wanted
    again = likely(texts, F.xxhash64("id", "text_key"), wanted, F.xxhash64("id", "text_key")).filter("listed").drop("listed")
    whole = map_batches(again, _scan(width, size, True), _row_schema(T.StructField("set", T.BinaryType())))
    full = whole.groupBy("node").agg(F.first("set").alias("set"))
    members = full.join(listed.select("node", "n"), "node").withColumn("owner", F.monotonically_increasing_id())
    members = staged(members, "members")
    able = members.select("node", "n").join(_alone(members), "node", "left").fillna(0, ["alone"])
    able = able.filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    lists = staged(lists.join(able, "node").select("value", "node", "rare", "n", "alone"), "lists")
    found = _components(lists, members, percent, size)

    known = classes.select("node", "least", "copies")
    if found is None:
        named = known.filter("copies > 1").select("node", "least")
    else:
        labelled = found.join(known, "node")
        name = labelled.groupBy("component").agg(F.min("least").alias("least"))
        linked = labelled.select("node", "component").join(name, "component").select("node", "least")
        alone = known.filter("copies > 1").join(found, "node", "left_anti").select("node", "least")
        named = linked.unionByName(alone)
    named = counted_broadcast(staged(named, "names"))
    own = F.struct(*OWN)
    label = F.coalesce(F.col("least"), own)
    return (
        rows.drop("sketch")
        .join(named, "node", "left")
        .select(
            F.when(~F.col("none"), F.col("id")).alias("doc_id"),
            "text_key",
            "n_shingles",
            F.when(~label["none"], label["id"]).alias("component_id"),
            ((F.col("id") == label["id"]) & (F.col("none") == label["none"])).alias("kept"),
            (own == label).alias("stays"),
            F.col("least").isNotNull().alias("grouped"),
        )
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Keep one row of every component of near-duplicate texts; all columns stay, whatever their names.

    The row with the least doc_id stays, null last, and of texts with one doc_id the one with the least hash; of equal rows any
    one. Texts without words are linked with nothing and stay. An empty table stays empty.
    """
    rows = staged(near_duplicates(docs, percent), "near-rows")
    key = [F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")]
    dropped = rows.filter(~F.col("stays")).select(key).distinct()
    twice = rows.filter(F.col("stays") & F.col("grouped")).select(key).groupBy("drop_id", "drop_key").count()
    kept = without(docs, staged(dropped, "dropped"))
    return one_of_each(kept, staged(twice.filter("count > 1").drop("count"), "repeated"))
