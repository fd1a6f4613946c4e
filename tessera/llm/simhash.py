"""SimHash near-duplicates found with a covering family of bit masks.

Two fingerprints that differ in at most ``radius`` bits are guaranteed to agree under at least one
mask, so the candidate search misses nothing:

* every bit position gets a non-zero vector of ``radius + 1`` bits;
* mask ``v`` (one for each non-zero ``v``) keeps the positions whose vector is not orthogonal to ``v``;
* the vectors of at most ``radius`` differing positions span less than the whole space, so some
  ``v`` is orthogonal to all of them, and the mask of that ``v`` hides every difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.storage import discard, materialize

#: Buckets up to this size are compared pair by pair; larger ones by stars around shared neighbours.
PAIRWISE_BUCKET = 32
_BLOCK = 1 << 15
_CACHE = 300_000
_PAIRS_PER_SALT = 1000
#: Fingerprints of a text's word set, an even number: at similarity 0.8 about every second pair collides under one.
_PRINTS = 6


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = [digest(g, 42) for g in grams]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.frombuffer(b"".join(hashes[at : at + _BLOCK]), dtype=np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The ``2**(radius+1) - 1`` masks, as unsigned numbers; position i uses vector 1 + i mod their count."""
    family = (1 << (radius + 1)) - 1
    vectors = [1 + i % family for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2 == 1)
        for v in range(1, family + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _close(radius: int):
    return F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(src, dst)`` that connect exactly the fingerprints ``fps(fp)`` connects at ``radius``.

    ``fps`` holds distinct fingerprints; ``radius`` is 1 to 4.  In a bucket of at most
    ``PAIRWISE_BUCKET`` members every close pair is emitted, so the pairs stay linear in the rows.
    Members of larger buckets are linked through neighbouring fingerprints instead (see
    ``_neighbour_stars``), which gives the same connected components without listing a group's pairs.
    """
    if not 1 <= radius <= 4:
        raise ValueError(f"radius {radius} is not from 1 to 4")
    keys = F.array(
        *[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks(radius))]
    )
    banded = fps.select("fp", F.explode(keys).alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialize(banded.join(sizes, "key"), "buckets")
    small = shared.filter(F.col("size") <= PAIRWISE_BUCKET)
    pairs = (
        small.alias("a")
        .join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _close(radius))
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    crowded = shared.filter(F.col("size") > PAIRWISE_BUCKET).select("fp").distinct()
    return pairs.unionByName(_neighbour_stars(crowded, radius)).distinct()


def _flipped(flips: int) -> str:
    """SQL for the array of all points exactly ``flips`` bits away from ``fp``."""
    if flips == 0:
        return "array(fp)"
    if flips == 1:
        return "transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))"
    return (
        "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63),"
        " j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    )


def _neighbour_stars(fps: DataFrame, radius: int) -> DataFrame:
    """Links with the connectivity of distance ``radius``, from a number of rows linear in ``fps``.

    Each fingerprint names its near points (up to ``radius // 2`` flips away) and its far points
    (up to the rest of ``radius``).  At a point z, a member with z near and any member with z near
    or far are at most ``radius`` apart, so all of them may be linked to one near member.  Any two
    fingerprints at distance ``radius`` or less meet so at some z.
    """
    near_to = radius // 2
    far_to = radius - near_to
    near = fps.selectExpr("fp", f"explode(concat({', '.join(map(_flipped, range(near_to + 1)))})) AS z")
    hubs = near.groupBy("z").agg(F.min("fp").alias("hub"))
    points = near
    if far_to > near_to:
        points = near.unionByName(fps.selectExpr("fp", f"explode({_flipped(far_to)}) AS z"))
    return (
        points.join(hubs, "z")
        .filter("fp <> hub")
        .select(F.col("fp").alias("src"), F.col("hub").alias("dst"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint`` is the SimHash over word shingles as 16 hex digits; ``component_id`` is the
    smallest doc_id reachable over links of at most ``radius`` differing bits, itself included.

    Null and empty texts have fingerprint zero and are linked like any other.  A row without a
    doc_id keeps its place and takes the component's smallest non-null doc_id (null if there is
    none).  Repeated rows stay repeated.  Other columns are not read, so their names can't clash.
    An empty table gives an empty result.  Texts of any length are fingerprinted whole.
    """

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    marked = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), prints(F.col(text_col)).alias("fp")), "fingerprints"
    )
    classes = materialize(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    members = connected_components(fingerprint_links(classes.select("fp"), radius)).select(
        F.col("node").alias("fp"), "component"
    )
    members = members.join(classes, "fp")
    heads = members.groupBy("component").agg(F.min("least").alias("head"))
    linked = members.join(heads, "component").select("fp", "head")
    # Every fingerprint has one row here; a hot one is dealt over its copies by AQE's skew join.
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id"))
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class _WordBits(dict):
    """word -> 8 hashed bytes for each of the ``_PRINTS``; emptied once it holds too many words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = made = b"".join([xxhash.xxh3_128_digest(word, k) for k in range(_PRINTS // 2)])
        return made


def word_prints(text: str | None, bits: _WordBits) -> list[int]:
    """``_PRINTS`` independent 64-bit SimHashes of the set of a text's words."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    ones = np.zeros(64 * _PRINTS, dtype=np.int64)
    digests = [bits[w] for w in words]
    for at in range(0, len(digests), _BLOCK):
        part = np.frombuffer(b"".join(digests[at : at + _BLOCK]), dtype=np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64 * _PRINTS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).view(">i8").astype(np.int64).tolist()


def _shingles(text: str, width: int) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _mixed(groups: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``(key, node, part, size)``: the rows of ``groups(key, node)`` whose key holds several parts.

    A node's part is its component in ``parts``, or itself.  The table is written out.
    """
    if parts is None:
        placed = groups.select("key", "node", F.col("node").alias("part"))
    else:
        placed = groups.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size"))
    return materialize(placed.join(keys.filter("low <> high").select("key", "size"), "key"), "mixed")


def _star(mixed: DataFrame) -> DataFrame:
    """``(hub, node)``, one row at most for each node of ``_mixed``: whom to compare it with.

    A key's hub is the node that meets the most others, because the text that a group of copies was
    made from is nearer to them than they are to each other.  Of the hubs of its keys that are not
    of its own part a node takes the one that meets the most.
    """
    meets = mixed.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets"))
    hubs = mixed.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("back"), "part")).alias("hub"))
    hubs = hubs.select("key", "hub.meets", (-F.col("hub.back")).alias("hub"), F.col("hub.part").alias("hub_part"))
    best = mixed.join(hubs, "key").filter("part <> hub_part").groupBy("node").agg(F.max(F.struct("meets", (-F.col("hub")).alias("back"))).alias("best"))
    return best.select((-F.col("best.back")).alias("hub"), "node")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``(src, dst)``: the distinct ``pairs(hub, node)`` whose texts are similar enough.

    Each text goes once for each of its pairs to the task of its hub, where the hub's own text comes
    first; a hub of many pairs is dealt over several tasks.  A task holds two texts' shingles.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / _PAIRS_PER_SALT).alias("salts"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), "node")
    leads = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"))
    rows = members.unionByName(leads).join(texts, "node").select("hub", "salt", "node", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first = None, set()
        for batch in batches:
            found = []
            for hub, salt, node, text in zip(batch["hub"], batch["salt"], batch["node"], batch["text"], strict=True):
                own = _shingles(text, shingle)
                if at != (hub, salt):
                    at, first = (hub, salt), own
                elif node != hub and min(len(own), len(first)) >= similarity * max(len(own), len(first)):
                    shared = len(own & first)
                    if shared >= similarity * (len(own) + len(first) - shared):
                        found.append((hub, node))
            yield pd.DataFrame(found, columns=["src", "dst"])

    return materialize(rows.mapInPandas(compare, "src long, dst long"), "similar")


def similar_texts(nodes: DataFrame, texts_of, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(node, component)``: the components of the links between different texts whose word shingles
    have a Jaccard similarity of ``similarity`` or more.

    ``nodes(node, fps)`` has the ``word_prints`` of each text, over its set of words, because an
    edit changes one word but several shingles; ``texts_of(nodes)`` gives ``(node, text)`` of some
    nodes.  Texts that meet in a bucket of the covering masks of one fingerprint are candidates, and
    all candidates are settled by comparing whole texts: twice each text with the hub of one of its
    buckets, whatever the bucket's size, which joins the groups of copies.  Texts that still meet
    texts of other components then go through a prefix-filter join, which misses no link between
    them, however large their buckets are.
    """
    keys = [
        F.xxhash64(F.lit(k * 100 + t), F.col("fps")[k].bitwiseAND(F.lit(_signed(m))))
        for k in range(_PRINTS)
        for t, m in enumerate(covering_masks(3))
    ]
    mixed = _mixed(nodes.select("node", F.explode(F.array(*keys)).alias("key")), None)
    texts, links, parts = None, None, None

    def compared(pairs: DataFrame) -> DataFrame:
        found = _verified(pairs, texts, shingle, similarity)
        return found if links is None else links.unionByName(found)

    def settled(groups: DataFrame) -> DataFrame:
        found = _mixed(groups, parts)
        discard(groups)
        return found

    texts = materialize(texts_of(mixed.select("node").distinct()), "candidate-texts")
    for _ in range(2):
        links = compared(_star(mixed))
        parts = materialize(connected_components(links), "parts")
        mixed = settled(mixed)
    unsettled = mixed.select("node").distinct()
    prefixes = materialize(_prefixes(texts.join(unsettled, "node", "left_semi"), shingle, similarity), "prefixes")
    discard(mixed)
    mixed = _mixed(prefixes, parts)
    if not mixed.isEmpty():
        links = compared(_star(mixed))
        parts = materialize(connected_components(links), "parts")
        mixed = settled(mixed)
        rest = prefixes.join(mixed.select("key", "node", "part"), ["key", "node"])
        pairs = materialize(_prefix_pairs(rest, similarity).distinct(), "pairs")
        links = compared(pairs)
        parts = materialize(connected_components(links), "parts")
        discard(pairs)
    discard(mixed, prefixes, texts)
    return parts


def _prefixes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(node, key, n, place, short)``: the rarest shingles of each text of ``texts(node, text)``.

    ``n`` is the number of a text's shingles and ``place`` the rank of one from the rarest, from 1.
    Two sets of ``a <= b`` shingles with the Jaccard similarity t share at least t * b and
    2t / (1 + t) * a of them, so the first shingle they share is among the rarest
    b - ceil(t * b) + 1 of the larger set and, marked ``short``, a - ceil(2t / (1 + t) * a) + 1 of the smaller.
    """

    @F.pandas_udf("array<long>")
    def hashed(column: pd.Series) -> pd.Series:
        made = [np.frombuffer(b"".join(map(xxhash.xxh64_digest, _shingles(t, shingle))), dtype=">i8") for t in column]
        return pd.Series([np.unique(h).astype(np.int64) for h in made], dtype=object)

    rows = texts.select("node", F.explode(hashed("text")).alias("key"))
    rows = materialize(rows, "shingles")
    rows = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders")), "key")
    order = Window.partitionBy("node").orderBy("holders", "key")
    count = F.count(F.lit(1)).over(Window.partitionBy("node"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("n", count)
    twice = 2 * similarity / (1 + similarity)
    return rows.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).filter("holders > 1").select(
        "node", "key", "n", "place", (F.col("place") <= F.col("n") - F.ceil(F.col("n") * twice - 1e-9) + 1).alias("short")
    )


def _prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(hub, node)`` of different parts that share a key and whose numbers let them be similar enough."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    shared = 1 + F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    need = (small + large) * (similarity / (1 + similarity)) - 1e-9
    short = F.when(F.col("a.n") < F.col("b.n"), F.col("a.short")).when(F.col("a.n") > F.col("b.n"), F.col("b.short"))
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.part") != F.col("b.part"))
        & (small >= large * similarity - 1e-9) & (shared >= need) & short.otherwise(F.col("a.short") & F.col("b.short"))
    )
    return rows.alias("a").join(rows.alias("b"), meet).select(F.col("a.node").alias("hub"), F.col("b.node").alias("node"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay if each group of near copies keeps its smallest doc_id.

    Groups are the connected components of equal texts and of the links of ``similar_texts``.  Texts
    are equal if their 128-bit MD5s are; a null text counts as empty, and all empty texts are one
    group.  Null doc_ids come last in a group.  Of rows equal in doc_id and text one stays.  An empty
    table stays empty; all columns are returned as they are, whatever their names.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    rows = packed.select("row", F.col("row.doc_id").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("print"))

    @F.pandas_udf("array<long>")
    def prints(column: pd.Series) -> pd.Series:
        bits = _WordBits()
        return pd.Series([word_prints(t, bits) for t in column], dtype=object)

    # Null ids sort last: (is null, id) is compared as a pair.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "times")
    marks = materialize(rows.select("print", "doc_id", prints("text").alias("fps")), "word-prints")
    nodes = marks.groupBy("print", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.first("fps").alias("fps"))
    nodes = nodes.groupBy("print").agg(F.min(order).alias("head"), F.first("fps").alias("fps"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    discard(marks)

    def chosen(heads: DataFrame, columns: list) -> DataFrame:
        """One row of ``rows`` for each row of ``heads(print, doc_id, times, ...)``."""
        same = (F.col("d.print") == F.col("k.print")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
        found = rows.alias("d").join(heads.alias("k"), same).select("k.print", "k.times", *columns)
        names = found.columns[2:]
        once = found.filter("times = 1").select(*names)
        if heads.filter("times > 1").isEmpty():
            return once
        several = found.filter("times > 1").groupBy("print").agg(F.first(F.struct(*names)).alias("one"))
        return once.unionByName(several.select("one.*"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        heads = nodes.join(wanted, "node", "left_semi").select("print", "head.doc_id", "head.times", "node")
        return chosen(heads, ["k.node", "d.text"])

    groups = nodes.join(similar_texts(nodes, texts_of, shingle, similarity), "node", "left")
    linked = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("head", "print")).alias("h"))
    alone = groups.filter("component IS NULL").select("print", "head.doc_id", "head.times")
    keepers = materialize(alone.unionByName(linked.select("h.print", "h.head.doc_id", "h.head.times")), "keepers")
    return chosen(keepers, ["d.row"]).select("row.*")
