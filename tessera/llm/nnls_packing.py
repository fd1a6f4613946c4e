"""Sequence packing planned by non-negative least squares on the histogram of lengths.

Documents are cut at the window size; what is left of each is a remainder shorter than a window.
Remainders are counted in units of 16 tokens.  All ways to fill a window with up to three
remainders, and with short ones of one length and one more, are columns of a system whose right side
is the histogram; its non-negative solution, rounded down, says how often each way is used.  Remainders that are left over are laid end to end
and cut at window borders.

Only the histogram (one number for each unit) reaches the driver.  Which window a document goes to
follows from its rank among the remainders of its length, so no task ever holds a window's rivals.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

UNIT = 16
_CACHE = 400_000
_ROWS_PER_SALT = 20_000


# How the tokenizer's byte level writes bytes, and its pattern for pieces of these letters.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER_BYTES = [b for b in range(256) if b not in set(_PLAIN_BYTES)]
_BYTE_LETTERS = {**{b: chr(b) for b in _PLAIN_BYTES}, **{b: chr(256 + k) for k, b in enumerate(_OTHER_BYTES)}}
_LATIN = "a-zß-öø-ÿ"
_KNOWN = re.compile(f"[!-;=-~A-Z{_LATIN}À-ÖØ-Þ]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^0-9{_LATIN}]+")


class _Encoder(dict):
    """piece of text without spaces -> its ids as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of
    its pieces in a row.  A piece of ASCII and Latin-1 letters (without ``<``, with which special
    tokens start) needs no normal form, its lower case has as many letters, and the tokenizer's
    pattern cuts it into parts, which go to the merges directly; any other piece goes through the
    whole tokenizer.  Pieces met lately are kept: when the younger memory is full it becomes the
    older one, whose content is forgotten.
    """

    def __init__(self, path: str | None):
        super().__init__()
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.merges = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        made = self.older.get(piece)
        if made is None:
            made = self._made(piece)
        self[piece] = made
        return made

    def _made(self, piece: str) -> bytes:
        if not _KNOWN.fullmatch(piece):
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        parts = _PARTS.findall(piece.lower())
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        letters = parts[0] if parts[0].isascii() else "".join(map(_BYTE_LETTERS.__getitem__, parts[0].encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges(letters)])

    def ids(self, text: str, end: int) -> bytes:
        pieces = text.replace("\n", " ").replace("\t", " ").split(" ")
        return b"".join(map(self.__getitem__, pieces)) + np.uint32(end).tobytes()


_encoders: dict[str | None, _Encoder] = {}


def _encoder(path: str | None) -> _Encoder:
    """The worker's encoder, which its later tasks use too."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _signed(crc: int) -> int:
    return crc - (1 << 32) if crc >> 31 else crc


def join_crcs(blocks: list[int], last: int) -> int:
    """crc32 of blocks of ``UNIT`` ids in a row, the last of them ``last`` ids long, from their crc32s.

    crc32 is affine in its starting value, so the crc of A + B is that of B, with A's effect on as
    many zero bytes added.
    """
    total = blocks[0] & 0xFFFFFFFF
    for k, crc in enumerate(blocks[1:], 2):
        zeros = bytes(4 * (UNIT if k < len(blocks) else last))
        total = (crc & 0xFFFFFFFF) ^ zlib.crc32(zeros, total) ^ zlib.crc32(zeros)
    return total


def fillings(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with one, two or three parts, largest first, and for short parts
    those of one length as often as it fits, with one part more if that leaves room."""
    pairs = [(units - a, a) for a in range(1, units // 2 + 1)]
    triples = [(units - a - b, b, a) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    repeats = [(a,) * (units // a) + ((units % a,) if units % a else ()) for a in range(1, units // 3)]
    return list(dict.fromkeys([(units,), *pairs, *triples, *repeats]))


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises ``|columns @ x - target|``: active sets on the normal equations."""
    x = np.zeros(columns.shape[1])
    active: list[int] = []
    small = 1e-9 * max(1.0, float(np.abs(columns.T @ target).max(initial=0)))
    for _ in range(rounds):
        slope = columns.T @ (target - columns[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= small:
            break
        active.append(best)
        while True:
            part = columns[:, active]
            z = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ target)
            if z.min() > 0:
                x[active] = z
                break
            now = x[active]
            bad = z <= 0
            step = float(np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300)))
            x[active] = now + step * (z - now)
            gone = [a for a, k in zip(active, bad, strict=True) if k and x[a] <= small] or [active[int(np.argmin(x[active]))]]
            x[gone] = 0
            active = [a for a in active if a not in gone]
            if not active:
                break
    return x


def plan_windows(histogram: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and their repeat counts, none of which uses more remainders than there are.

    ``histogram[u]`` is the number of remainders of ``u`` units, ``u`` from 0 (unused) to ``units``.
    """
    counts = histogram.astype(np.int64).copy()
    if not counts.sum():
        return []
    ways = [w for w in fillings(units) if all(counts[u] for u in w)]
    if not ways:
        return []
    columns = np.zeros((units + 1, len(ways)))
    for k, way in enumerate(ways):
        for u in way:
            columns[u, k] += 1
    scale = float(counts.max())
    solved = nnls(columns, counts / scale) * scale
    plan = []
    for k in np.argsort(-solved, kind="stable"):
        times = int(solved[k] + 1e-6)
        need = np.bincount(ways[k], minlength=units + 1)
        used = need > 0
        times = min(times, int((counts[used] // need[used]).min()))
        if times:
            counts -= times * need
            plan.append((ways[k], times))
    return plan


def _before(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over earlier rows of the same ``keys``, as column ``name``.

    Rows are ordered by salt and dice.  Only sums of a salt meet in one place; rows never do.
    """
    sums = rows.groupBy(*keys, "salt").agg(F.sum(value).alias("of_salt"))
    earlier = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start_of_salt", F.coalesce(F.sum("of_salt").over(earlier), F.lit(0))).drop("of_salt")
    inside = Window.partitionBy(*keys, "salt").orderBy("dice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, "salt"])
        .withColumn(name, (F.col("start_of_salt") + F.col("inside")).cast("long"))
        .drop("start_of_salt", "inside")
    )


def _lengths(docs: DataFrame, window: int, end: int, tokenizer: str | None) -> DataFrame:
    kind = "n long, full array<long>, rest long, blocks array<int>"

    def lengths(text: str | None, encoder: _Encoder) -> tuple:
        data = memoryview(encoder.ids(text or "", end))
        cut = len(data) // (4 * window) * 4 * window
        rest = data[cut:]
        return (
            len(data) // 4,
            [zlib.crc32(data[i : i + 4 * window]) for i in range(0, cut, 4 * window)],
            zlib.crc32(rest),
            [_signed(zlib.crc32(rest[i : i + 4 * UNIT])) for i in range(0, len(rest), 4 * UNIT)],
        )

    @F.pandas_udf(kind)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for texts in batches:
            yield pd.DataFrame([lengths(t, encoder) for t in texts], columns=["n", "full", "rest", "blocks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measure("text").alias("m"))
    return rows.select("doc_id", "m.*", F.rand(11).alias("dice"))


def pack(docs: DataFrame, window: int = 4096, end: int = 2, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row for each piece.

    A document is its text's ids and then ``end``; a null or empty text is ``end`` alone, so every
    row has at least one piece.  Pieces of a document cover it without gap; pieces of a sequence do
    so from offset 0 and have at most ``window`` ids together.  Rows with the same or no doc_id are
    separate documents.  Texts are tokenized whole; an empty table gives no pieces; other columns
    are not read.  ``tokenizer`` is the path of the tokenizer's file.
    """
    units = window // UNIT
    rows = materialize(_lengths(docs, window, end, tokenizer), "lengths")
    salts = max(1, -(-rows.count() // _ROWS_PER_SALT))
    rows = rows.withColumn("salt", F.floor(F.col("dice") * salts)).withColumn("n_full", F.size("full").cast("long"))

    whole = _before(rows.filter("n_full > 0").select("doc_id", "n", "full", "n_full", "salt", "dice"), [], "n_full", "first")
    whole = whole.select("doc_id", "n", "first", F.posexplode("full").alias("k", "crc"))
    whole = whole.select(
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.col("first") + F.col("k")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    n_whole = rows.agg(F.coalesce(F.sum("n_full"), F.lit(0))).first()[0]

    rest = rows.withColumn("length", F.col("n") - F.col("n_full") * window).filter("length > 0")
    rest = rest.select(
        "doc_id", "n", "rest", "blocks", "salt", "dice", "length",
        F.ceil(F.col("length") / UNIT).cast("int").alias("u"), F.lit(1).cast("long").alias("one"),
    )
    histogram = np.zeros(units + 1, dtype=np.int64)
    for r in rest.groupBy("u").agg(F.sum("one").alias("c")).collect():  # at most `units` rows
        histogram[r["u"]] = r["c"]
    plan = plan_windows(histogram, units)

    slots, taken, sequence = [], [0] * (units + 1), int(n_whole)
    for way, times in plan:
        for place, u in enumerate(way):
            slots.append((u, taken[u], taken[u] + times, sequence, place))
            taken[u] += times
        sequence += times
    ranked = materialize(_before(rest, ["u"], "one", "rank"), "ranks")
    spark = docs.sparkSession
    # No more fillings are in use than there are units, and none has more parts than that.
    table = spark.createDataFrame(slots, "u int, low long, high long, base long, place int")
    placed = ranked.join(
        F.broadcast(table.withColumnRenamed("u", "slot_u")),
        (F.col("u") == F.col("slot_u")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    placed = placed.select(
        "doc_id", (F.col("n") - F.col("length")).alias("start"), "length", F.col("rest").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"),
        F.col("place").cast("long").alias("place"),
    )

    totals = spark.createDataFrame([(u, t) for u, t in enumerate(taken)], "t_u int, t long")
    left = ranked.join(F.broadcast(totals), F.col("u") == F.col("t_u")).filter("rank >= t")
    loose = _residual(left.select("doc_id", "n", "rest", "blocks", "salt", "dice", "length", "u"), units, sequence)
    order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.unionByName(loose).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    return whole.unionByName(packed.drop("place"))


def _residual(left: DataFrame, units: int, first_sequence: int) -> DataFrame:
    """Pieces of the remainders that no filling takes, laid end to end in whole units."""
    line = _before(left.withColumn("size", F.col("u").cast("long")), [], "size", "at")
    room = units - F.col("at") % units
    line = line.withColumn("cut", F.least(room, F.col("size")).cast("int"))
    halves = line.select("*", F.explode(F.when(F.col("cut") < F.col("size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("half"))

    @F.pandas_udf("long")
    def crc(blocks: pd.Series, cut: pd.Series, half: pd.Series, length: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for b, c, h, n, w in zip(blocks, cut, half, length, whole, strict=True):
            if c == len(b):
                out.append(w)
            elif h:
                out.append(join_crcs(list(map(int, b[c:])), n - UNIT * (len(b) - 1)))
            else:
                out.append(join_crcs(list(map(int, b[:c])), UNIT))
        return pd.Series(out, dtype="int64")

    def side(first: Column, second: Column) -> Column:
        return F.when(F.col("half") == 0, first).otherwise(second)

    cut_ids = F.col("cut").cast("long") * UNIT
    begin = F.col("at") + side(F.lit(0), F.col("cut"))
    return halves.select(
        "doc_id",
        (F.col("n") - F.col("length") + side(F.lit(0).cast("long"), cut_ids)).alias("start"),
        side(F.least(F.col("length"), cut_ids), F.col("length") - cut_ids).alias("length"),
        crc("blocks", "cut", "half", "length", "rest").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.floor(begin / units) + first_sequence).cast("long").alias("sequence_id"),
        begin.cast("long").alias("place"),
    )


def packed_ids(docs: DataFrame, pieces: DataFrame, end: int = 2, tokenizer: str | None = None) -> DataFrame:
    """``(sequence_id, ids, doc_ids, offsets)``: the sequences that ``pieces``, made by ``pack(docs)``, describe.

    ``ids`` are the token ids of a whole sequence, ``doc_ids`` and ``offsets`` its pieces in order.
    Documents are looked up by doc_id, so it has to be unique and not null here.  A document's pieces
    and a sequence's pieces are few, as a piece is cut from one window.
    """
    cuts = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(cuts, "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text, own in batch[["doc_id", "text", "cuts"]].itertuples(index=False):
                ids = np.frombuffer(encoder.ids(text or "", end), dtype="<u4")
                out += [(doc_id, c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]].astype(np.int32)) for c in own]
            yield pd.DataFrame(out, columns=["doc_id", "sequence_id", "offset", "ids"])

    parts = rows.mapInPandas(cut, "doc_id long, sequence_id long, offset long, ids array<int>")
    lists = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return lists.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
