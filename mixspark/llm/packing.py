"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents longer than the largest are cut into whole
sequences and a rest. The rests are spread evenly over shards; inside one, the longest first,
each goes to the open bin it fits best, or else opens the bin size that costs least for it. In the
end every bin is downsized to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths. A sequence of c tokens costs OVERHEAD + c * (1 + c / ATTENTION).
CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION = 64, 32768
#: Pieces that one shard packs on average: enough that its last, emptier bins hardly count.
SHARD_PIECES = 20_000


def pack(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each length (given in descending order, none above the largest capacity), its
    place there, and each bin's final capacity.

    A new bin gets the size of the least cost per token it will hold: the piece that opens it and, of
    the room left, as much as the pieces still to come that are no longer than it can fill.
    """
    caps = np.sort(np.asarray(capacities))
    to_come = np.cumsum(lengths[::-1])[::-1]  # tokens from each piece on
    ascending = -lengths  # for bisection in the descending order
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    bin_of, place = np.zeros((2, len(lengths)), np.int64)
    size, fill = [], []
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(free, (n, -1))
        if at < len(free):  # the fullest bin that still takes it
            room, b = free.pop(at)
        else:
            best = None
            for c in caps[caps >= n].tolist():
                j = max(i + 1, int(np.searchsorted(ascending, -(c - n))))
                usable = min(c - n, int(to_come[j]) if j < len(lengths) else 0)
                cost = (overhead + c * (1 + c / ATTENTION)) / (n + usable)
                if best is None or cost < best[0]:
                    best = (cost, c)
            room, b = best[1], len(size)
            size.append(best[1])
            fill.append(0)
        bin_of[i], place[i] = b, fill[b]
        fill[b] += n
        if room > n:
            insort(free, (room - n, b))
    fill = np.array(fill, np.int64)
    return bin_of, place, caps[np.searchsorted(caps, fill)] if len(fill) else fill


def pack_shard(capacities, overhead):
    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        ids, piece = table["doc_id"].to_numpy(zero_copy_only=False), table["piece"].to_numpy()
        row = table["row"].to_numpy()
        order = np.lexsort((row, piece, np.nan_to_num(ids.astype(np.float64)), -length))
        bins, place, capacity = pack(length[order], capacities, overhead)
        take = table.take(pa.array(order))
        return pa.table({
            "doc_id": take["doc_id"], "piece": take["piece"], "start": take["start"],
            "length": take["length"], "shard": take["shard"], "bin": pa.array(bins), "bin_offset": pa.array(place),
            "capacity": pa.array(capacity[bins], pa.int64())})
    return run


def best_fit_pack(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities=CAPACITIES,
                  overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Per piece: doc_id, piece (0, 1, ...), start, length, bin_id, bin_offset, capacity.

    ``length`` is the number of tokens of a row. A row of null, zero or negative length takes no
    room and gives no piece. Every other token is in exactly one piece, no bin is over its capacity
    and every capacity is permitted. Null and repeated ids are packed like others. An empty table
    gives no rows. Other columns are not read.
    """
    caps = sorted(int(c) for c in capacities)
    top = caps[-1]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n")).where("n > 0")
    cut = rows.withColumn("row", F.monotonically_increasing_id())
    whole = cut.where(f"n >= {top}").select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {top} - 1"))).alias("piece"), "row")
    whole = whole.select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"), F.lit(top).cast("long").alias("length"),
        F.concat_ws("-", F.lit("w"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"),
        F.lit(top).cast("long").alias("capacity"))

    rest = cut.where(f"n % {top} > 0").select(
        "doc_id", F.expr(f"n div {top}").alias("piece"), F.expr(f"n - n % {top}").alias("start"),
        F.expr(f"n % {top}").alias("length"), "row")
    shards = max(1, -(-rows.where(f"n % {top} > 0").count() // shard_pieces))
    # The row number spreads repeated ids over the shards; the pieces' own hash would not.
    packed = (rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
              .groupBy("shard").applyInArrow(
                  pack_shard(caps, overhead),
                  "doc_id long, piece long, start long, length long, shard long, bin long, "
                  "bin_offset long, capacity long"))
    bin_id = F.concat_ws("-", F.lit("s"), "shard", "bin")
    return packed.select(
        "doc_id", "piece", "start", "length", bin_id.alias("bin_id"), "bin_offset",
        "capacity").unionByName(whole)
