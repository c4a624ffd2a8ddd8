"""Filling containers of fixed capacity with posts, by non-negative least squares over a histogram.

1. Sizes: tokens of every post by a public tokenizer, counted in one Arrow pass.
2. A post longer than the capacity fills whole containers; only its rest is an item. No other is split.
3. Plan, on the histogram of item sizes alone (a bounded number of rows, whatever the corpus). Levels of blocks, each a
   quarter of the next, down from the capacity: at each level the sizes above the next lower block are binned, all
   combinations of up to three bins are enumerated whose room the lower levels' blocks fill down to a window, and
   non-negative least squares finds how often to use each so that the counts of bins and blocks are met. So every
   size enters, at the level of its length, and a container holds any number of items. The counts are rounded
   down; the sizes that remain go best-fit, longest first, into the room that is left or into new containers. Where that
   takes more containers than best-fit alone would, some of the shortest items are held back for the last step, more and
   more of them, and in the end combinations are taken apart again, so the plan never takes more.
4. Placement: an item's rank among the items of its size picks its slot of the plan. Ranks come from
   hash buckets whose number grows with the size's count, so a size that a third of all posts share is
   numbered in many tasks; bucket totals give each bucket its first rank.

A capacity of more tokens than the histogram has rows (see ``ROWS``) is planned in units of several tokens, an item's last
one rounded up.

Defined results: a null or empty text has 0 tokens, takes no room and gets a null container; so do all
posts of a capacity that is null or below 1 (none is packed there). Ties and repeated posts are items
of their own. Containers are numbered from 0 within a capacity.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.shipping import ship
from graphloom.storage import materialize

TOKENIZER = os.environ.get("GRAPHLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: fixed value: the vocabulary's public pre-tokenisation pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: bins per level, width of the window in bins, a level's block as a part of the next one's, smallest block
BINS, WINDOW, RATIO, LEAST_BLOCK = 128, 1, 4, 4
#: power of an item's length by which least squares weighs its count
EMPHASIS = 2
#: items of one size that are numbered in one task
BUCKET = 20_000
#: rows of all histograms together that come to the driver at once, least rows of one, capacities handled at once
ROWS, LEAST_ROWS, TOGETHER = 1 << 20, 1 << 14, 64

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per Python worker, from where the application keeps its files."""
    if path not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        shipped = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory or SparkFiles._is_running_on_worker else path
        with open(shipped if os.path.exists(shipped) else path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _counter(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return scan


def token_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of all posts."""
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(tokenizer)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counter(tokenizer), f"id {dict(rows.dtypes)['id']}, n_tokens bigint").withColumnRenamed("id", doc_id)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares ``a x = b`` with ``x >= 0``, by the active-set method, to its optimum."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(100 * (n + 1)):  # each round lowers the residual, so none comes back
        blocked = np.where(free, -np.inf, gradient)
        best = int(np.argmax(blocked)) if n else 0
        if not n or blocked[best] <= tolerance:
            break
        free[best] = True
        while True:
            part = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, part], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[part] = s
                break
            falling = s <= 0
            step = np.min(x[part][falling] / np.maximum(x[part][falling] - s[falling], 1e-300))
            x[part] += step * (s - x[part])
            free[part[x[part] <= 1e-12]] = False
            x[~free] = 0
        gradient = a.T @ (b - a @ x)
    else:
        raise ArithmeticError("least squares found no optimum")
    return x


def combinations(bins: np.ndarray, top: int, window: int, blocks: list[int] = ()) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Up to three of the given bins and, largest first, so many of each block as fill the room to within the window:
    (bins, number of each block)."""
    have, out = set(bins.tolist()), []
    ordered = sorted(have, reverse=True)

    def filled(room: int) -> tuple[int, ...] | None:
        counts = []
        for size in blocks:
            counts.append(room // size)
            room %= size
        return tuple(counts) if room < window else None

    fills = [filled(room) for room in range(top + 1)]
    for i, x in enumerate(ordered):
        if x <= top and fills[top - x] is not None:
            out.append(((x,), fills[top - x]))
        for y in ordered[i:]:
            if x + y > top:
                continue
            if fills[top - x - y] is not None:
                out.append(((x, y), fills[top - x - y]))
            for z in range(min(y, top - x - y), 0, -1):
                if z in have and fills[top - x - y - z] is not None:
                    out.append(((x, y, z), fills[top - x - y - z]))
    return out


@dataclass
class Plan:
    """Slots per item size: items of ranks ``first .. first + k * containers`` go ``k`` per container."""

    size: list[int]
    first: list[int]
    per: list[int]
    container: list[int]
    containers: int
    solved: int = 0  # items that least squares placed


def _level(left: dict[int, int], capacity: int, above: int, blocks: list[list[list]], caps: list[int], last: bool) -> list[list]:
    """Fillings [size, times, {item size: number}] of one capacity with the items longer than ``above`` and the blocks of
    lower levels, which are taken from ``left`` and ``blocks`` (lists of such fillings, largest capacity first)."""
    width = max(1, -(-capacity // BINS))
    top = capacity // width
    bins: dict[int, list[int]] = {}
    for s in sorted((s for s, n in left.items() if n > 0 and above < s <= top * width), reverse=True):
        bins.setdefault(-(-s // width), []).append(s)
    usable = [i for i, c in enumerate(caps) if c >= width and blocks[i]]
    units = [-(-caps[i] // width) for i in usable]
    ways = combinations(np.array(sorted(bins)), top, WINDOW, units) if bins else []
    if last:  # containers of blocks alone
        for j, u in enumerate(units):
            if top % u < WINDOW:
                ways.append(((), tuple(top // u if i == j else 0 for i in range(len(units)))))
    if not ways:
        return []
    row = {b: i for i, b in enumerate(sorted(bins))}
    a = np.zeros((len(row) + len(units), len(ways)))
    for j, (way, fill) in enumerate(ways):
        for b in way:
            a[row[b], j] += 1
        a[len(row) :, j] = fill
    counts = np.array([sum(left[s] for s in bins[b]) for b in sorted(bins)] + [sum(g[1] for g in blocks[i]) for i in usable], float)
    # what stays unmatched should be short, since short items fill any room: a row weighs by its length
    weight = np.array([(b / top) ** EMPHASIS for b in sorted(bins)] + [(u / top) ** EMPHASIS for u in units])
    out = []
    for (way, fill), times in zip(ways, np.floor(nnls(a * weight[:, None], counts * weight) + 1e-6).astype(int).tolist()):
        while times > 0:  # real sizes and blocks, in runs of equal ones
            chosen: dict[int, int] = {}
            groups: list[tuple[list, int]] = []
            for i, k in zip(usable, fill):
                for g in reversed(blocks[i]):
                    if k <= 0:
                        break
                    take = min(k, g[1])
                    groups.append((g, take))
                    k -= take
                if k > 0:
                    break
            else:
                room = capacity - sum(g[0] * k for g, k in groups)
                for at, b in enumerate(way, 1):
                    while bins[b] and left[bins[b][0]] <= 0:
                        bins[b].pop(0)
                    s = next((s for s in bins[b] if left[s] > chosen.get(s, 0)), None)
                    if s is None:
                        break
                    if at == len(way):  # bins and blocks round up: the last part is the longest one that fits
                        s = next((t for t in range(min(room, top * width), s, -1) if left.get(t, 0) > chosen.get(t, 0)), s)
                    chosen[s] = chosen.get(s, 0) + 1
                    room -= s
                else:
                    n = min([times, *(left[s] // k for s, k in chosen.items()), *(g[1] // k for g, k in groups)])
                    held = dict(chosen)
                    for s, k in chosen.items():
                        left[s] -= n * k
                    for g, k in groups:
                        g[1] -= n * k
                        for s, m in g[2].items():
                            held[s] = held.get(s, 0) + k * m
                    for i in usable:
                        while blocks[i] and blocks[i][-1][1] <= 0:
                            blocks[i].pop()
                    out.append([sum(s * k for s, k in held.items()), n, held])
                    times -= n
                    continue
            break
    return out


def _solved(left: dict[int, int], capacity: int) -> list[list]:
    """Fillings [room, containers, {size: items in each}] by least squares, level by level; takes their items from ``left``."""
    caps = [capacity]
    while caps[-1] // RATIO >= LEAST_BLOCK:
        caps.append(caps[-1] // RATIO)
    blocks: list[list[list]] = []
    lower: list[int] = []
    for i in range(len(caps) - 1, -1, -1):
        made = _level(left, caps[i], caps[i + 1] if i + 1 < len(caps) else 0, blocks, lower, i == 0)
        blocks, lower = [made, *blocks], [caps[i], *lower]
    for unused in blocks[1:]:
        for _, n, held in unused:
            for s, k in held.items():
                left[s] += n * k
    return [[capacity - size, n, held] for size, n, held in blocks[0]]


def _without_shortest(histogram: dict[int, int], tokens: float) -> tuple[dict[int, int], dict[int, int]]:
    """The histogram without its shortest items of so many tokens together, and those."""
    kept, held = dict(histogram), {}
    for s in sorted(histogram):
        n = min(kept[s], int(tokens // s))
        if n <= 0:
            break
        held[s] = n
        kept[s] -= n
        tokens -= n * s
    return kept, held


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """How many containers to fill in which way; sees sizes and counts only."""
    alone: list[list] = []
    _best_fit(alone, dict(histogram), capacity)
    fewest, total = sum(p[1] for p in alone), sum(s * n for s, n in histogram.items())
    for share in (0, 1 / 64, 1 / 32, 1 / 16, 1 / 8):  # of the tokens, held back in short items for the rooms that stay
        left, held = _without_shortest(histogram, share * total)
        solved = _solved(left, capacity)
        for s, n in held.items():
            left[s] += n
        patterns = [[room, n, dict(chosen)] for room, n, chosen in solved]
        _best_fit(patterns, dict(left), capacity)
        if sum(p[1] for p in patterns) <= fewest:
            break
    # what still takes more containers than best-fit alone is taken apart: combinations with the most room or with the
    # shortest items first, whichever leaves more of them
    best: tuple[int, list[list]] | None = None
    for order in (lambda p: (-p[0], min(p[2])), lambda p: (min(p[2]), -p[0])):
        solved.sort(key=order)
        apart = 0
        while True:
            rest = dict(left)
            for _, n, chosen in solved[:apart]:
                for s, k in chosen.items():
                    rest[s] += n * k
            patterns = [[room, n, dict(chosen)] for room, n, chosen in solved[apart:]]
            _best_fit(patterns, rest, capacity)
            if apart >= len(solved) or sum(p[1] for p in patterns) <= fewest:
                break
            apart = min(len(solved), apart + 1 + apart // 4)
        placed = sum(n * sum(chosen.values()) for _, n, chosen in solved[apart:])
        if best is None or placed > best[0]:
            best = placed, patterns
    placed, patterns = best
    out = Plan([], [], [], [], 0, placed)
    next_rank: dict[int, int] = {}
    for _, n, chosen in patterns:
        for s, k in chosen.items():
            out.size.append(s)
            out.first.append(next_rank.get(s, 0))
            out.per.append(k)
            out.container.append(out.containers)
            next_rank[s] = next_rank.get(s, 0) + n * k
        out.containers += n
    return out


def _best_fit(patterns: list[list], left: dict[int, int], capacity: int) -> None:
    """Puts what is left, longest first, where the least room remains; whole runs of containers at once."""
    rooms: list[list[list]] = [[] for _ in range(capacity + 1)]
    for p in patterns:
        rooms[p[0]].append(p)
    # the next room that may hold a pattern, so that empty rooms are passed over once
    for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n, room = left[s], s
        while n > 0:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                k = capacity // s
                full, rest = divmod(n, k)
                for times, per in ((full, k), (1 if rest else 0, rest)):
                    if times:
                        p = [capacity - s * per, times, {s: per}]
                        patterns.append(p)
                        rooms[p[0]].append(p)
                break
            p = rooms[room].pop()
            k = min(room // s, n)
            times = min(p[1], n // k)
            if times < p[1]:  # the run divides
                rest = [room, p[1] - times, dict(p[2])]
                patterns.append(rest)
                rooms[room].append(rest)
                p[1] = times
            p[2] = {**p[2], s: p[2].get(s, 0) + k}
            p[0] = room - s * k
            rooms[p[0]].append(p)
            n -= times * k
            room = s
        left[s] = 0


_PLACE = T.LongType()


def pack(docs: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", text: str = "text", pack_id: str = "pack_id", max_tokens: str = "max_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(pack_id, container_id, doc_id, piece, start_token, n_tokens)``: every post in every filling.

    Pieces of a post longer than the capacity are numbered from 0 and start at ``start_token``; any other
    post is one piece."""
    wanted = capacities.where(F.col(pack_id).isNotNull()).groupBy(F.col(pack_id).alias("pack_id")).agg(F.max(F.col(max_tokens).cast("long")).alias("cap"))
    kind = dict(wanted.dtypes)["pack_id"]
    packs = [(r.pack_id, r.cap) for r in wanted.orderBy("pack_id").toLocalIterator()]
    sizes = materialize(token_sizes(docs, doc_id, text, tokenizer).withColumnRenamed(doc_id, "id"), "sizes")
    out = _packed(sizes, dict(packs[:TOGETHER]), kind)
    for at in range(TOGETHER, len(packs), TOGETHER):
        out = out.unionByName(_packed(sizes, dict(packs[at : at + TOGETHER]), kind))
    return out.withColumnRenamed("id", doc_id)


def _packed(sizes: DataFrame, packs: dict, kind: str) -> DataFrame:
    spark = sizes.sparkSession
    rows = max(LEAST_ROWS, ROWS // max(1, len(packs)))
    unit = {k: max(1, -(-c // rows)) for k, c in packs.items() if c and c >= 1}
    each = [F.struct(F.lit(k).cast(kind).alias("pack_id"), F.lit(c).cast("long").alias("cap"), F.lit(unit.get(k, 1)).cast("long").alias("u")) for k, c in packs.items()]
    none_wanted = F.expr(f"cast(array() as array<struct<pack_id:{kind},cap:bigint,u:bigint>>)")
    posts = sizes.select("*", F.explode(F.array(*each) if each else none_wanted).alias("p")).select("id", "n_tokens", "p.pack_id", "p.cap", "p.u")
    usable = (F.col("cap") >= 1) & (F.col("n_tokens") > 0)
    whole = F.when(usable, F.floor((F.col("n_tokens") - 1) / F.col("cap"))).otherwise(F.lit(0)).cast("long")
    rest = F.when(usable, F.col("n_tokens") - F.col("whole") * F.col("cap")).otherwise(F.lit(0).cast("long"))
    # size in units; one that only the capacity itself could hold takes a whole container
    units = F.least(F.ceil(F.col("rest") / F.col("u")), F.floor(F.col("cap") / F.col("u"))).cast("long")
    items = posts.withColumn("whole", whole).withColumn("rest", rest).withColumn("units", F.when(F.col("rest") > 0, units))

    tally = items.where("rest > 0").groupBy("pack_id", "units").agg(F.count(F.lit(1)).alias("n"))
    cut = items.where("whole > 0").groupBy("pack_id").agg(F.sum("whole").alias("n")).select("pack_id", F.lit(0).cast("long").alias("units"), "n")
    histograms: dict = {k: {} for k in packs}
    full: dict = dict.fromkeys(packs, 0)
    for r in tally.unionByName(cut).collect():  # at most so many rows as all histograms may have
        if r.units:
            histograms[r.pack_id][r.units] = r.n
        else:
            full[r.pack_id] = r.n
    plans = {k: plan(histograms[k], packs[k] // unit[k]) for k in unit}
    slots: dict = {}
    for k, p in plans.items():
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for s, first, per, container in zip(p.size, p.first, p.per, p.container):
            by_size.setdefault(s, []).append((first, per, container))
        slots[k] = {s: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for s, v in by_size.items()}
    shared = spark.sparkContext.broadcast(slots)  # as many slots as sizes and plan patterns

    @F.pandas_udf(_PLACE)
    def container_of(packs_, rests, ranks):
        import pandas as pd

        out = np.zeros(len(ranks), np.int64)
        table, p, s, r = shared.value, packs_.to_numpy(), rests.to_numpy(), ranks.to_numpy()
        groups = pd.DataFrame({"p": p, "s": s}).groupby(["p", "s"]).indices
        for (pack, size), where in groups.items():
            first, per, container = table[pack][size]
            i = np.searchsorted(first, r[where], side="right") - 1
            out[where] = container[i] + (r[where] - first[i]) // per[i]
        return pd.Series(out)

    counts = [(k, s, n) for k, h in histograms.items() for s, n in h.items()]
    per_size = F.broadcast(spark.createDataFrame(counts or [(None, 0, 0)], f"pack_id {kind}, units bigint, n_of_size bigint"))
    last = items.where("rest > 0").join(per_size, ["pack_id", "units"])
    last = last.withColumn("bucket", F.pmod(F.xxhash64("id", "whole"), F.ceil(F.col("n_of_size") / BUCKET).cast("long")))
    within = Window.partitionBy("pack_id", "units", "bucket").orderBy("id")
    numbered = materialize(last.select("pack_id", "units", "rest", "bucket", "id", "whole", "cap", F.row_number().over(within).alias("r")), "ranks")
    totals = numbered.groupBy("pack_id", "units", "bucket").agg(F.count(F.lit(1)).alias("t"))
    so_far = Window.partitionBy("pack_id", "units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pack_id", "units", "bucket", F.coalesce(F.sum("t").over(so_far), F.lit(0)).alias("base"))
    ranked = numbered.join(bases, ["pack_id", "units", "bucket"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    placed = ranked.select(
        "pack_id", container_of("pack_id", "units", "rank").alias("container_id"), "id", F.col("whole").alias("piece"), (F.col("whole") * F.col("cap")).alias("start_token"), F.col("rest").alias("n_tokens")
    )
    # whole containers of split posts follow those of the plan: prefix sums over buckets of posts
    offsets = F.broadcast(spark.createDataFrame([(k, plans[k].containers, -(-max(full[k], 1) // BUCKET)) for k in plans] or [(None, 0, 1)], f"pack_id {kind}, planned bigint, n_buckets bigint"))
    split = items.where("whole > 0").join(offsets, "pack_id").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("n_buckets")))
    split_totals = split.groupBy("pack_id", "bucket").agg(F.sum("whole").alias("t"))
    before = Window.partitionBy("pack_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    split_bases = split_totals.select("pack_id", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("pack_id", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("own", F.coalesce(F.sum("whole").over(own), F.lit(0))).join(split_bases, ["pack_id", "bucket"])
    pieces = split.select("pack_id", "id", "cap", (F.col("planned") + F.col("base") + F.col("own")).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    pieces = pieces.select("pack_id", (F.col("c") + F.col("piece")).alias("container_id"), "id", "piece", (F.col("piece") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"))
    none = items.where("rest = 0").select("pack_id", F.lit(None).cast("long").alias("container_id"), "id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start_token"), F.col("n_tokens"))
    return placed.unionByName(pieces).unionByName(none)


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the fewest containers any filling could need, and the share filled."""
    used = placed.where(F.col("container_id").isNotNull()).groupBy("pack_id").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("container_id") + 1).alias("n_containers"))
    out = used.join(capacities.select("pack_id", "max_tokens").distinct(), "pack_id")
    return out.select(
        "pack_id", "max_tokens", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("max_tokens")).alias("fewest"), (F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens"))).alias("filled")
    )
